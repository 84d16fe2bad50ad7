"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are dealt to the nearest of a few hundred pivots and a pivot's cell is
split into shards of bounded size.  Each shard's ball tree is built once, in
the pass that also answers every query in its most promising shard.  That gives
each query a floor, the k-th score it has already; it is then sent on only to
the shards of cells whose ball can hold a greater inner product
(centre . query + radius * |query|).  Within a shard it goes down the tree,
the child of greater bound first, and leaves out nodes below its floor, which
rises with every leaf.  Vectors are shuffled once into shards and the stored
trees once more to their queries, however many queries there are; a task reads
a shard, then streams the shard's queries past it.

Every score is an exact integer: components are floor(scale * x), and products
are summed in doubles only while that is exact, in 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut

_LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Search:
    """``shard_rows`` and ``block_queries`` bound what a task holds; ``leaf`` is the tree's leaf size.

    ``pivots`` bounds the cells, and ``most_lengths`` the different lengths of
    vectors; the table of cells that goes to every task has no more rows than
    these together.
    """

    k: int = 5
    scale: int = 256
    shard_rows: int = 4096
    block_queries: int = 2048
    leaf: int = 64
    pivots: int = 512
    most_lengths: int = 1024


@dataclass(frozen=True)
class Tree:
    """A ball tree: its points and their ids in the leaves' order, and nodes as start, end, left, right (-1: a leaf), centre and radius."""

    points: np.ndarray
    ids: np.ndarray
    nodes: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @staticmethod
    def build(points: np.ndarray, ids: np.ndarray, leaf: int) -> Tree:
        """A node is split at the median of a direction in which it is wide, down to ``leaf`` points."""
        order, nodes, centres, radii, stack = np.arange(len(points)), [], [], [], [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[order[a:b]]
            centre = own.mean(0)
            away = ((own - centre) ** 2).sum(1)
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            nodes.append([a, b, -1, -1])
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            if b - a > leaf:
                far = own[away.argmax()]
                axis = own[((own - far) ** 2).sum(1).argmax()] - far
                # Copies of one point need no more splitting.
                if axis.any():
                    half = (a + b) // 2
                    order[a:b] = order[a:b][np.argsort(own @ axis, kind="stable")]
                    stack += [(half, b, len(nodes) - 1, 1), (a, half, len(nodes) - 1, 0)]
        return Tree(points[order], ids[order], np.array(nodes, np.int64), np.array(centres), np.array(radii))


def bound(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The greatest inner product of each query with a point of each ball, with some slack for rounding."""
    out = queries @ centres.T + np.sqrt((queries**2).sum(1))[:, None] * radii[None, :] * (1 + 1e-9)
    return out + 1 + 1e-9 * np.abs(out)


def branch_and_bound(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's best k among the tree's points, by score and then id.

    ``floors``: the k-th score each query has elsewhere; candidates below it are left out.
    """
    largest = float(np.abs(tree.points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * tree.points.shape[1]
    table, asked = (tree.points, queries) if largest < 2.0**52 else (tree.points.astype(np.int64), queries.astype(np.int64))
    best = np.full((len(queries), k), _LOWEST, np.int64)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    floors, bounds = floors.astype(np.int64).copy(), bound(queries, tree.centres, tree.radii)

    def visit(node: int, rows: np.ndarray) -> None:
        rows = rows[bounds[rows, node] >= floors[rows]]
        if not len(rows):
            return
        a, b, left, right = tree.nodes[node]
        if left >= 0:
            first = bounds[rows, left] >= bounds[rows, right]
            for near, far, own in ((left, right, rows[first]), (right, left, rows[~first])):
                visit(near, own)
                visit(far, own)
            return
        scores = (asked[rows] @ table[a:b].T).astype(np.int64)
        # Several rows may share an id; a query's own row is never its candidate.
        scores[tree.ids[None, a:b] == query_ids[rows][:, None]] = _LOWEST
        all_scores = np.concatenate([best[rows], scores], axis=1)
        all_ids = np.concatenate([best_ids[rows], np.broadcast_to(tree.ids[a:b], scores.shape)], axis=1)
        rank = np.lexsort((all_ids, -np.maximum(all_scores, _LOWEST + 1)), axis=1)[:, :k]
        best[rows] = np.take_along_axis(all_scores, rank, 1)
        best_ids[rows] = np.take_along_axis(all_ids, rank, 1)
        floors[rows] = np.maximum(floors[rows], best[rows, k - 1])

    visit(0, np.arange(len(queries)))
    rows, cols = np.nonzero((best > _LOWEST) & (best >= floors[:, None]))
    return rows, best_ids[rows, cols], best[rows, cols]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(batches: Iterable[pa.RecordBatch], pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Add the nearest pivot's cell and the distance to it; vectors of a length without pivots have a cell around nought."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        cell, away = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
        for size in np.unique(dims):
            at = np.flatnonzero(dims == size)
            v = _matrix(batch.column("v").take(pa.array(at)))
            if int(size) in pivots:
                numbers, centres = pivots[int(size)]
                near = ((centres**2).sum(1)[None, :] - 2 * v @ centres.T).argmin(1)
                cell[at], away[at] = numbers[near], np.sqrt(((v - centres[near]) ** 2).sum(1))
            else:
                away[at] = np.sqrt((v**2).sum(1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "dims", "v")), pa.array(cell), pa.array(away)], names=["id", "h", "dims", "v", "cell", "away"])


def _route(batches: Iterable[pa.RecordBatch], cells, first: bool) -> Iterator[pa.RecordBatch]:
    """A row for each query and shard to meet.

    ``first``: the shard that promises most, one per query.  Else all others of the cells whose ball reaches the floor.
    """
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for size in np.unique(dims):
            if int(size) not in cells.value:
                continue
            numbers, centres, radii, shards = cells.value[int(size)]
            every = np.flatnonzero(dims == size)
            for at in (every[i : i + 1024] for i in range(0, len(every), 1024)):
                part = batch.take(pa.array(at))
                v, h = _matrix(part.column("v")), part.column("h").to_numpy()
                best = (v @ centres.T).argmax(1)
                pilot = numbers[best] * (1 << 32) + np.mod(h, shards[best])
                if first:
                    row, shard = np.arange(len(at)), pilot
                else:
                    row, cell = np.nonzero(bound(v, centres, radii) >= part.column("floor").to_numpy()[:, None])
                    many = shards[cell]
                    sub = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    row, shard = np.repeat(row, many), np.repeat(numbers[cell] * (1 << 32), many) + sub
                    keep = shard != pilot[row]
                    row, shard = row[keep], shard[keep]
                for i in range(0, len(row), 4096):
                    chosen = part.take(pa.array(row[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[i : i + 4096]), *(chosen.column(c) for c in ("id", "h", "floor", "v"))], names=["shard", "id", "h", "floor", "v"])


_FOUND = "query_id long, h long, vec_id long, score long"
_TREE = "shard long, ids binary, points binary, nodes binary, centres binary, radii binary, dims int"


def _answers(tree: Tree, batch: pa.RecordBatch, search: Search) -> Iterator[list[pa.Array]]:
    for at in range(0, batch.num_rows, search.block_queries):
        part = batch.slice(at, search.block_queries)
        ids, h = part.column("id").to_numpy(), part.column("h").to_numpy()
        rows, found, scores = branch_and_bound(tree, _matrix(part.column("v")), ids, part.column("floor").to_numpy(), search.k)
        yield [pa.array(c.astype(np.int64)) for c in (ids[rows], h[rows], found, scores)]


def _runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches with equal keys."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy() for k in keys]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _build(batches: Iterable[pa.RecordBatch], search: Search) -> Iterator[pa.RecordBatch]:
    """Rows by shard, points before queries: the shard's tree in one row, and the queries' answers."""
    shard, tree, ids, points = None, None, [], []
    names = [x.split()[0] for x in f"{_TREE}, {_FOUND}".split(", ")]

    def grown() -> Tree:
        return Tree.build(np.concatenate(points), np.concatenate(ids), search.leaf)

    def stored() -> pa.RecordBatch:
        parts = [tree.ids, tree.points, tree.nodes, tree.centres, tree.radii]
        arrays = [pa.array([shard]), *(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([tree.points.shape[1]], pa.int32())]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(1, pa.int64()) for _ in range(4))], names=names)

    for (own, is_query), part in _runs(batches, "shard", "is_query"):
        if own != shard:
            if points and tree is None:
                tree = grown()
                yield stored()
            shard, tree, ids, points = own, None, [], []
        if not is_query:
            ids.append(part.column("id").to_numpy())
            points.append(_matrix(part.column("v")))
            continue
        if tree is None:
            if not points:
                continue
            tree = grown()
            yield stored()
        for found in _answers(tree, part, search):
            n = len(found[0])
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, kind) for kind in kinds), *found], names=names)
    if points and tree is None:
        tree = grown()
        yield stored()


def _search(batches: Iterable[pa.RecordBatch], search: Search) -> Iterator[pa.RecordBatch]:
    """Rows by shard, its stored tree before its queries: the queries' answers."""
    shard, tree = None, None
    for (own, is_query), part in _runs(batches, "shard", "is_query"):
        if own != shard:
            shard, tree = own, None
        if not is_query:
            dims = part.column("dims")[0].as_py()
            raw = {c: part.column(c)[0].as_buffer() for c in ("ids", "points", "nodes", "centres", "radii")}
            own_points, centres = (np.frombuffer(raw[c]).reshape(-1, dims) for c in ("points", "centres"))
            tree = Tree(own_points, np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["nodes"], np.int64).reshape(-1, 4), centres, np.frombuffer(raw["radii"]))
        elif tree is not None:
            for found in _answers(tree, part, search):
                yield pa.RecordBatch.from_arrays(found, names=[x.split()[0] for x in _FOUND.split(", ")])


def scaled(vector: Column, search: Search) -> Column:
    """floor(scale * x) of every component as a double, or null if the vector takes no part."""
    v = F.transform(vector.cast("array<double>"), lambda x: x * search.scale)
    # A double beyond 2**53 is whole already.
    v = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    sound = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(vector) > 0), v)


def top_k(vectors: DataFrame, queries: DataFrame, *, vector: str = "embedding", id: str = "vec_id", search: Search = Search()) -> DataFrame:  # noqa: A002, B008
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product, ties to the smaller id.

    Both frames have the columns ``id`` and ``vector``; a query never finds a
    row of its own id.  Rows whose vector is null, empty, or has a null or
    non-finite component take no part, nor do rows without an id; vectors of
    another length than a query's are no candidates of it.  Repeated candidates
    count each; queries that agree in id and vector are one, and those that
    share an id alone are ranked each for itself.  A query with fewer
    candidates gets them all, one with none no row.  Vectors whose products
    might not fit a long are multiplied out exactly, in blocks, with what they
    meet; scores beyond a long are compared exactly (up to 38 digits) and
    returned as the nearest long.  Vectors that are not finite after scaling
    take no part.  Vectors of more than ``most_lengths`` lengths are an error.
    """

    def sound(df: DataFrame) -> DataFrame:
        out = df.select(F.col(f"`{id}`").cast("long").alias("id"), scaled(F.col(f"`{vector}`"), search).alias("v"))
        return out.filter("id IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", lambda x: F.abs(x) < float("inf"))).select("id", F.xxhash64("id", "v").alias("h"), F.size("v").alias("dims"), "v")

    def sizes(df: DataFrame) -> dict[int, tuple[int, float]]:
        found = df.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).limit(search.most_lengths + 1).collect()
        if len(found) > search.most_lengths:
            raise ValueError(f"vectors of more than {search.most_lengths} different lengths")
        return {r["dims"]: (r["n"], r["largest"]) for r in found}

    points, asked = sound(vectors), sound(queries).dropDuplicates(["id", "v"])
    held, wanted = sizes(points), sizes(asked)
    over = [dims for dims, (_, largest) in held.items() if dims in wanted and dims * largest * wanted[dims][1] >= 2.0**62]
    ranked = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    if not over:
        return _shards_searched(points, asked, held, search).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")
    # Of lengths with outliers: what is small enough meets in trees as ever, outliers meet everything in blocks.
    small = F.array_max(F.transform("v", F.abs)) < F.sqrt(F.lit(2.0**61) / F.col("dims"))
    (plain, odd), (plain_asked, odd_asked) = ((df.filter(~F.col("dims").isin(over) | small), df.filter(F.col("dims").isin(over) & ~small)) for df in (points, asked))
    parts = [_shards_searched(plain, plain_asked, sizes(plain), search), _multiplied(odd, asked, search), _multiplied(plain.filter(F.col("dims").isin(over)), odd_asked, search)]
    whole = parts[0].withColumn("score", F.col("score").cast(_WIDE)).unionByName(parts[1]).unionByName(parts[2])
    nearest = F.greatest(F.least("score", F.lit(2**63 - 1).cast(_WIDE)), F.lit(-(2**63)).cast(_WIDE)).cast("long")
    return whole.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", nearest.alias("score"))


#: Scores of outliers: 38 digits, at the ends of which larger ones tie.
_WIDE, _END = "decimal(38,0)", 10**38 - 1


def _exact(points: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block of points for each query of a block, in Python's integers."""
    rows = []
    if len(points) and len(asked):
        table = np.array([[int(x) for x in v] for v in points["v"]], object)
        ids = points["id"].to_numpy()
        for query, h, v in zip(asked["id"], asked["h"], asked["v"]):
            scores = table.dot(np.array([int(x) for x in v], object))
            best = sorted((-max(-_END, min(_END, s)), i) for s, i in zip(scores, ids) if i != query)[:k]
            rows += [(query, h, i, Decimal(-s)) for s, i in best]
    return pd.DataFrame(rows, columns=["query_id", "h", "vec_id", "score"])


def _multiplied(points: DataFrame, asked: DataFrame, search: Search) -> DataFrame:
    """Candidates of all queries among all points of their length, a block of each at a time."""
    many, blocks = max(1, -(-points.count() // search.shard_rows)), max(1, -(-asked.count() // 512))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))

    left, right = dealt(points, "pb", many, "qb", blocks).groupBy("dims", "pb", "qb"), dealt(asked, "qb", blocks, "pb", many).groupBy("dims", "pb", "qb")
    return left.cogroup(right).applyInPandas(lambda p, q: _exact(p, q, search.k), f"query_id long, h long, vec_id long, score {_WIDE}")


def _shards_searched(points: DataFrame, asked: DataFrame, held: dict[int, tuple[int, float]], search: Search) -> DataFrame:
    """(query_id, h, vec_id, score): the candidates that are left for each query once all shards have been searched."""
    spark = points.sparkSession
    # One vector for each of so many ranges of a hash: copies share one, so a hot vector is one pivot.
    most = max(1, min(search.pivots, sum(n for n, _ in held.values()) // search.shard_rows))
    drawn = points.select("dims", "v", F.xxhash64("v").alias("hv")).groupBy(F.pmod("hv", F.lit(most)).alias("part")).agg(F.min_by(F.struct("dims", "v"), "hv").alias("p")).orderBy("part").collect()
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {r["p"]["dims"] for r in drawn}:
        own = [(n, r["p"]["v"]) for n, r in enumerate(drawn) if r["p"]["dims"] == dims]
        pivots[dims] = np.array([n for n, _ in own]), np.array([v for _, v in own], float)
    kept = spark.sparkContext.broadcast(pivots)
    dealt = cut(points.mapInArrow(lambda it: _assign(it, kept.value), "id long, h long, dims int, v array<double>, cell long, away double"))
    # A length without pivots has a cell of its own behind those of the pivots.
    number = F.when(F.col("cell") < 0, F.col("dims") + search.pivots).otherwise(F.col("cell"))
    balls = dealt.groupBy("dims", number.alias("cell")).agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / search.shard_rows).cast("long").alias("shards")).collect()
    cells: dict[int, tuple] = {}
    for dims in {b["dims"] for b in balls}:
        own = [b for b in balls if b["dims"] == dims]
        centre = dict(zip(pivots[dims][0].tolist(), pivots[dims][1])) if dims in pivots else {}
        centres = np.array([centre.get(b["cell"], np.zeros(dims)) for b in own])
        cells[dims] = np.array([b["cell"] for b in own]), centres, np.array([b["radius"] for b in own]), np.array([b["shards"] for b in own])
    table = spark.sparkContext.broadcast(cells)

    split = F.create_map(*[F.lit(x) for b in balls for x in (b["cell"], b["shards"])]) if balls else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    shard = number * (1 << 32) + F.pmod("h", split[number])
    routed, query_type = "shard long, id long, h long, floor long, v array<double>", ["shard", F.lit(1).alias("is_query"), "id", "h", "floor", "v"]
    waiting = asked.withColumn("floor", F.lit(int(_LOWEST)))
    to_pilot = waiting.mapInArrow(lambda it: _route(it, table, True), routed)
    stream = dealt.select(shard.alias("shard"), F.lit(0).alias("is_query"), "id", "h", F.lit(0).cast("long").alias("floor"), "v").unionByName(to_pilot.select(*query_type))
    order = ["shard", "is_query", "id", "h"]
    built = cut(stream.repartition("shard").sortWithinPartitions(*order).mapInArrow(lambda it: _build(it, search), f"{_TREE}, {_FOUND}"))
    seen = built.filter("shard IS NULL").select("query_id", "h", "vec_id", "score")
    floors = seen.groupBy("query_id", "h").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") >= search.k).select(F.col("query_id").alias("id"), "h", "low")
    raised = asked.join(floors, ["id", "h"], "left").select("id", "h", "dims", F.coalesce("low", F.lit(int(_LOWEST))).alias("floor"), "v")
    to_others = raised.mapInArrow(lambda it: _route(it, table, False), routed)
    trees = built.filter("shard IS NOT NULL").select(*[x.split()[0] for x in _TREE.split(", ")])
    both = trees.withColumn("is_query", F.lit(0)).unionByName(to_others.select(*query_type), allowMissingColumns=True)
    found = both.repartition("shard").sortWithinPartitions(*order).mapInArrow(lambda it: _search(it, search), _FOUND)
    # Spark keeps k rows of a query on the map side, so a query's shards never meet in full.
    return seen.unionByName(found)


def oracle_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB SQL of the query over ``embeddings``."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {every} = 0),
s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) <= {k}"""
