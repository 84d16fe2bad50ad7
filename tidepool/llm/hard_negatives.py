"""Hard negatives by segment summaries.

A vector is cut into segments, and of each segment the mean and the deviation
(the length of what is left without the mean) are stored.  The inner product of
two vectors lies within ``sum(n * mean * mean')`` plus or minus
``sum(deviation * deviation')``.  These bounds are taken with one segment
first, then with more and more of them, each time for the pairs that are left;
only pairs that no summary could rule out are multiplied out.

Rows lie in shards of bounded size, in order of label and mean.  Anchors travel
in blocks to the shards that hold their label, for their positives, and then,
with what their positives ask for, to the shards whose own summary (ranges of
means, greatest deviations) does not rule them out.  A task holds one shard and
one block.  The best so many of every anchor and positive are kept in each
task, so little is left to be merged.

Scores are exact: integers in doubles while these are exact, Python's integers
beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.knn import scaled
from tidepool.plans.lineage import cut

#: Scores of more digits are held at the ends of this range, where they tie.
_DIGITS = 38
_END = 10**_DIGITS - 1
_SCORE = pa.decimal128(_DIGITS, 0)


@dataclass(frozen=True)
class Mining:
    """``segments``: how many there are in each round of bounds.  ``shard_rows``, ``block_rows``: what a task holds of rows and of anchors.

    The table of shards, which goes to every task, has at most ``most_shards``
    rows, and one more for each length of vectors; a larger table gets larger
    shards.
    """

    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    most_percent: int = 100
    scale: int = 256
    segments: tuple[int, ...] = (1, 4, 16)
    shard_rows: int = 8192
    block_rows: int = 256
    most_shards: int = 65536


class Summary:
    """Vectors with the means and deviations of their segments, for each number of segments."""

    def __init__(self, points: np.ndarray, segments: tuple[int, ...]):
        self.points, dims = points, points.shape[1]
        self.largest = float(np.abs(points).max(initial=0))
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for count in dict.fromkeys(min(s, dims) for s in segments):
            edges = np.linspace(0, dims, count + 1).astype(int)
            sizes = np.diff(edges)
            means = np.add.reduceat(points, edges[:-1], axis=1) / sizes
            rest = points - np.repeat(means, sizes, axis=1)
            self.rounds.append((sizes, means, np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))))


def _slack(centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Bounds are this much wider, for rounding."""
    return spread * (1 + 1e-9) + np.abs(centre) * 1e-9 + 1


def bounds(a: Summary, b: Summary, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every row of ``a`` with every row of ``b``, by a round's summaries."""
    (sizes, means, deviations), (_, others, rest) = a.rounds[number], b.rounds[number]
    centre = (means * sizes) @ others.T
    spread = _slack(centre, deviations @ rest.T)
    return centre - spread, centre + spread


def pair_bounds(a: Summary, b: Summary, number: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of rows."""
    (sizes, means, deviations), (_, others, rest) = a.rounds[number], b.rounds[number]
    centre = np.einsum("ij,ij->i", means[rows] * sizes, others[columns])
    spread = _slack(centre, np.einsum("ij,ij->i", deviations[rows], rest[columns]))
    return centre - spread, centre + spread


def _scores(a: Summary, b: Summary, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs: 64-bit integers, or Python's where these might not do."""
    if a.largest * b.largest * a.points.shape[1] < 2.0**52:
        parts = [np.einsum("ij,ij->i", a.points[rows[i : i + 65536]], b.points[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)]
        return np.concatenate([np.zeros(0), *parts]).astype(np.int64)
    whole = lambda points: [[int(x) for x in p] for p in points.tolist()]
    out = np.zeros(len(rows), object)
    for i in range(0, len(rows), 4096):
        for n, (p, q) in enumerate(zip(whole(a.points[rows[i : i + 4096]]), whole(b.points[columns[i : i + 4096]]))):
            out[i + n] = max(-_END, min(_END, sum(x * y for x, y in zip(p, q))))
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th greatest value, or -inf if it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


#: Bounds of fewer pairs than this share of all are taken pair by pair.
_DENSE = 0.05


def search(a: Summary, b: Summary, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all pairs that may be among the k best of a row within one of its bands.

    ``low`` and ``high``: a row's bands; a band whose low end is above its high end holds nothing.
    """
    bands, floors = low.shape[1], low - 1e-9 * np.abs(low)
    ceilings = high + 1e-9 * np.abs(high)
    alive = allowed & (low <= high).any(1)[:, None]
    for number in range(len(a.rounds)):
        if alive.mean() > _DENSE:
            least, most = bounds(a, b, number)
        else:
            rows, columns = np.nonzero(alive)
            least, most = np.full(alive.shape, -np.inf), np.full(alive.shape, -np.inf)
            least[rows, columns], most[rows, columns] = pair_bounds(a, b, number, rows, columns)
        some = np.zeros_like(alive)
        for p in range(bands):
            # What lies within a band for certain, k times over, rules out what lies below it for certain.
            inside = alive & (least >= low[:, p, None]) & (most <= high[:, p, None])
            if inside.any():
                floors[:, p] = np.maximum(floors[:, p], _kth(np.where(inside, least, -np.inf), k))
            some |= (most >= floors[:, p, None]) & (least <= ceilings[:, p, None]) & (low <= high)[:, p, None]
        alive &= some
    return np.nonzero(alive)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k greatest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows)) if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), np.int64)
    if not len(order):
        return order
    starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    within = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[within < k]


def _decimals(scores: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(s)) for s in scores], _SCORE) if scores.dtype == object else pa.array(scores).cast(_SCORE)


_PACK = pa.schema([("number", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("hs", pa.binary()), ("labels", pa.binary()), ("points", pa.binary()), ("positive_ids", pa.list_(pa.list_(pa.int64()))), ("positive_scores", pa.list_(pa.list_(_SCORE)))])
_PACK_SQL = f"number long, dims int, ids binary, hs binary, labels binary, points binary, positive_ids array<array<long>>, positive_scores array<array<decimal({_DIGITS},0)>>"


def _packed(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows, up to ``most`` of one length in a row."""
    base, parts, held, size, made = TaskContext.get().partitionId() << 20, [], 0, None, 0

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        numbers = [whole.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "h", "label")]
        points = pa.concat_arrays([p.column("v").flatten() for p in parts]).to_numpy(zero_copy_only=False).astype(np.float64)
        asked = [[whole.column(c).to_pylist()] for c in ("positive_ids", "positive_scores")]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[base + made], [size], *[[n] for n in numbers], [points.tobytes()], *asked], _PACK)], schema=_PACK)

    for batch in batches:
        dims, at = batch.column("dims").to_numpy(), 0
        while at < batch.num_rows:
            if held == most or (held and dims[at] != size):
                yield row()
                parts, held, made = [], 0, made + 1
            size = int(dims[at])
            other = np.flatnonzero(dims[at:] != size)
            end = min(batch.num_rows, at + most - held, at + int(other[0]) if len(other) else batch.num_rows)
            parts.append(batch.slice(at, end - at))
            held += end - at
            at = end
    if held:
        yield row()


@dataclass
class Pack:
    """A shard, or a block of anchors."""

    ids: np.ndarray
    hs: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    positive_ids: list
    positive_scores: list

    @staticmethod
    def read(batch: pa.RecordBatch, row: int) -> Pack:
        ids, hs, labels = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("ids", "hs", "labels"))
        points = np.frombuffer(batch.column("points")[row].as_buffer(), np.float64).reshape(len(ids), -1)
        return Pack(ids, hs, labels, points, *(batch.column(c)[row].as_py() for c in ("positive_ids", "positive_scores")))


def _ranges(batches: Iterable[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Of each shard: its range of labels, the ranges of its segments' means, and their greatest deviations."""
    for batch in batches:
        for r in range(batch.num_rows):
            own = Pack.read(batch, r)
            _, means, deviations = Summary(own.points, (segments,)).rounds[0]
            made = [batch.column("number")[r].as_py(), batch.column("dims")[r].as_py(), int(own.labels.min()), int(own.labels.max()), means.min(0).tolist(), means.max(0).tolist(), deviations.max(0).tolist()]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(made, kinds)], names=["number", "dims", "first", "last", "lows", "highs", "deviations"])


def _routed(batches: Iterable[pa.RecordBatch], table, mining: Mining) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors for each shard that may answer some of them: those of their label, or, once they have positives, those within their bands."""
    for batch in batches:
        for r in range(batch.num_rows):
            dims, block = batch.column("dims")[r].as_py(), Pack.read(batch, r)
            if dims not in table.value:
                continue
            numbers, first, last, lows, highs, deviations = table.value[dims]
            if block.positive_ids[0] is None:
                meets = (block.labels[:, None] >= first) & (block.labels[:, None] <= last)
            else:
                sizes, means, own = Summary(block.points, (mining.segments[min(1, len(mining.segments) - 1)],)).rounds[0]
                weighed, (low, high) = means * sizes, _bands(block.positive_scores, mining)
                rising, falling = np.maximum(weighed, 0), np.minimum(weighed, 0)
                spread = own @ deviations.T
                most, least = rising @ highs.T + falling @ lows.T, rising @ lows.T + falling @ highs.T
                most, least = most + _slack(most, spread), least - _slack(least, spread)
                low, high = (np.where(low <= high, x, y) for x, y in ((low, np.inf), (high, -np.inf)))
                meets = (most >= low.min(1)[:, None] * (1 - 1e-9 * np.sign(low.min(1)[:, None]))) & (least <= high.max(1)[:, None] * (1 + 1e-9 * np.sign(high.max(1)[:, None])))
            for s in np.flatnonzero(meets.any(0)):
                at = np.flatnonzero(meets[:, s])
                parts = [[int(numbers[s])], [dims], *([x[at].tobytes()] for x in (block.ids, block.hs, block.labels, block.points)), *([[x[i] for i in at]] for x in (block.positive_ids, block.positive_scores))]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(parts, _PACK)], schema=_PACK)


def _bands(scores: list, mining: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Ends of each anchor's bands; missing positives have none."""
    low, high = np.full((len(scores), mining.positives), np.inf), np.full((len(scores), mining.positives), -np.inf)
    for i, own in enumerate(scores):
        for p, score in enumerate(own):
            low[i, p], high[i, p] = float(score) * mining.least_percent / 100, float(score) * mining.most_percent / 100
    return low, high


_FOUND = pa.schema([("anchor_id", pa.int64()), ("h", pa.int64()), ("positive", pa.int32()), ("positive_id", pa.int64()), ("positive_score", _SCORE), ("id", pa.int64()), ("score", _SCORE)])
_FOUND_SQL = f"anchor_id long, h long, positive int, positive_id long, positive_score decimal({_DIGITS},0), id long, score decimal({_DIGITS},0)"


def _met(batches: Iterable[pa.RecordBatch], mining: Mining) -> Iterator[pa.RecordBatch]:
    """Rows by shard, the shard before its blocks: the best of each anchor, or of each of its positives."""
    shard, summary, number = None, None, None
    for batch in batches:
        for r in range(batch.num_rows):
            own = Pack.read(batch, r)
            if not batch.column("is_block")[r].as_py():
                number, shard, summary = batch.column("number")[r].as_py(), own, Summary(own.points, mining.segments)
                continue
            if number != batch.column("number")[r].as_py():
                continue
            asked = Summary(own.points, mining.segments)
            allowed = own.ids[:, None] != shard.ids
            if own.positive_ids[0] is None:
                everything = np.full((len(own.ids), 1), np.inf)
                rows, columns = search(asked, summary, allowed & (own.labels[:, None] == shard.labels), -everything, everything, mining.positives)
                scores = _scores(asked, summary, rows, columns)
                at = _best(rows, shard.ids[columns], scores, mining.positives)
                nothing = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[rows[at]]), pa.array(own.hs[rows[at]]), nothing.cast(pa.int32()), nothing, nothing.cast(_SCORE), pa.array(shard.ids[columns[at]]), _decimals(scores[at])], schema=_FOUND)
                continue
            low, high = _bands(own.positive_scores, mining)
            rows, columns = search(asked, summary, allowed & (own.labels[:, None] != shard.labels), low, high, mining.negatives)
            scores = _scores(asked, summary, rows, columns)
            for p in range(mining.positives):
                wanted = np.array([int(s[p]) if p < len(s) else 0 for s in own.positive_scores], object)
                wanted, given = (wanted.astype(np.int64), scores) if scores.dtype != object and max(map(abs, wanted)) < 2**55 else (wanted, scores.astype(object))
                has = np.array([p < len(s) for s in own.positive_scores])
                hundred = given * 100
                inside = np.flatnonzero((has[rows] & (wanted[rows] * mining.least_percent <= hundred) & (hundred <= wanted[rows] * mining.most_percent)).astype(bool))
                at = inside[_best(rows[inside], shard.ids[columns[inside]], scores[inside], mining.negatives)]
                if len(at):
                    whose = rows[at]
                    parts = [pa.array(own.ids[whose]), pa.array(own.hs[whose]), pa.array(np.full(len(at), p, np.int32)), pa.array([own.positive_ids[i][p] for i in whose], pa.int64()), pa.array([own.positive_scores[i][p] for i in whose], _SCORE), pa.array(shard.ids[columns[at]]), _decimals(scores[at])]
                    yield pa.RecordBatch.from_arrays(parts, schema=_FOUND)


def _long(score: str) -> Column:
    """A score as a long; what does not fit is held at the ends."""
    return F.greatest(F.least(F.col(score), F.lit(2**63 - 1).cast(f"decimal({_DIGITS},0)")), F.lit(-(2**63)).cast(f"decimal({_DIGITS},0)")).cast("long").alias(score)


def mine(vectors: DataFrame, anchors: Column, *, vector: str = "embedding", id: str = "vec_id", label: str | Column = "label", mining: Mining = Mining()) -> DataFrame:  # noqa: A002, B008
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` is true.

    A score is the inner product with the anchor, of components floor(scale *
    x).  An anchor's positives are its best rows of the same label; a
    positive's negatives are the best rows of other labels whose score is
    between ``least_percent`` and ``most_percent`` hundredths of the
    positive's.  Ties go to the smaller id; fewer rows are returned where there
    are fewer.  A positive of a negative score has no negatives, as its band is
    empty.

    Rows without an id, a label or a vector take no part, nor do those whose
    vector is empty or has a null or non-finite component, before or after
    scaling; vectors of another length than the anchor's do not meet it.  Rows
    of an anchor's own id are neither its positives nor its negatives.  Repeated
    rows count each; anchors that agree in id, label and vector are one, those
    that share an id alone are mined each for itself.  Labels are whole
    numbers.  Scores that do not fit a long are compared exactly (up to 38
    digits) and returned as the nearest long.  Other columns are left out.  An
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    of_label = F.col(f"`{label}`") if isinstance(label, str) else label
    given = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), of_label.cast("long").alias("label"), scaled(F.col(f"`{vector}`"), mining).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    sound = given.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", lambda x: F.abs(x) < float("inf")))
    rows = sound.select("id", "label", "v", "is_anchor", F.size("v").alias("dims"), F.xxhash64("id", "label", "v").alias("h"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("sum"))
    nothing = {"positive_ids": F.lit(None).cast("array<long>"), "positive_scores": F.lit(None).cast(f"array<decimal({_DIGITS},0)>")}
    count = vectors.count()
    shard_rows = max(mining.shard_rows, -(-count // mining.most_shards))

    def packed(df: DataFrame, most: int, parts: int) -> DataFrame:
        order = ["dims", "label", "sum", "id"]
        ordered = df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).select("id", "h", "label", "dims", "v", "positive_ids", "positive_scores")
        return cut(ordered.mapInArrow(lambda it: _packed(it, most), _PACK_SQL))

    shards = packed(rows.withColumns(nothing), shard_rows, -(-count // shard_rows))
    asked = cut(rows.filter("is_anchor").dropDuplicates(["id", "label", "v"]).drop("is_anchor"))
    parts = -(-asked.count() // mining.block_rows)
    middle = mining.segments[min(1, len(mining.segments) - 1)]
    found = shards.mapInArrow(lambda it: _ranges(it, middle), "number long, dims int, first long, last long, lows array<double>, highs array<double>, deviations array<double>").limit(2 * mining.most_shards + 1).collect()
    if len(found) > 2 * mining.most_shards:
        raise ValueError(f"vectors of more than {mining.most_shards} different lengths")
    table: dict[int, tuple[np.ndarray, ...]] = {}
    for dims in {f["dims"] for f in found}:
        own = [f for f in found if f["dims"] == dims]
        table[dims] = tuple(np.array([f[c] for f in own]) for c in ("number", "first", "last", "lows", "highs", "deviations"))
    kept = spark.sparkContext.broadcast(table)

    def met(blocks: DataFrame) -> DataFrame:
        routed = blocks.mapInArrow(lambda it: _routed(it, kept, mining), _PACK_SQL).withColumn("is_block", F.lit(True))
        both = shards.withColumn("is_block", F.lit(False)).unionByName(routed)
        return both.repartition("number").sortWithinPartitions("number", "is_block").mapInArrow(lambda it: _met(it, mining), _FOUND_SQL)

    best = Window.partitionBy("anchor_id", "h").orderBy(F.desc("score"), "id")
    near = met(packed(asked.withColumns(nothing), mining.block_rows, parts)).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= mining.positives)
    listed = near.groupBy("anchor_id", "h").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("p")).select(F.col("anchor_id").alias("id"), "h", F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    hard = met(packed(asked.join(listed, ["id", "h"]), mining.block_rows, parts))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "h", "positive").orderBy(F.desc("score"), "id"))
    ranked = hard.withColumn("rank", rank).filter(F.col("rank") <= mining.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), _long("positive_score"), _long("score").alias("negative_score"))


def label_of() -> Column:
    """The labels of the query: those of ids that 7 divides go on by one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle_sql(positives: int = 5, negatives: int = 5, every: int = 100, scale: int = 256) -> str:
    """DuckDB SQL of the query over ``embeddings``."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id % {every} = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, a.e, c.vec_id AS id, c.label, list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, e, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, own, e ORDER BY score DESC, id) AS n, own FROM s WHERE own = label QUALIFY n <= {positives})
SELECT s.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.e = p.e AND s.label <> s.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY s.anchor_id, s.own, s.e, n ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= {negatives}"""
