"""A Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf; the leaves of a group, in order, form a tree in which each
run of 16 nodes has a node above it, and the groups' roots form one more tree.
A tree is cut into aligned blocks of 16**3 leaves.  A block is one row, its
nodes laid out by splitting the levels in two halves again and again: the
upper half first, then each subtree of the lower half, so a path from a leaf to
the block's root stays within few pieces of any size (cache lines, pages).  The
roots of a tree's blocks are the leaves of its next tier, which is cut and laid
out in the same way, until one block is left.

Places are plain arithmetic (:func:`place`, :func:`places`): nothing points to
a node, and a block that is not full is as large as its nodes.  The same
arithmetic writes the nodes and finds the siblings of a leaf.

Leaves are sorted by range and hashed where they are; only digests and ids are
shuffled.  A task holds one block at a time.  The driver counts tiers (a few,
as each divides the leaves by 4096) and sees no digest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut

#: Nodes in a run, levels of runs in a block, leaves in a block.
FAN, HEIGHT = 16, 3
LEAVES = FAN**HEIGHT


def levels_of(leaves: int) -> int:
    """Levels of a tree of so many leaves, that of the leaves included."""
    levels = 1
    while FAN ** (levels - 1) < leaves:
        levels += 1
    return levels


def nodes_of(leaves: int, levels: int) -> int:
    """Nodes of a tree: every level has a node for each started run of the one below."""
    return sum(-(-leaves // FAN**level) for level in range(levels))


def place(level: int, index: int, leaves: int, levels: int) -> int:
    """Where a node stands in its tree's layout; level 0 has the leaves."""
    at = 0
    while levels > 1:
        low = levels // 2
        unit = FAN ** (low - 1)
        subtrees = -(-leaves // unit)
        top, top_levels = -(-subtrees // FAN), levels - low
        if level >= low:
            level, leaves, levels = level - low, top, top_levels
            continue
        number = index // FAN ** (low - 1 - level)
        at += nodes_of(top, top_levels) + number * nodes_of(unit, low)
        index -= number * FAN ** (low - 1 - level)
        leaves, levels = min(unit, leaves - number * unit), low
    return at + index


@functools.lru_cache(maxsize=64)
def places(leaves: int, levels: int) -> list[np.ndarray]:
    """:func:`place` of all nodes, an array for each level."""
    if levels == 1:
        return [np.arange(leaves)]
    low = levels // 2
    unit = FAN ** (low - 1)
    subtrees = -(-leaves // unit)
    top = places(-(-subtrees // FAN), levels - low)
    size, full, last = sum(map(len, top)), places(unit, low), places(leaves - (subtrees - 1) * unit, low)
    starts = size + np.arange(subtrees) * sum(map(len, full))
    return [np.concatenate([(starts[:-1, None] + a).ravel(), starts[-1] + b]) for a, b in zip(full, last)] + top


def _levels(leaves: int, block: int) -> int:
    """Levels of a block: blocks are full but for a tree's last, and only a tree's first and only block can be lower than others."""
    return levels_of(leaves) if block == 0 else HEIGHT + 1


def laid_out(leaves: list[bytes], levels: int) -> np.ndarray:
    """The nodes above the leaves' digests, hashed run by run and written to their places."""
    at, level = places(len(leaves), levels), b"".join(leaves).hex().encode()
    out = np.empty((nodes_of(len(leaves), levels), 32), np.uint8)
    for k in range(levels):
        if k:
            level = b"".join(sha256(level[a : a + 64 * FAN]).hexdigest().encode() for a in range(0, len(level), 64 * FAN))
        out[at[k]] = np.frombuffer(bytes.fromhex(level.decode()), np.uint8).reshape(-1, 32)
    return out


class Paths:
    """Siblings of a block's leaves: pairs of what stands before and after a node in its run, from the leaf up."""

    def __init__(self, nodes: bytes, leaves: int, levels: int):
        stored = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.levels = [stored[at].tobytes().hex().encode() for at in places(leaves, levels)]

    def step(self, level: int, index: int) -> tuple[bytes, bytes]:
        run, first = self.levels[level], index // FAN * FAN
        return run[64 * first : 64 * index], run[64 * (index + 1) : 64 * (first + FAN)]

    def of(self, index: int, first: int = 0) -> list[tuple[bytes, bytes]]:
        """From level ``first`` on, where the node's number is ``index``."""
        return [self.step(level, index // FAN ** (level - first)) for level in range(first, len(self.levels) - 1)]


def fold(leaf: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give, all as hex text."""
    for before, after in path:
        leaf = sha256(before + leaf + after).hexdigest().encode()
    return leaf


def leaf(*columns: Column) -> Column:
    """The digest of a row's values as hex text: each is its length in bytes, a colon and itself, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their partition and their place among its rows of the same key."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").dictionary_encode()
        codes, names = keys.indices.to_numpy(), keys.dictionary
        edges = np.flatnonzero(np.diff(codes)) + 1
        starts = np.concatenate([[0], edges])
        index = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
        if names[int(codes[0])].as_py() == last:
            index[: starts[1] if len(starts) > 1 else batch.num_rows] += count
        last, count = names[int(codes[-1])].as_py(), int(index[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(index)], names=[*batch.schema.names, "part", "index"])


def _built(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted leaves as blocks, one row each."""
    key, block, parts = None, None, []

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        leaves = whole.column("digest").to_pylist()
        nodes = laid_out(leaves, _levels(len(leaves), block))
        made = {"key": [key], "block": [block], "leaves": [len(leaves)], "nodes": [nodes.tobytes()], "top": [nodes[0].tobytes()], "ids": [whole.column("id").to_pylist()], "others": [whole.column("other").to_pylist()]}
        return pa.RecordBatch.from_pydict(made, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        codes, blocks = batch.column("key").dictionary_encode(), batch.column("block").to_numpy()
        edges = np.flatnonzero((np.diff(codes.indices.to_numpy()) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            own = batch.column("key")[a].as_py(), int(blocks[a])
            if own != (key, block) and parts:
                yield row()
                parts = []
            key, block = own
            parts.append(batch.slice(a, b - a))
    if parts:
        yield row()


_PATH = pa.schema([("key", pa.string()), ("block", pa.int64()), ("id", pa.string()), ("above", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
_PATH_SQL = "key string, block long, id string, above array<string>, subroot string, root string"


def _path_rows(batches: Iterable[pa.RecordBatch], are_trees: bool) -> Iterator[pa.RecordBatch]:
    """Blocks with the paths of their roots: a row for each leaf, which is a block below, or a tree whose root it is."""
    for batch in batches:
        for r in range(batch.num_rows):
            key, block, leaves, nodes, ids, above, subroot, root = (batch.column(c)[r].as_py() for c in ("key", "block", "leaves", "nodes", "ids", "above", "subroot", "root"))
            paths = Paths(nodes, leaves, _levels(leaves, block))
            for a in range(0, leaves, 512):
                own = range(a, min(leaves, a + 512))
                made = [[x.decode() for step in paths.of(i) for x in step] + above for i in own]
                n = len(own)
                columns = {"key": [key] * n, "block": [block * LEAVES + i for i in own], "id": [ids[i] for i in own], "above": made, "subroot": [paths.levels[0][64 * i : 64 * i + 64].decode() if are_trees else subroot for i in own], "root": [root] * n}
                yield pa.RecordBatch.from_pydict(columns, schema=_PATH)


def _proofs(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of rows' leaves with the paths of their roots: each row's leaf, the hash of its siblings and the root it folds to."""
    for batch in batches:
        for r in range(batch.num_rows):
            key, block, leaves, nodes, ids, others, above, subroot, root = (batch.column(c)[r].as_py() for c in ("key", "block", "leaves", "nodes", "ids", "others", "above", "subroot", "root"))
            paths = Paths(nodes, leaves, _levels(leaves, block))
            higher = [(a.encode(), b.encode()) for a, b in zip(above[::2], above[1::2])]
            own, proofs, folded, single = [], [], [], len(paths.levels) == 1
            for i in range(leaves):
                if i % FAN == 0:
                    rest = higher if single else paths.of(i // FAN, 1) + higher
                    tail, known = b"".join(x for step in rest for x in step), {}
                value = paths.levels[0][64 * i : 64 * i + 64]
                before, after = (b"", b"") if single else paths.step(0, i)
                own.append(value.decode())
                proofs.append(sha256(before + after + tail).hexdigest())
                node = fold(value if others[i] is None else others[i].hex().encode(), [] if single else [(before, after)])
                # Leaves of a run that fold to one node fold to one root.
                if node not in known:
                    known[node] = fold(node, rest).decode()
                folded.append(known[node])
            yield pa.RecordBatch.from_pydict({"key": [key] * leaves, "id": ids, "leaf": own, "subroot": [subroot] * leaves, "root": [root] * leaves, "proof_sha256": proofs, "folded_root": folded}, schema=schema)


@dataclass(frozen=True)
class Tree:
    """The tiers of all trees of one kind: (key, block, leaves, nodes, top, ids, others) each; and (key, tier, root) of every tree."""

    tiers: list[DataFrame]
    roots: DataFrame


def _id_type(df: DataFrame) -> str:
    return df.select("id").schema[0].dataType.simpleString()


def _blocks(leaves: DataFrame) -> DataFrame:
    """Blocks of (key, position, digest, id, other)."""
    kind = _id_type(leaves)
    dealt = leaves.select("key", F.expr(f"position div {LEAVES}").alias("block"), "position", "digest", "id", "other").repartition("key", "block").sortWithinPartitions("key", "block", "position")
    kept = dealt.select("key", "block", "digest", "id", "other")
    of_id = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("leaves", pa.int64()), ("nodes", pa.binary()), ("top", pa.binary()), ("ids", pa.list_(of_id)), ("others", pa.list_(pa.binary()))])
    return cut(kept.mapInArrow(lambda it: _built(it, schema), f"key string, block long, leaves long, nodes binary, top binary, ids array<{kind}>, others array<binary>"))


def trees(leaves: DataFrame) -> Tree:
    """All trees over (key, id, digest, other): leaves of a key in order of id, a null first, then of digest.

    Each leaf's place needs the number of its key's leaves in earlier
    partitions; only a partition's first key can have any, so that table has no
    more rows than there are partitions.
    """
    columns = f"key string, id {_id_type(leaves)}, digest binary, other binary"
    ordered = leaves.select("key", "id", "digest", "other").repartitionByRange("key", "id", "digest").sortWithinPartitions("key", "id", "digest")
    sorted_ = cut(ordered.mapInArrow(_numbered, f"{columns}, part long, index long"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sorted_.groupBy("key", "part").agg((F.max("index") + 1).alias("n")).withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("key", "part", "before")
    placed = sorted_.join(F.broadcast(before), ["key", "part"], "left").withColumn("position", F.col("index") + F.coalesce("before", F.lit(0)))
    tiers, roots = [_blocks(placed)], []
    while True:
        blocks = tiers[-1]
        # Blocks are filled in order, so a tree that has not ended has a second one.
        many = blocks.filter("block = 1").select("key")
        ended = blocks.filter("block = 0").join(many, "key", "left_anti")
        roots.append(ended.select("key", F.lit(len(tiers) - 1).alias("tier"), "top"))
        if many.isEmpty():
            break
        nothing = F.lit(None).cast("binary").alias("other")
        tiers.append(_blocks(blocks.join(many, "key", "left_semi").select("key", F.col("block").alias("position"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("id"), nothing)))
    return Tree(tiers, functools.reduce(DataFrame.unionByName, roots))


def _below(tree: Tree, seeds: DataFrame) -> DataFrame:
    """(key, block, above, subroot, root) of the lowest blocks; ``seeds`` has (key, above, subroot, root) of the trees' own roots."""
    paths = None
    for tier in range(len(tree.tiers) - 1, -1, -1):
        own = seeds.join(tree.roots.filter(F.col("tier") == tier).select("key"), "key").select("key", F.lit(0).cast("long").alias("block"), "above", "subroot", "root")
        above = own if paths is None else own.unionByName(paths)
        if tier == 0:
            return above
        met = tree.tiers[tier].join(above, ["key", "block"])
        paths = met.mapInArrow(lambda it: _path_rows(it, False), _PATH_SQL).drop("id")


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups and the tree of their roots."""

    groups: Tree
    top: Tree

    def root(self) -> DataFrame:
        """(root) in hex; no row if the manifest is of no rows."""
        return self.top.roots.select(F.lower(F.hex("top")).alias("root"))

    def write(self, path: str) -> None:
        """Parquet tables ``blocks`` (tree, tier, key, block, leaves, nodes, ids) and ``roots`` (key, tier, root)."""
        for kind, tree in (("groups", self.groups), ("top", self.top)):
            for tier, blocks in enumerate(tree.tiers):
                blocks.select("key", "block", "leaves", "nodes", F.col("ids").cast("array<string>")).write.mode("overwrite").parquet(f"{path}/blocks/tree={kind}/tier={tier}")
            tree.roots.withColumn("root", F.lower(F.hex("top"))).drop("top").write.mode("overwrite").parquet(f"{path}/roots/tree={kind}")


def manifest(leaves: DataFrame) -> Manifest:
    """A manifest of (key, id, digest, other): a tree for each key, and one of the keys' roots in order of the keys."""
    groups = trees(leaves)
    return Manifest(groups, trees(groups.roots.select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("top").alias("digest"), F.lit(None).cast("binary").alias("other"))))


def group_key(group: Column) -> Column:
    """A key for a group's name, in order of its bytes, a null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def prove(made: Manifest) -> DataFrame:
    """(key, id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``proof_sha256`` hashes the leaf's siblings in the manifest, level by level
    to the root; ``folded_root`` is what they and the leaf give, or ``other``
    where a leaf came with one; ``verified`` says whether that is the root.
    """
    root = made.top.roots.select("key", F.array().cast("array<string>").alias("above"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("top")).alias("root"))
    kind = _id_type(made.groups.tiers[0].select(F.explode("ids").alias("id")))
    over = made.top.tiers[0].join(_below(made.top, root), ["key", "block"])
    seeds = cut(over.mapInArrow(lambda it: _path_rows(it, True), _PATH_SQL).select(F.col("id").alias("key"), "above", "subroot", "root"))
    lowest = made.groups.tiers[0].join(_below(made.groups, seeds), ["key", "block"])
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("key", pa.string()), ("id", pa.string() if kind == "string" else pa.int64()), *((c, pa.string()) for c in texts)])
    proofs = lowest.select("key", "block", "leaves", "nodes", "ids", "others", "above", "subroot", "root").mapInArrow(lambda it: _proofs(it, schema), f"key string, id {kind}, " + ", ".join(f"{c} string" for c in texts))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def lookup(spark: SparkSession, path: str, tree: str, key: str, position: int) -> list[tuple[bytes, bytes]]:
    """The path of one leaf of a written manifest, up to its tree's root: a block is read for each tier, and a run's siblings found by their places."""
    out, tier = [], 0
    while True:
        block = position // LEAVES
        row = spark.read.parquet(f"{path}/blocks/tree={tree}/tier={tier}").filter((F.col("key") == key) & (F.col("block") == block)).select("leaves", "nodes").first()
        if row is None:
            raise KeyError((tree, key, position))
        leaves, levels, index = row["leaves"], _levels(row["leaves"], block), position % LEAVES
        for level in range(levels - 1):
            first, many = index // FAN * FAN, -(-leaves // FAN**level)
            run = [bytes(row["nodes"][32 * p : 32 * p + 32]).hex().encode() for p in (place(level, i, leaves, levels) for i in range(first, min(many, first + FAN)))]
            out.append((b"".join(run[: index - first]), b"".join(run[index - first + 1 :])))
            index //= FAN
        ended = spark.read.parquet(f"{path}/roots/tree={tree}").filter((F.col("key") == key) & (F.col("tier") == tier))
        if not ended.isEmpty():
            return out
        position, tier = block, tier + 1


def prove_rows(rows: DataFrame, columns: list[str], *, id: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:  # noqa: A002, B008
    """A manifest of a table's rows, and each row's proof, held against the row as ``changed`` where ``where`` is true.

    Returns (``id``, ``group``, leaf, subroot, root, proof_sha256, folded_root,
    verified), a row for each row.  ``id`` is a whole number or a string.  A
    row's leaf covers ``columns``; null, empty and very long values differ.
    Groups are in order of their names' bytes, null first; rows of a group in
    order of id, null first, and rows that share an id in order of their
    digests; repeated rows are leaves of their own.  Other columns are left
    out.  An empty table gives an empty one, and has no root.
    """
    given = [F.col(f"`{c}`") for c in columns]
    digest = F.unhex(leaf(*given))
    later = F.unhex(leaf(*((changed or {}).get(c, col) for c, col in zip(columns, given))))
    name = F.col(f"`{id}`")
    name = name.cast("string") if rows.select(name).schema[0].dataType.simpleString() == "string" else name.cast("long")
    leaves = cut(rows.select(group_key(F.col(f"`{group}`")).alias("key"), name.alias("id"), digest.alias("digest"), F.when(where if where is not None else F.lit(False), later).alias("other")))
    out = prove(manifest(leaves))
    return out.select(F.col("id").alias(id), F.when(F.col("key") != "-", F.expr("substr(key, 2)")).alias(group), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampering() -> tuple[dict[str, Column], Column]:
    """Lower-cased texts, for ids whose checksum 5 divides."""
    return {"text": F.translate("text", _UPPER, _LOWER)}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def oracle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """DuckDB SQL of the query over ``documents``, for sources of at most 16**levels rows and 16**top_levels sources."""

    def encoded(text: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + "))"

    checksum = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    steps = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS key, {encoded('text')} AS leaf, CASE WHEN {checksum} % 5 = 0 THEN {encoded(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents)",
        "d0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves)",
        "g0 AS (SELECT key, p, leaf AS h FROM d0)",
    ]

    def climb(g: str, f: str, count: int, fold_from: str) -> str:
        """Levels of all trees of g, and the folding of the rows of f along them."""
        for k in range(count):
            # A run of the level: its digests in order; a tree of one node stays as it is.
            steps.append(f"{g}r{k} AS (SELECT key, p // 16 AS r, list(h ORDER BY p) AS hs, (SELECT count(*) FROM {g}{k} AS o WHERE o.key = {g}{k}.key) = 1 AS over FROM {g}{k} GROUP BY ALL)")
            steps.append(f"{g}{k + 1} AS (SELECT key, r AS p, CASE WHEN over THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {g}r{k})")
            at = f"{fold_from}.p % 16"
            steps.append(
                f"{f}{k} AS (SELECT {fold_from}.* EXCLUDE (p, sibs, node), r AS p, sibs || CASE WHEN over THEN '' ELSE array_to_string(hs[1:{at}], '') || array_to_string(hs[{at} + 2:], '') END AS sibs,"
                f" CASE WHEN over THEN node ELSE sha256(array_to_string(hs[1:{at}], '') || node || array_to_string(hs[{at} + 2:], '')) END AS node"
                f" FROM {fold_from} JOIN {g}r{k} AS t ON t.key = {fold_from}.key AND t.r = {fold_from}.p // 16)"
            )
            fold_from = f"{f}{k}"
        return fold_from

    steps.append("f AS (SELECT doc_id, key, leaf, p, '' AS sibs, coalesce(other, leaf) AS node FROM d0)")
    last = climb("g", "f", levels, "f")
    steps.append(f"s0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS p, h, key AS name FROM g{levels})")
    steps.append(f"u AS (SELECT '' AS key, d.doc_id, d.key AS name, d.leaf, s.h AS subroot, s.p AS p, d.sibs, d.node FROM {last} AS d JOIN s0 AS s ON s.name = d.key)")
    last = climb("s", "u", top_levels, "u")
    return "WITH " + ",\n".join(steps) + f"\nSELECT d.doc_id, CASE WHEN name <> '-' THEN substr(name, 2) END AS source, leaf, subroot, t.h AS root, sha256(sibs) AS proof_sha256, node AS folded_root, node = t.h AS verified FROM {last} AS d JOIN s{top_levels} AS t USING (key)"
