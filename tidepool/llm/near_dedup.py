"""Near duplicates by SetSketch: exponentially spaced truncated minima.

Each document's set of word shingles is summarised by one-byte registers: the
minimum of an exponential hash over the set, on a logarithmic scale of base
``base``, truncated to the register's range.  Registers merge by maximum and
two sets agree in a register with a probability a little above their Jaccard
similarity, so bands of registers serve as keys for candidates; the order of
two sketches' registers and the known set sizes give the similarity's joint
likelihood, whose maximum rules out what is far below the threshold.  What
remains is verified on the full sets.

Documents of equal sets form one class from the start, which costs a grouping
whatever its size.  Class representatives meet in band buckets.  First each
member is held against its bucket's centre only, so a bucket of n costs n pairs
and big groups of near copies join up; then members of one bucket that have
different labels are compared with each other, block by block, and a pair that
the likelihood does not rule out is verified there, on the full sets, unless
verified links have joined its ends meanwhile.  Only links leave a block; no
pair is ever made between documents known to be connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import _text
from tidepool.llm._sql import shielded
from tidepool.plans.lineage import cut
from tidepool.operators.components import components, large_star, salted_join, small_star, tidy

U = np.uint64


@dataclass(frozen=True)
class Sketching:
    """``bands`` x ``rows`` registers of one byte.

    A link at the threshold shares no band with probability
    (1 - threshold ** rows) ** bands: 2.5e-7 for 50 bands of 6 at 0.8.
    ``slack`` is how many standard errors below the threshold an estimate may
    be before its pair is ruled out; ``block`` bounds the members compared in one go.
    """

    words: int = 4
    percent: int = 80
    bands: int = 50
    rows: int = 6
    base: float = 1.2
    rate: float = 20.0
    slack: float = 5.0
    block: int = 1024

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def cut(self) -> float:
        p = self.percent / 100
        return p - self.slack * (p * (1 - p) / self.registers) ** 0.5


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(771)).integers(0, 2**63, n, dtype=U) * U(2) + U(1)


def sketch(sets: _text.Words, how: Sketching) -> np.ndarray:
    """Registers of each row's set (rows x registers, uint8); those of an empty set are 0."""
    sizes = np.diff(sets.offsets)
    full = np.flatnonzero(sizes)
    least = np.full((how.registers, len(sizes)), 2**64 - 1, U)
    at = 0
    while at < len(full):
        # Rows enough for the scratch arrays to stay in cache.
        first = sets.offsets[full[at]]
        end = max(at + 1, int(np.searchsorted(sets.offsets[full + 1], first + 65536, "right")))
        rows = full[at:end]
        part, starts = sets.hashes[first : sets.offsets[rows[-1] + 1]], sets.offsets[rows] - first
        for k, factor in enumerate(_multipliers(how.registers)):
            least[k, rows] = np.minimum.reduceat(part * factor, starts)
        at = end
    # The least of n uniform hashes becomes the least of n exponential ones.
    exponential = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / how.rate
    level = np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(how.base))
    out = np.clip(level, 0, 255).astype(np.uint8).T
    out[sizes == 0] = 0
    return np.ascontiguousarray(out)


def likely_similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, base: float) -> np.ndarray:
    """Similarity of greatest joint likelihood for pairs of sketches with known set sizes."""
    above, below = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - above - below
    u, v = nx / (nx + ny), ny / (nx + ny)
    scale = (base - 1) / base

    def chance(z: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(z, 0, 1) * scale) / np.log(base)

    def value(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        return above * np.log(p + 1e-12) + below * np.log(q + 1e-12) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(24):
        a, b = high - golden * (high - low), low + golden * (high - low)
        better = value(a) < value(b)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def _shingles(column: pa.Array, words: int, table: int = 0) -> _text.Words:
    return _text.ngrams(_text.word_hashes(column, table=table), words, whole_if_short=True)


def _sets(column: pa.Array, words: int) -> _text.Words:
    return _text.distinct(_shingles(column, words))


def _sketch_batches(batches: Iterable[pa.RecordBatch], text: str, how: Sketching) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)))
        at = 0
        while at < batch.num_rows:
            # Some MB of text at a time, a text at least.
            last = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 23), "right"))), at + 1000)
            part, at = batch.slice(at, last - at), last
            # Equal sets are told by two independent hashes of every word.
            sets, others = _text.distinct(_shingles(part.column(text), how.words, 0), _shingles(part.column(text), how.words, 1).hashes)
            sizes = np.diff(sets.offsets)
            prints = []
            for hashes in (sets.hashes, others.hashes):
                sums = np.concatenate([np.zeros(1, U), np.cumsum(_text.mix(hashes), dtype=U)])
                prints.append(pa.array((sums[sets.offsets[1:]] - sums[sets.offsets[:-1]]).view(np.int64)))
            registers = sketch(sets, how)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(how.registers), part.num_rows, [None, pa.py_buffer(registers.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.array(sizes), *prints, packed], names=["doc", "th", "n", "f", "g", "registers"])


def _band_batches(batches: Iterable[pa.RecordBatch], how: Sketching) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _band_keys(_unpack(batch.column("registers"), how), how)
        rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), how.bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep)], names=["bucket", "rep"])


def _unpack(column: pa.Array, how: Sketching) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), how.registers)


def _likely_batches(batches: Iterable[pa.RecordBatch], how: Sketching) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sketches, those that may reach the threshold."""
    for batch in batches:
        if batch.num_rows:
            x, y = _unpack(batch.column("ra"), how), _unpack(batch.column("rb"), how)
            nx, ny = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = likely_similarity(x, y, nx, ny, how.base) >= how.cut
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = _common(p, q)
    return bool(common) and 100 * common >= percent * (len(p) + len(q) - common)


def _alike_in_words(pair: pa.Array, how: Sketching) -> bool:
    """The same for two texts, on the words themselves."""
    ids, offsets = _text.shingle_ids(pair, how.words)
    return _alike(ids[: offsets[1]], ids[offsets[1] :], how.percent)


def _band_keys(registers: np.ndarray, how: Sketching) -> np.ndarray:
    """A 64-bit key of every band of every sketch; the lowest byte is the band's number."""
    keys = np.broadcast_to(np.arange(1, how.bands + 1, dtype=U), (len(registers), how.bands))
    for k in range(how.rows):
        keys = _text.mix(keys * U(0x9E3779B97F4A7C15) + registers[:, k :: how.rows])
    return (keys & ~U(255)) | np.arange(how.bands, dtype=U)


def _likely_in_block(rows: dict[str, np.ndarray], part: pa.Table, how: Sketching) -> tuple[np.ndarray, np.ndarray]:
    """Places of the likely pairs between the labels that meet in one bucket's block, likelier pairs first.

    A pair is looked at in the bucket of the first band that it shares, and in one block only.
    """
    none = np.zeros(0, np.int64)
    sizes, labels, band = rows["n"], rows["comp"], int(rows["band"][0])
    # Sets of very different size cannot reach the threshold.
    open_pairs = (labels[:, None] != labels[None, :]) & (how.percent * sizes[:, None] <= 100 * sizes[None, :]) & (how.percent * sizes[None, :] <= 100 * sizes[:, None])
    open_pairs &= np.tri(len(sizes), k=-1, dtype=bool)
    if rows["bi"][0] != rows["bj"][0]:
        open_pairs &= rows["block"][:, None] != rows["block"][None, :]
    if not open_pairs.any():
        return none, none
    regs = _unpack(part.column("registers").combine_chunks(), how)
    keys = _band_keys(regs, how)
    for k in range(band):
        open_pairs &= keys[:, k][:, None] != keys[:, k][None, :]
    i, j = np.nonzero(open_pairs)
    # More registers agree than the similarity says, so their share rules out safely and cheaply.
    likely = [np.flatnonzero((regs[i[at : at + 8192]] == regs[j[at : at + 8192]]).mean(1) >= how.cut) + at for at in range(0, len(i), 8192)]
    likely = np.concatenate(likely) if likely else none
    i, j = i[likely], j[likely]
    if not len(i):
        return none, none
    est = likely_similarity(regs[i], regs[j], sizes[i].astype(float), sizes[j].astype(float), how.base)
    keep = np.flatnonzero(est >= how.cut)
    keep = keep[np.argsort(-est[keep], kind="stable")]
    return i[keep], j[keep]


def _involved(rows: dict[str, np.ndarray], part: pa.Table, how: Sketching) -> pa.Table:
    """The rows of a block that are in a likely pair."""
    i, j = _likely_in_block(rows, part, how)
    return part.take(pa.array(np.unique(np.concatenate([i, j]))))


def _links(rows: dict[str, np.ndarray], part: pa.Table, how: Sketching) -> pa.Table:
    """Links between a block's labels, as many as it takes to join them; pairs whose ends are joined by then are left."""
    i, j = _likely_in_block(rows, part, how)
    needed = np.unique(np.concatenate([i, j]))
    texts = part.column("text").combine_chunks()
    sets = _sets(texts.take(pa.array(needed)), how.words)
    own = {k: sets.hashes[sets.offsets[at] : sets.offsets[at + 1]] for at, k in enumerate(needed.tolist())}
    labels = rows["comp"]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, reps = [], rows["rep"]
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(int(labels[a])), root(int(labels[b]))
        if x != y and _alike(own[a], own[b], how.percent) and _alike_in_words(texts.take(pa.array([a, b])), how):
            parent[max(x, y)] = min(x, y)
            links.append((min(int(reps[a]), int(reps[b])), max(int(reps[a]), int(reps[b]))))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


_GROUP = ("bucket", "bi", "bj")


def _by_block(batches: Iterable[pa.RecordBatch], how: Sketching, solve_one: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j): what ``solve_one`` makes of each such group of two rows or more."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> list[pa.RecordBatch]:
        columns = {c: table.column(c).to_numpy() for c in (*_GROUP, "block", "band", "rep", "comp", "n")}
        change = np.flatnonzero(np.any([np.diff(columns[c]) != 0 for c in _GROUP], axis=0)) + 1
        found = [solve_one({c: v[a:b] for c, v in columns.items()}, table.slice(a, b - a), how) for a, b in zip(np.concatenate([[0], change]), np.concatenate([change, [table.num_rows]])) if b - a > 1]
        return pa.concat_tables(t.select(names) for t in found if t.num_rows).combine_chunks().to_batches() if any(t.num_rows for t in found) else []

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in _GROUP]
        if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in _GROUP] != [int(k[0]) for k in keys]:
            yield from solve(pa.Table.from_batches(held))
            held = []
        # The last group may go on in the next batch.
        same = np.all([k == k[-1] for k in keys], axis=0)
        start = 0 if same.all() else int(len(same) - np.argmin(same[::-1]))
        if start:
            yield from solve(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        held.append(batch.slice(start))
    if held:
        yield from solve(pa.Table.from_batches(held))


def _verify_batches(batches: Iterable[pa.RecordBatch], how: Sketching) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose full sets of words reach the threshold."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.add(pc.binary_length(batch.column("ta")), pc.binary_length(batch.column("tb"))).fill_null(0)))
        at = 0
        while at < batch.num_rows:
            # Some MB of text at a time, a pair at least.
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 23), "right")))
            part = batch.slice(at, last - at)
            n, at = part.num_rows, last
            ids, offsets = _text.shingle_ids(pa.concat_arrays([part.column("ta"), part.column("tb")]), how.words)
            keep = [_alike(ids[offsets[i] : offsets[i + 1]], ids[offsets[n + i] : offsets[n + i + 1]], how.percent) for i in range(n)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """texts: (doc, text) of representatives. Pairs whose sets are similar enough."""
    with_b = salted_join(pairs, texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), ["b"], "a", salts=4)
    with_a = salted_join(with_b, texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), ["a"], "b", salts=4)
    return with_a.select("a", "b", "ta", "tb").mapInArrow(lambda it: _verify_batches(it, how), "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc: str = "doc_id", *, how: Sketching = Sketching()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``.

    Documents are linked if their sets of ``how.words``-word shingles (words
    lower-cased in A-Z; fewer words: the whole sequence) have a similarity of
    ``how.percent`` percent or more; a component is the smallest id reachable.
    Documents without words are linked with nothing.  Rows that share an id are
    one document, whose text is that of smallest xxhash64, and get the same
    component; a row without an id is linked with nothing and has a null
    component; both are kept if the id is its component's or missing.  An empty
    table gives an empty result.
    """
    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    schema = "doc long, th long, n long, f long, g long, registers binary"
    sketches = cut(rows.mapInArrow(lambda it: _sketch_batches(it, "text", how), schema))
    solid = sketches.filter("n > 0 AND doc IS NOT NULL")
    # Ids with several texts, if there are any, are rewritten to the text that stands for them.
    several = cut(sketches.filter("doc IS NOT NULL").groupBy("doc").agg(F.min("th").alias("least"), F.max("th").alias("most")).filter("least < most").select("doc", "least"))
    mixed_ids = not several.isEmpty()
    if mixed_ids:
        solid = solid.join(several, "doc", "left").filter("least IS NULL OR th = least").drop("least")
        rows = rows.join(several, "doc", "left").filter("least IS NULL OR th = least").drop("least")
    classes = cut(solid.groupBy("f", "g", "n").agg(F.min("doc").alias("rep"), F.first("registers").alias("registers")))
    reps = classes.select("rep", "n", "registers")

    banded = reps.select("rep", "registers").mapInArrow(lambda it: _band_batches(it, how), "bucket long, rep long")
    # A bucket's centre is random among its members, so that the bands of a big group have different ones.
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min_by("rep", F.xxhash64("rep", "bucket")).alias("centre")).filter("size > 1")
    members = cut(salted_join(banded, buckets, ["bucket"], "rep"))

    # The texts of all representatives that share a bucket with another; from here on only these are read.
    shared = members.select(F.col("rep").alias("doc")).distinct()
    texts = cut(rows.join(shared, "doc", "left_semi").dropDuplicates(["doc"]))

    def sketched(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            one = reps.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("registers").alias(f"r{side}"))
            pairs = salted_join(pairs, one, [side], "b" if side == "a" else "a", salts=4)
        return pairs

    star = members.filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    likely = cut(sketched(star).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lambda it: _likely_batches(it, how), "a long, b long"))
    links = cut(_verify(likely, texts, how))
    # One step towards components: whatever shares a label is linked, which is all that the next stage needs.
    labels = cut(small_star(large_star(tidy(links, "a", "b"))).groupBy("hi").agg(F.min("lo").alias("comp")))

    labelled = members.join(labels.withColumnRenamed("hi", "rep"), "rep", "left").select("bucket", "rep", "size", F.coalesce("comp", "rep").alias("comp"))
    # Only buckets with several labels have pairs left, and there only those of a row without the bucket's
    # commonest label: blocks of such rows meet each other and all others, which do not meet among themselves.
    counts = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("common"), F.max("k").alias("commons"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds")
    open_rows = salted_join(labelled, mixed, ["bucket"], "rep")
    rare_blocks, common_blocks = F.ceil((F.col("size") - F.col("commons")) / how.block).cast("int"), F.ceil(F.col("commons") / how.block).cast("int")
    is_common, drawn = F.col("comp") == F.col("common"), F.xxhash64("rep")
    numbered = open_rows.withColumn("block", F.when(is_common, rare_blocks + F.pmod(drawn, common_blocks)).otherwise(F.pmod(drawn, rare_blocks)).cast("int"))
    dealt = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), rare_blocks - 1 + F.when(is_common, 0).otherwise(common_blocks))))
    dealt = dealt.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", F.col("bucket").bitwiseAND(F.lit(255)).cast("int").alias("band"), "rep", "comp")
    # First on the sketches alone: which rows are in a likely pair of their block. Only these get their texts.
    group, fixed = ["bucket", "bi", "bj"], ["bucket", "bi", "bj", "block", "band", "rep", "comp", "n", "registers"]
    met = salted_join(dealt, reps, ["rep"], "bucket", salts=1).select(*fixed).repartition(*group).sortWithinPartitions(*group)
    involved = met.mapInArrow(lambda it: _by_block(it, how, _involved, fixed), "bucket long, bi int, bj int, block int, band int, rep long, comp long, n long, registers binary")
    told = salted_join(involved, texts.withColumnRenamed("doc", "rep"), ["rep"], "bucket", salts=2)
    more = told.select(*fixed, "text").repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda it: _by_block(it, how, _links, ["a", "b"]), "a long, b long")
    final = components(links.union(more))

    of_class = classes.select("f", "g", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("f", "g", "n", F.coalesce("component", "rep").alias("component"))
    given = sketches.drop("registers")
    if mixed_ids:
        stands = sketches.join(several, "doc").filter("th = least").select("doc", F.struct("f", "g", "n").alias("s")).dropDuplicates(["doc"])
        given = given.join(stands, "doc", "left").select("doc", F.coalesce("s.f", "f").alias("f"), F.coalesce("s.g", "g").alias("g"), F.col("n").alias("own_n"), F.coalesce("s.n", "n").alias("n"))
    else:
        given = given.withColumn("own_n", F.col("n"))
    out = salted_join(given, of_class, ["f", "g", "n"], "doc", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    component = F.when(F.col("doc").isNotNull(), component)
    return out.select(F.col("doc").alias("doc_id"), F.col("own_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc: str = "doc_id", *, how: Sketching = Sketching()) -> DataFrame:  # noqa: B008
    """One document of each component, the one with the smallest id; rows without an id stay.

    Of rows that share an id one stays, with the text that stands for the id
    (that of smallest xxhash64); if these differ in other columns, any of them.
    """
    df, other, named = shielded(df)
    text, doc = other.get(text, text), other.get(doc, doc)
    kept = near_duplicates(df, text, doc, how=how).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__doc")).distinct()
    key, hashed = F.col(f"`{doc}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    least = df.filter(key.isNotNull()).groupBy(key.alias("__doc")).agg(F.min(hashed).alias("__least"))
    with_id = df.join(kept.join(least, "__doc"), (key == F.col("__doc")) & (hashed == F.col("__least")), "left_semi").dropDuplicates([doc])
    return named(with_id.union(df.filter(F.col(f"`{doc}`").isNull())))
