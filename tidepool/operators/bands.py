"""The nearest rows in time: for every left row the few right rows of its key that are nearest, within a band.

No pair is made that is not returned.  Both sides are sorted by key and time as
one stream of narrow rows; a row's place among its key's right rows says which
block it belongs to, so a key of any size is many blocks of the same size.  A
block also gets the right rows just beyond its borders, as many as an answer or
a count can need, and is then read once: around each left row stand its
candidates, in order of distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut

#: Right rows in a block, at least; candidates looked at in one go.
BLOCK_ROWS, CANDIDATES = 4096, 400_000


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition's number and the right rows of their key that stand before them in the partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").dictionary_encode()
        codes, right = keys.indices.to_numpy(), batch.column("side").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
        before = np.cumsum(right) - right
        index = before - np.repeat(before[starts], np.diff(np.append(starts, batch.num_rows)))
        if keys.dictionary[int(codes[0])].as_py() == last:
            index[: starts[1] if len(starts) > 1 else batch.num_rows] += seen
        last, seen = keys.dictionary[int(codes[-1])].as_py(), int(index[-1] + right[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(index.astype(np.int64))], names=[*batch.schema.names, "part", "index"])


def _answers(rows: pa.Table, width: int, most: int, bulk: int | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The nearest right rows of every left row of whole blocks."""
    ids, keys = rows.column("id").combine_chunks(), rows.column("key").combine_chunks()
    t, side, block = (rows.column(c).to_numpy() for c in ("t", "side", "block"))
    code = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    edge = np.concatenate([[True], (np.diff(keys.dictionary_encode().indices.to_numpy()) != 0) | (np.diff(block) != 0)])
    segment = np.cumsum(edge) - 1
    ahead = np.concatenate([[0], np.cumsum(side)])
    starts = np.flatnonzero(edge)
    first, last = ahead[starts], ahead[np.append(starts[1:], len(side))]
    right, left = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    if not len(right) or not len(left):
        return
    right_t, right_segment, right_code = t[right], segment[right], code[right]
    # Backwards in time, rows of one instant are met in order of their ids too.
    backwards = np.lexsort((right_code, -right_t, right_segment))
    if bulk is not None:
        instants = np.unique(right_t)
        span = len(instants) + 1
        place = right_segment * span + np.searchsorted(instants, right_t)
        low = np.searchsorted(place, segment[left] * span + np.searchsorted(instants, t[left] - width))
        high = np.searchsorted(place, segment[left] * span + np.searchsorted(instants, t[left] + width, "right"))
        left = left[high - low <= bulk]
    reach = np.arange(most + 1)
    for at in range(0, len(left), max(1, CANDIDATES // (2 * len(reach)))):
        own = left[at : at + max(1, CANDIDATES // (2 * len(reach)))]
        begin, end, here = first[segment[own]], last[segment[own]], ahead[own]
        later = here[:, None] + reach
        earlier = (begin + end - here)[:, None] + reach
        inside = np.concatenate([later < end[:, None], earlier < end[:, None]], axis=1)
        found = np.concatenate([np.minimum(later, len(right) - 1), backwards[np.minimum(earlier, len(right) - 1)]], axis=1)
        away = np.abs(right_t[found] - t[own][:, None])
        inside &= (away <= width) & (right_code[found] != code[own][:, None])
        away[~inside] = np.iinfo(np.int64).max
        order = np.lexsort((right_code[found], away), axis=-1)[:, :most]
        kept = np.take_along_axis(inside, order, 1)
        row, rank = np.nonzero(kept)
        chosen = right[np.take_along_axis(found, order, 1)[kept]]
        parts = [ids.take(pa.array(own[row])), keys.take(pa.array(own[row])), ids.take(pa.array(chosen)), pa.array(np.take_along_axis(away, order, 1)[kept]), pa.array(rank + 1)]
        yield pa.RecordBatch.from_arrays(parts, names=names)


def _streamed(batches: Iterable[pa.RecordBatch], width: int, most: int, bulk: int | None) -> Iterator[pa.RecordBatch]:
    """Answers for sorted rows; a block that a batch ends in is kept for the next one."""
    names, kept = ["left_id", "key", "right_id", "away", "rank"], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
        block, keys = rows.column("block").to_numpy(), rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        changes = np.flatnonzero((np.diff(block) != 0) | (np.diff(keys) != 0)) + 1
        if not len(changes):
            kept = rows
            continue
        yield from _answers(rows.slice(0, changes[-1]), width, most, bulk, names)
        kept = rows.slice(changes[-1])
    if kept is not None and kept.num_rows:
        yield from _answers(kept, width, most, bulk, names)


def nearest_in_band(left: DataFrame, right: DataFrame, *, width: int, most: int, bulk: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left_id, key, right_id, away, rank): for every left row the ``most`` right rows of its key nearest in time, at most ``width`` away.

    Both sides have (id, key, t), ids and keys of one type each, text or whole
    numbers, and whole numbers for t.  Ties go to the smaller id.  A row never
    meets a row of its own id.  With ``bulk``, a left row with more than so
    many right rows of its key in its band (itself counted) gets none.  Rows
    with a null in id, key or t take no part; repeated rows count each.
    """
    # Of the right rows of one key and instant only so many can matter to any answer or count.
    need = max(most, bulk or 0) + 1
    border, size = 2 * need, max(block_rows, 4 * need)
    sound = "id IS NOT NULL AND key IS NOT NULL AND t IS NOT NULL"
    held = right.select("id", "key", F.col("t").cast("long").alias("t")).filter(sound)
    held = held.withColumn("n", F.row_number().over(Window.partitionBy("key", "t").orderBy("id"))).filter(F.col("n") <= need).drop("n")
    both = left.select("id", "key", F.col("t").cast("long").alias("t")).filter(sound).withColumn("side", F.lit(0)).unionByName(held.withColumn("side", F.lit(1)))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    order = ["key", "t", "side", "id"]
    numbered = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"id {kinds['id']}, key {kinds['key']}, t long, side int, part long, index long"))
    # Only a partition's first key can have rows in earlier partitions, so there are no more of these rows than partitions.
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = numbered.groupBy("key", "part").agg(F.sum("side").alias("n"))
    before = counted.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("key", "part", "before")
    placed = numbered.join(F.broadcast(before), ["key", "part"], "left").withColumn("place", F.col("index") + F.coalesce("before", F.lit(0))).withColumn("own", F.expr(f"place div {size}"))
    over = (F.col("side") == 1) & (F.col("place") >= (F.col("own") + 1) * size - border)
    under = (F.col("side") == 1) & (F.col("own") > 0) & (F.col("place") < F.col("own") * size + border)
    blocks = F.filter(F.array(F.col("own"), F.when(over, F.col("own") + 1), F.when(under, F.col("own") - 1)), lambda b: b.isNotNull())
    dealt = placed.select("id", "key", "t", "side", F.explode(blocks).alias("block")).repartition("key", "block").sortWithinPartitions("key", "block", "t", "side", "id")
    return dealt.mapInArrow(lambda it: _streamed(it, width, most, bulk), f"left_id {kinds['id']}, key {kinds['key']}, right_id {kinds['id']}, away long, rank long")
