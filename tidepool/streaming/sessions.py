"""Sessions as streaming state: items in any order, twice, or withdrawn.

Each thread's state holds its sessions that may still change: an item widens a
session, joins two, or starts one.  What changes goes out as puts and drops
into a log, and what holds now is the last word on each session.  Repeated
deliveries are dropped within the watermark; sessions older than the watermark
leave the state, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepool.operators.sessions import GAP
from tidepool.plans.lineage import scratch
from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, chat_items

_OUT = "thread_id long, starts long, ends long, items long, live boolean"
_STATE = "starts array<long>, ends array<long>, items array<long>"


def place(sessions: list[tuple[int, int, int]], t: int, gap: int = GAP) -> list[tuple[int, int, int]]:
    """Sessions (start, end, items) with one more item at t."""
    near = [s for s in sessions if s[0] - gap <= t <= s[1] + gap]
    away = [s for s in sessions if s not in near]
    return [*away, (min([t, *(s[0] for s in near)]), max([t, *(s[1] for s in near)]), 1 + sum(s[2] for s in near))]


def _fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = list(zip(*state.get)) if state.exists else []
    if state.hasTimedOut:
        state.remove()
        return
    after = before
    for frame in frames:
        for t in frame["t"]:
            after = place(after, int(t))
    mark = state.getCurrentWatermarkMs() * 1000
    held = [s for s in after if s[1] + GAP >= mark]
    state.update(tuple(list(c) for c in zip(*held)) if held else ([], [], []))
    if held:
        state.setTimeoutTimestamp(max(mark // 1000, max(s[1] for s in held) // 1000) + GAP // 1000 + 1)
    old, new = set(before), set(after)
    rows = [(key[0], *s, True) for s in sorted(new - old)] + [(key[0], *s, False) for s in sorted(old - new) if s[0] not in {n[0] for n in new}]
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in _OUT.split(", ")])


def stream_into(stream: DataFrame, store: str, late: str = "60 days") -> None:
    """Fold a stream of (item_id, thread_id, t) into the session log under ``store``; goes on where it stopped."""
    timed = stream.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late).dropDuplicatesWithinWatermark(["item_id"])
    folded = timed.groupBy("thread_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def save(batch: DataFrame, number: int) -> None:
        # A batch that is delivered again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{store}/log/batch={number}")

    folded.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, store: str) -> DataFrame:
    """(thread_id, starts, ends, items): the sessions that hold after all batches."""
    log = spark.read.schema(f"{_OUT}, batch int").parquet(f"{store}/log")
    last = log.groupBy("thread_id", "starts").agg(F.max_by(F.struct("ends", "items", "live"), F.struct("batch", "live")).alias("x"))
    return last.filter("x.live").select("thread_id", "starts", F.col("x.ends").alias("ends"), F.col("x.items").alias("items"))


@query(f"""WITH {CHAT_SQL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM chat WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY t, item_id) AS run FROM g) SELECT thread_id, min(t) AS starts, max(t) AS ends, count(*) AS items FROM runs GROUP BY thread_id, run""")
def stream_sessions_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5 to STR-7: events dealt into files out of order, some twice, folded file by file into sessions."""
    store = scratch(spark, "sessions")
    items = chat_items(spark, sf_dir).select("item_id", "thread_id", "t")
    twice = items.unionByName(items.filter("item_id % 20 = 0"))
    twice.repartition(4, F.xxhash64("item_id", F.rand(7))).write.parquet(f"{store}/source")
    stream = spark.readStream.schema("item_id long, thread_id long, t long").option("maxFilesPerTrigger", 1).parquet(f"{store}/source")
    stream_into(stream, store)
    return current(spark, store)
