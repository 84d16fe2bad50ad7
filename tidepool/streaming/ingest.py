"""Structured Streaming: pages of items into a store, and what is derived from them.

Batch results define what is right: a late or repeated item only makes its key
dirty, and dirty keys are derived again from the store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.sessions import GAP, by_gap
from tidepool.plans.lineage import scratch
from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, micros


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events*.parquet")


def ingest(stream: DataFrame, store: str, key: str = "item_id") -> None:
    """Write all that a stream has now into the store, each batch in a folder of its own.

    A batch that is delivered again overwrites its own folder, so nothing comes twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{store}/items/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, store: str, key: str = "item_id") -> DataFrame:
    """The store's items, the latest delivery of each."""
    rows = spark.read.parquet(f"{store}/items")
    kept = [c for c in rows.columns if c not in (key, "batch")]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("x"))
    return latest.select(key, *(F.col(f"x.{c}").alias(c) for c in kept))


def _new_store(spark: SparkSession) -> str:
    return scratch(spark, "store")


def _chat(events: DataFrame) -> DataFrame:
    direction = F.when(F.col("event_type").isin("purchase", "signup"), "outbound").otherwise("inbound")
    return events.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("thread_id"), micros("ts").alias("t"), direction.alias("direction"), F.col("event_type").alias("kind"))


@query(f"""WITH {CHAT_SQL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM chat WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY t, item_id)::BIGINT AS run FROM g) SELECT thread_id, run, count(*) AS items, min(t) AS starts FROM runs GROUP BY thread_id, run""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-5 to STR-7: events streamed into a store, and the sessions of what it then holds."""
    store = _new_store(spark)
    ingest(_chat(read_events(spark, sf_dir)), store)
    return by_gap(stored(spark, store)).groupBy("thread_id", "run").agg(F.count(F.lit(1)).alias("items"), F.min("t").alias("starts"))


@query("SELECT epoch_us(date_trunc('day', ts)) AS day, event_type AS kind, count(*) AS items, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4: events counted by day and kind as they come; the last trigger's table is the result."""
    store = _new_store(spark)
    counted = read_events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("items"), F.sum("value").alias("total"))

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/counts")

    counted.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{store}/counts").select(micros("w.start").alias("day"), "kind", "items", F.round("total", 4).alias("total"))
