"""Derived tables kept up to date from a stream: what changes makes its thread dirty, dirty threads are derived again.

The store is written batch by batch, each batch in folders of its own: the
items delivered, what follows for the threads they make dirty, and how far each
stream has come.  A batch that is delivered again writes the same folders
again, and reads nothing that came after it, so a restart at any point loses
and doubles nothing.  What holds of a thread is what the last batch that made
it dirty says; the result is that of deriving everything from the items anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.sessions import GAP, by_gap
from tidepool.plans.lineage import scratch
from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, chat_items

#: Folders that a batch's items are dealt to by thread, so that dirty threads are read without the others.
BUCKETS = 16
DAY = 86_400_000_000
#: The windows that are read first, and at all.
RECENT, FLOOR = 90 * DAY, 183 * DAY
ITEM = "item_id long, thread_id long, stream string, t long, version long, deleted boolean"


def latest(items: DataFrame) -> DataFrame:
    """SNK-2, STR-8: the live items, each as its greatest version (the last delivered of one version) has it."""
    rest = [c for c in items.columns if c not in ("item_id", "batch", "bucket")]
    newest = items.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("version", "batch")).alias("x"))
    return newest.select("item_id", "x.*").filter("NOT deleted")


def gap_episodes(items: DataFrame) -> DataFrame:
    """SES-1, SES-6: (thread_id, episode, starts, ends, items) of live items; an episode's id follows from its members."""
    grouped = by_gap(items).groupBy("thread_id", "run").agg(F.min("t").alias("starts"), F.max("t").alias("ends"), F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_list("item_id")).alias("members"))
    key = F.concat(F.lit("ep_"), F.substring(F.sha2(F.array_join(F.transform("members", lambda m: m.cast("string")), "|"), 256), 1, 20))
    return grouped.select("thread_id", key.alias("episode"), "starts", "ends", "items")


def advance(stream: DataFrame, store: str, derive: Callable[[DataFrame], DataFrame] = gap_episodes) -> None:
    """STR-5, STR-6, SES-7: fold all that a stream has now (columns of ITEM) into the store; goes on where it stopped.

    ``derive`` makes rows with a thread_id out of the live items of whole
    threads.  An item stays in its thread; one that moves is withdrawn and
    delivered under another id.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"batch={number}"
        bucket = F.pmod(F.xxhash64("thread_id"), F.lit(BUCKETS)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/items/{folder}")
        came = spark.read.schema(f"{ITEM}, bucket int").parquet(f"{store}/items/{folder}")
        came.groupBy("stream").agg(F.max("t").alias("newest"), F.min("t").alias("oldest")).write.mode("overwrite").parquet(f"{store}/cursors/{folder}")
        dirty = came.select("thread_id", "bucket").distinct()
        held = spark.read.schema(f"{ITEM}, batch int, bucket int").parquet(f"{store}/items").filter(F.col("batch") <= number)
        again = derive(latest(held.join(dirty, ["bucket", "thread_id"], "left_semi").drop("bucket")))
        # A dirty thread of which nothing is left has a row that says so.
        dirty.select("thread_id").join(again, "thread_id", "left").write.mode("overwrite").parquet(f"{store}/derived/{folder}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, store: str, key: str = "episode") -> DataFrame:
    """The derived rows that hold after all batches."""
    every = spark.read.parquet(f"{store}/derived")
    last = every.groupBy("thread_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["thread_id", "batch"], "left_semi").filter(F.col(key).isNotNull()).drop("batch")


def rebuilt(spark: SparkSession, store: str, derive: Callable[[DataFrame], DataFrame] = gap_episodes) -> DataFrame:
    """The same from all items at once."""
    return derive(latest(spark.read.schema(f"{ITEM}, batch int, bucket int").parquet(f"{store}/items")))


def cursors(spark: SparkSession, store: str) -> DataFrame:
    """STR-1: (stream, newest, oldest): how far each stream has come, both ways."""
    return spark.read.parquet(f"{store}/cursors").groupBy("stream").agg(F.max("newest").alias("newest"), F.min("oldest").alias("oldest"))


def phases(found: DataFrame, now: int, floor: int = FLOOR) -> DataFrame:
    """STR-4, INC-5: (stream, recent, complete, needs_history) of cursors; a floor of 0 has no end, so nothing completes it."""
    recent = F.col("oldest") <= now - RECENT
    complete = (F.col("oldest") <= now - floor) if floor else F.lit(False)
    return found.select("stream", recent.alias("recent"), complete.alias("complete"), (recent & ~complete).alias("needs_history"))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries: every ninth first with another time, every fiftieth withdrawn, some twice."""
    items = chat_items(spark, sf_dir).select("item_id", "thread_id", F.concat(F.lit("s"), (F.col("thread_id") % 5).cast("string")).alias("stream"), "t")
    now = items.withColumns({"version": F.lit(1).cast("long"), "deleted": F.lit(False)})
    before = now.filter("item_id % 9 = 0").withColumn("t", F.col("t") - 5 * 3_600_000_000).withColumn("version", F.lit(0).cast("long"))
    gone = now.filter("item_id % 50 = 0").withColumn("deleted", F.lit(True)).withColumn("version", F.lit(2).cast("long"))
    return now.unionByName(before).unionByName(gone).unionByName(now.filter("item_id % 20 = 3"))


_LIVE = f"{CHAT_SQL}, live AS (SELECT * FROM chat WHERE item_id % 50 <> 0)"


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """A store that has taken in all deliveries, in an order of its own."""
    store = scratch(spark, "derived")
    delivered(spark, sf_dir).repartition(4, F.xxhash64("item_id", "version", F.rand(11))).write.parquet(f"{store}/source")
    advance(spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(f"{store}/source"), store)
    return store


@query(f"""WITH {_LIVE}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM live WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY t, item_id) AS run FROM g)
SELECT thread_id, 'ep_' || substr(sha256(string_agg(item_id, '|' ORDER BY item_id)), 1, 20) AS episode, min(t) AS starts, max(t) AS ends, count(*) AS items FROM r GROUP BY thread_id, run""")
def stream_episodes_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5, STR-6, STR-8, SES-7: episodes after changed, withdrawn, late and repeated items, derived thread by thread."""
    return current(spark, _streamed(spark, sf_dir))


_NOW = 1_714_000_000_000_000


@query(f"""WITH {CHAT_SQL}, c AS (SELECT 's' || thread_id % 5 AS stream, min(CASE WHEN item_id % 9 = 0 THEN t - 18000000000 ELSE t END) AS oldest, max(t) AS newest FROM chat GROUP BY 1)
SELECT stream, newest, oldest, oldest <= {_NOW - RECENT} AS recent, oldest <= {_NOW - FLOOR} AS complete, oldest <= {_NOW - RECENT} AND oldest > {_NOW - FLOOR} AS needs_history FROM c""")
def stream_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-4, INC-5: how far each stream has come, and which still need their history."""
    found = cursors(spark, _streamed(spark, sf_dir))
    return found.join(phases(found, _NOW), "stream")
