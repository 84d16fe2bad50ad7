"""What a store covers: counts, spans and completeness by stream, kind and account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, DOCUMENTS_SQL, chat_items, document_items, table


def coverage(items: DataFrame, *by: str) -> DataFrame:
    """Counts, first and last time and direction counts of items, per group or overall."""
    counted = items.groupBy(*by) if by else items
    return counted.agg(
        F.count(F.lit(1)).alias("items"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.count_if(F.col("direction") == "inbound").alias("inbound"),
        F.count_if(F.col("direction") == "outbound").alias("outbound"),
        F.countDistinct("thread_id").alias("threads"),
    )


_COVERAGE = "count(*) AS items, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (direction = 'inbound') AS inbound, count(*) FILTER (direction = 'outbound') AS outbound, count(DISTINCT thread_id) AS threads"


@query(f"WITH {CHAT_SQL} SELECT {_COVERAGE} FROM chat")
def coverage_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-4: how much of what the store holds, and since when."""
    return coverage(chat_items(spark, sf_dir))


@query(f"WITH {CHAT_SQL} SELECT kind, {_COVERAGE} FROM chat GROUP BY kind")
def coverage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2: the same by kind."""
    return coverage(chat_items(spark, sf_dir), "kind")


@query(f"WITH {DOCUMENTS_SQL} SELECT account_id, count(*) AS items, max(item_id) AS newest_id, sum(octet_length(encode(body)))::BIGINT AS bytes, count(DISTINCT kind) AS kinds FROM items GROUP BY account_id")
def items_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, AGG-5: items, bytes and newest item of each account."""
    return document_items(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("items"), F.max("item_id").alias("newest_id"), F.sum(F.octet_length("body").cast("long")).alias("bytes"), F.countDistinct("kind").alias("kinds"))


@query("SELECT coalesce(CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 0 THEN 'sensitive' WHEN quality = 1 THEN 'normal' END, 'unclassified') AS sensitivity, count(*) AS items FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def sensitivity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: items by sensitivity label, those without one as unclassified."""
    label = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 0, "sensitive").when(F.col("quality") == 1, "normal")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy(F.coalesce(label, F.lit("unclassified")).alias("sensitivity")).agg(F.count(F.lit(1)).alias("items"))


@query(f"""WITH {CHAT_SQL}, n AS (SELECT max(t) AS now FROM chat)
SELECT kind AS stream, count(*) AS items, (now - max(t)) // 1000 AS age_ms, count(*) FILTER (t >= now - 7 * 86400000000) AS last_week FROM chat, n GROUP BY kind, now""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: items per stream, age of the newest, and how many the last week brought."""
    items = chat_items(spark, sf_dir)
    now = items.agg(F.max("t").alias("now"))
    return items.crossJoin(F.broadcast(now)).groupBy(F.col("kind").alias("stream"), "now").agg(F.count(F.lit(1)).alias("items"), F.max("t").alias("last"), F.count_if(F.col("t") >= F.col("now") - 7 * 86_400_000_000).alias("last_week")).select("stream", "items", F.expr("(now - last) div 1000").alias("age_ms"), "last_week")
