"""Adapters: the given tables as the engine's items, turns, vectors and purchases.

Times are microseconds since 1970 taken from zone-less timestamps, so that no
session time zone enters.  For each adapter there is the same view in SQL, for
the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def chat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat messages: (item_id, thread_id, t, direction, kind)."""
    direction = F.when(F.col("event_type").isin("purchase", "signup"), "outbound").otherwise("inbound")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("thread_id"), micros("ts").alias("t"), direction.alias("direction"), F.col("event_type").alias("kind"))


CHAT_SQL = "chat AS (SELECT event_id AS item_id, user_id AS thread_id, epoch_us(ts) AS t, CASE WHEN event_type IN ('purchase', 'signup') THEN 'outbound' ELSE 'inbound' END AS direction, event_type AS kind FROM events)"


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: (item_id, account_id, kind, title, body)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("account_id"), F.col("lang").alias("kind"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))


DOCUMENTS_SQL = "items AS (SELECT doc_id AS item_id, source AS account_id, lang AS kind, substr(text, 1, 60) AS title, text AS body FROM documents)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: (conv_id, turn, speaker, text); the user is "Me"."""
    speaker = F.when(F.col("role") == "user", "Me").otherwise(F.initcap("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speaker.alias("speaker"), "text")


TURNS_SQL = "turns AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Me' ELSE upper(substr(role, 1, 1)) || lower(substr(role, 2)) END AS speaker, text FROM conversations)"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchases: (purchase_id, merchant, t, cents).

    The merchant is the line's supplier; an order's lines from one supplier are one purchase.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), micros("o_orderdate").alias("t"), F.col("o_custkey").alias("owner_id"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("merchant"))
    return lines.join(orders, "order_id").join(suppliers, "s_suppkey").select(F.concat_ws("-", F.col("order_id").cast("string"), F.col("s_suppkey").cast("string")).alias("purchase_id"), "owner_id", "merchant", "t", "cents")


PURCHASES_SQL = """purchases AS (SELECT l_orderkey || '-' || l_suppkey AS purchase_id, min(o_custkey) AS owner_id, min(s_name) AS merchant, min(epoch_us(o_orderdate)) AS t, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: (task_id, owner_id, title, made, due, state)."""
    day = 86_400_000_000
    made = micros("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("title"), made.alias("made"), (made + 30 * day).alias("due"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("state"))


TASKS_SQL = "tasks AS (SELECT o_orderkey AS task_id, o_custkey AS owner_id, o_orderpriority AS title, epoch_us(o_orderdate) AS made, epoch_us(o_orderdate) + 30 * 86400000000 AS due, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'open' END AS state FROM orders)"
