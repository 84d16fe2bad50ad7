"""Merging pages of changes into a store's snapshot, idempotently and in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.tables import table


def content_hash(*columns: str) -> Column:
    """A digest of what makes an item the same as before."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, change, the new content): what a page of rows does to a snapshot: insert, update or nothing.

    Content is compared by value, so a page that comes twice changes nothing the second time.
    """
    before = old.select(key, content_hash(*content).alias("old_hash"))
    after = new.select(key, *content, content_hash(*content).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "insert").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("update")
    return after.join(before, key, "left").select(key, change.alias("change"), *content)


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """One row per key by a rule for each column: replace, keep, max, min or sum.

    ``replace`` takes the newest value that is not null, ``keep`` the oldest.
    Both sides are stacked and grouped, so the merge combines on the map side.
    """
    stacked = old.select(key, *rules, F.lit(0).alias("__at")).unionByName(new.select(key, *rules, F.lit(1).alias("__at")))
    known = {c: F.when(F.col(c).isNotNull(), F.col("__at")) for c in rules}
    by = {"replace": lambda c: F.max_by(c, known[c]), "keep": lambda c: F.min_by(c, known[c]), "max": F.max, "min": F.min, "sum": F.sum}
    return stacked.groupBy(key).agg(*(by[rule](c).alias(c) for c, rule in rules.items()))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as the snapshot; what their lines say about them as the page."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderstatus").alias("state"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
    new = lines.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.min("l_linestatus").alias("state"))
    return old, new


_OLD = "old AS (SELECT o_orderkey AS order_id, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus AS state FROM orders), page AS (SELECT l_orderkey AS order_id, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, min(l_linestatus) AS state FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_OLD} SELECT page.order_id, CASE WHEN old.order_id IS NULL THEN 'insert' WHEN old.cents IS NOT DISTINCT FROM page.cents AND old.state IS NOT DISTINCT FROM page.state THEN 'unchanged' ELSE 'update' END AS change, page.cents, page.state FROM page LEFT JOIN old USING (order_id)")
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, DED-1, INC-1: what a page of lines changes in the orders."""
    old, new = _sides(spark, sf_dir)
    return changes(old, new, "order_id", ["cents", "state"])


@query(f"WITH {_OLD} SELECT order_id, coalesce(page.state, old.state) AS state, greatest(old.cents, page.cents) AS cents FROM old FULL JOIN page USING (order_id)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-1, UPS-2: orders and their lines merged column by column."""
    old, new = _sides(spark, sf_dir)
    return merge(old, new, "order_id", {"state": "replace", "cents": "max"}).select("order_id", "state", "cents")


@query("WITH seen AS (SELECT DISTINCT l_orderkey AS order_id FROM lineitem) SELECT o_orderkey AS order_id, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT IN (SELECT order_id FROM seen)")
def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-6, JOI-5: items that a pass has not seen."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id")).distinct()
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority")).join(seen, "order_id", "left_anti")
