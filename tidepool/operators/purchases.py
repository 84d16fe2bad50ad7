"""Purchases: receipts among documents, spending, rhythm and duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.registry import query
from tidepool.sources.tables import DOCUMENTS_SQL, PURCHASES_SQL, document_items, purchases

HOUR, DAY = 3_600_000_000, 86_400_000_000
_KEY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(merchant)), '\\s*[.,-]\\s*$', ''), '^(the|a)\\s+', ''), {T.sql(T.COMPANY)}, '', 'g'), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {PURCHASES_SQL}, k AS (SELECT *, {_KEY} AS key FROM purchases)
SELECT key, min(merchant) AS merchant, count(*) AS purchases, sum(cents)::BIGINT AS cents, min(t) AS first_t, max(t) AS last_t FROM k GROUP BY key""")
def spend_by_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, PUR-3, TOOL-7: spending per merchant."""
    keyed = purchases(spark, sf_dir).withColumn("key", T.merchant_key(F.col("merchant")))
    return keyed.groupBy("key").agg(F.min("merchant").alias("merchant"), F.count(F.lit(1)).alias("purchases"), F.sum("cents").alias("cents"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""WITH {PURCHASES_SQL}, g AS (SELECT owner_id, t, (t - lag(t) OVER (PARTITION BY owner_id ORDER BY t, purchase_id)) / {DAY}::DOUBLE AS days FROM purchases),
m AS (SELECT owner_id, median(days) AS mid, count(days) AS gaps FROM g WHERE days > 0 GROUP BY owner_id), l AS (SELECT owner_id, max(t) AS last FROM purchases GROUP BY owner_id), n AS (SELECT max(t) AS now FROM purchases),
d AS (SELECT owner_id, median(abs(days - mid)) AS mad FROM g JOIN m USING (owner_id) WHERE days > 0 GROUP BY owner_id)
SELECT owner_id, gaps, round(mid, 6) AS median_days, round(mad, 6) AS mad_days, round((now - last) / {DAY}::DOUBLE / mid, 6) AS overdue FROM m JOIN d USING (owner_id) JOIN l USING (owner_id), n
WHERE gaps >= 3 AND mid BETWEEN 5 AND 120 AND mad / mid <= 0.6 AND (now - last) / {DAY}::DOUBLE BETWEEN 1.5 * mid AND 6 * mid""")
def purchase_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-9, AGG-18: customers who buy in a rhythm and are overdue."""
    bought = purchases(spark, sf_dir).select("owner_id", "purchase_id", "t")
    order = Window.partitionBy("owner_id").orderBy("t", "purchase_id")
    gaps = bought.select("owner_id", "t", ((F.col("t") - F.lag("t").over(order)) / float(DAY)).alias("days"))
    known = gaps.filter("days > 0")
    middle = known.groupBy("owner_id").agg(F.median("days").alias("mid"), F.count("days").alias("gaps"))
    spread = known.join(middle, "owner_id").groupBy("owner_id").agg(F.median(F.abs(F.col("days") - F.col("mid"))).alias("mad"))
    last = bought.groupBy("owner_id").agg(F.max("t").alias("last"))
    now = bought.agg(F.max("t").alias("now"))
    away = (F.col("now") - F.col("last")) / float(DAY)
    due = middle.join(spread, "owner_id").join(last, "owner_id").crossJoin(F.broadcast(now)).withColumn("away", away)
    kept = due.filter("gaps >= 3 AND mid BETWEEN 5 AND 120 AND mad / mid <= 0.6 AND away BETWEEN 1.5 * mid AND 6 * mid")
    return kept.select("owner_id", "gaps", F.round("mid", 6).alias("median_days"), F.round("mad", 6).alias("mad_days"), F.round(F.col("away") / F.col("mid"), 6).alias("overdue"))


_REJECTED = f"CASE WHEN trim(body) = '' THEN 'empty' WHEN regexp_matches(body, {T.sql(T.NO_RECEIPT)}) THEN 'marketing' WHEN NOT regexp_matches(body, {T.sql(T.RECEIPT)}) THEN 'no_receipt_words' WHEN NOT regexp_matches(body, {T.sql(T.MONEY)}) THEN 'no_money' ELSE 'candidate' END"


@query(f"WITH {DOCUMENTS_SQL} SELECT account_id, {_REJECTED} AS reason, count(*) AS items FROM items GROUP BY ALL")
def purchase_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-1, AGG-17: why documents are no receipts, the first reason that holds."""
    body = F.col("body")
    reason = (
        F.when(F.trim(body) == "", "empty")
        .when(body.rlike(T.java(T.NO_RECEIPT)), "marketing")
        .when(~body.rlike(T.java(T.RECEIPT)), "no_receipt_words")
        .when(~body.rlike(T.java(T.MONEY)), "no_money")
        .otherwise("candidate")
    )
    return document_items(spark, sf_dir).groupBy("account_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("items"))


def _one(a: str, b: str) -> bool:
    """Whether two merchants' keys are one: equal, or the shorter of twelve characters or more and continued by three at most."""
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= 12 and long.startswith(short) and len(long) - len(short) <= 3)


def _keep_newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by owner, head of the key and time, newest first: those no kept one of the same owner and merchant stands for."""
    last, kept = None, []
    for batch in batches:
        stays = []
        for owner, head, key, t, cents in zip(batch["owner_id"], batch["head"], batch["key"], batch["t"], batch["cents"]):
            if (owner, head) != last:
                last, kept = (owner, head), []
            kept = [x for x in kept if x[0] - t <= 14 * DAY]
            same = any(_one(k, key) and ((at - t <= 36 * HOUR and abs(c - cents) <= 0.25 * max(c, cents)) or abs(c - cents) <= 0.02 * max(c, cents)) for at, c, k in kept)
            stays.append(not same)
            if not same:
                kept.append((t, cents, key))
        yield batch[stays][["purchase_id", "key", "t", "cents"]]


_ALIKE = f"k.t - p.t <= 14 * {DAY} AND (k.key = p.key OR (least(length(k.key), length(p.key)) >= 12 AND abs(length(k.key) - length(p.key)) <= 3 AND (starts_with(k.key, p.key) OR starts_with(p.key, k.key)))) AND ((k.t - p.t <= 36 * {HOUR} AND abs(k.cents - p.cents) <= 0.25 * greatest(k.cents, p.cents)) OR abs(k.cents - p.cents) <= 0.02 * greatest(k.cents, p.cents))"


@query(f"""WITH RECURSIVE {PURCHASES_SQL}, k AS (SELECT purchase_id, owner_id, {_KEY} AS key, t, cents FROM purchases), p AS (SELECT *, substr(key, 1, 12) AS head, row_number() OVER (PARTITION BY owner_id, substr(key, 1, 12) ORDER BY t DESC, purchase_id) AS n FROM k),
r AS (SELECT owner_id, head, n, purchase_id, key, t, cents, true AS stays, [{{'t': t, 'cents': cents, 'key': key}}] AS kept FROM p WHERE n = 1
UNION ALL SELECT p.owner_id, p.head, p.n, p.purchase_id, p.key, p.t, p.cents, len(list_filter(r.kept, lambda k: {_ALIKE})) = 0, CASE WHEN len(list_filter(r.kept, lambda k: {_ALIKE})) = 0 THEN list_append(r.kept, {{'t': p.t, 'cents': p.cents, 'key': p.key}}) ELSE r.kept END
FROM r JOIN p ON p.owner_id = r.owner_id AND p.head = r.head AND p.n = r.n + 1)
SELECT purchase_id, key, t, cents FROM r WHERE stays""")
def purchase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-3: purchases without their doubles; which one stays depends on those kept before it.

    Purchases meet by owner and the first twelve characters of the merchant's key,
    which one merchant's keys share, and go by as a sorted stream, of which the
    kept ones of two weeks are held.
    """
    keyed = purchases(spark, sf_dir).withColumn("key", T.merchant_key(F.col("merchant"))).withColumn("head", F.substring("key", 1, 12))
    dealt = keyed.select("owner_id", "purchase_id", "head", "key", "t", "cents").repartition("owner_id", "head").sortWithinPartitions("owner_id", "head", F.desc("t"), "purchase_id")
    return dealt.mapInPandas(_keep_newest, "purchase_id string, key string, t long, cents long")


@query("SELECT l_returnflag AS tier, l_linestatus AS state, count(*) AS lines, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(round(l_extendedprice * l_discount * 100)::BIGINT)::BIGINT AS discount_cents, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL")
def audit_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, AGG-13: sums by tier and state."""
    from tidepool.sources.tables import table

    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    off = F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("state")).agg(F.count(F.lit(1)).alias("lines"), F.sum(cents).alias("cents"), F.sum(off).alias("discount_cents"), F.countDistinct("l_orderkey").alias("orders"))
