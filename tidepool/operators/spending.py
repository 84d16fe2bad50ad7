"""What was spent where, why mails are no receipts, and who one writes with: sums over what the other passes made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.merchants import CONSUMER, display_merchant, sender_domain, trust_sender
from tidepool.operators.nodes import MAIL
from tidepool.operators.purchases import purchase_dedup
from tidepool.registry import ORACLES, query
from tidepool.sources.tables import CHAT_SQL, chat_items, document_items, table

#: How many sender domains and types are listed, and what makes a correspondent.
LISTED, LEAST_SENT, ADDRESSES = 8, 2, 8


def spend(bought: DataFrame, *, merchant: str | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """AGG-16, TOOL-7: (key, merchant, purchases, cents, first_t, last_t) of deduplicated purchases (key, merchant, t, cents), most first.

    ``merchant`` is matched by its key; a merchant has the name that shows it best.
    """
    kept = bought
    if merchant is not None:
        kept = kept.filter(F.startswith("key", T.merchant_key(F.lit(merchant))))
    if since is not None:
        kept = kept.filter(F.col("t") >= since)
    if until is not None:
        kept = kept.filter(F.col("t") <= until)
    grouped = kept.groupBy("key").agg(display_merchant("merchant").alias("merchant"), F.count(F.lit(1)).alias("purchases"), F.sum("cents").alias("cents"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return grouped if limit is None else grouped.orderBy(F.desc("cents"), "key").limit(limit)


def receipt_reason(body: Column, author: Column) -> Column:
    """PUR-1: why a mail is no candidate for a receipt, the first reason that holds."""
    return (
        F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty")
        .when(body.rlike(T.java(T.NO_RECEIPT)), "marketing")
        .when(trust_sender(author).isNotNull(), "untrusted_sender")
        .when(~body.rlike(T.java(T.RECEIPT)), "no_receipt_words")
        .when(~body.rlike(T.java(T.MONEY)), "no_money")
        .otherwise("candidate")
    )


def correspondents(items: DataFrame, least: int = LEAST_SENT) -> DataFrame:
    """AGG-8, AGG-9: (entity, items, received, sent, last, addresses) of (entity, direction, t, address, automated) for people one has written to.

    ``addresses`` are the eight most used, ties to the smaller; those who never
    were written to twice, or are systems, are left out.
    """
    counted = items.groupBy("entity").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("direction") == "inbound").alias("received"), F.count_if(F.col("direction") == "outbound").alias("sent"), F.max("t").alias("last"), F.bool_or(F.coalesce("automated", F.lit(False))).alias("system"))
    used = items.filter("address IS NOT NULL").groupBy("entity", "address").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "address"))
    first = used.withColumn("place", place).filter(F.col("place") <= ADDRESSES).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "address"))), lambda x: x["address"]).alias("addresses"))
    known = counted.filter((F.col("sent") >= least) & ~F.col("system")).drop("system")
    return known.join(first, "entity", "left").withColumn("addresses", F.coalesce("addresses", F.array().cast("array<string>")))


def _listed(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(f"""WITH d AS ({ORACLES['purchase_dedup']}), n AS (SELECT d.*, s_name AS merchant FROM d JOIN supplier ON s_suppkey = split_part(purchase_id, '-', 2)::BIGINT)
SELECT key, arg_min(merchant, (-length(merchant), -length(regexp_replace(merchant, '[^a-z]', '', 'g')), merchant)) AS merchant, count(*) AS purchases, sum(cents)::BIGINT AS cents, min(t) AS first_t, max(t) AS last_t FROM n WHERE t >= 850000000000000 GROUP BY key""")
def spending_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, TOOL-7: spending per merchant since a day, doubles left out."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.col("s_name").alias("merchant"))
    bought = purchase_dedup(spark, sf_dir).withColumn("s_suppkey", F.split_part("purchase_id", F.lit("-"), F.lit(2)).cast("long"))
    return spend(bought.join(names, "s_suppkey"), since=850_000_000_000_000)


_DOMAIN = f"coalesce(regexp_extract(regexp_extract(lower(text), '{MAIL}'), '@(.*)$', 1), '')"
_FUNNEL = f"""f AS (SELECT doc_id, text AS body, CASE WHEN {_DOMAIN} <> '' THEN {_DOMAIN} WHEN lang = 'fr' THEN 'gmail.com' ELSE 'shop.example.org' END AS domain FROM documents),
r AS (SELECT *, CASE WHEN trim(coalesce(body, '')) = '' THEN 'empty' WHEN regexp_matches(body, {T.sql(T.NO_RECEIPT)}) THEN 'marketing' WHEN domain IN ({_listed(CONSUMER)}) THEN 'untrusted_sender' WHEN NOT regexp_matches(body, {T.sql(T.RECEIPT)}) THEN 'no_receipt_words' WHEN NOT regexp_matches(body, {T.sql(T.MONEY)}) THEN 'no_money' ELSE 'candidate' END AS reason FROM f)"""


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, body, author): documents with their first address as the author, or a shop's or a consumer's."""
    address = F.get(F.expr(f"regexp_extract_all(lower(body), '{MAIL}', 0)".replace("\\", "\\\\")), F.lit(0))
    other = F.when(F.col("kind") == "fr", "me@gmail.com").otherwise("orders@shop.example.org")
    return document_items(spark, sf_dir).select("item_id", "body", F.concat(F.lit("A Sender <"), F.coalesce(address, other), F.lit(">")).alias("author"))


@query(f"WITH {_FUNNEL} SELECT reason, count(*) AS items FROM r GROUP BY reason")
def receipt_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-1, AGG-17: how many mails fall out of the search for receipts where."""
    return _mails(spark, sf_dir).groupBy(receipt_reason(F.col("body"), F.col("author")).alias("reason")).agg(F.count(F.lit(1)).alias("items"))


@query(f"WITH {_FUNNEL} SELECT domain, count(*) AS items FROM r WHERE reason = 'untrusted_sender' GROUP BY domain ORDER BY items DESC, domain LIMIT {LISTED}")
def untrusted_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: the domains whose mails are not trusted most often."""
    judged = _mails(spark, sf_dir).filter(receipt_reason(F.col("body"), F.col("author")) == "untrusted_sender")
    return judged.groupBy(sender_domain(F.col("author")).alias("domain")).agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "domain").limit(LISTED)


@query(f"""WITH {CHAT_SQL}, i AS (SELECT thread_id AS entity, direction, t, kind || thread_id % 3 || '@x.org' AS address, thread_id % 13 = 0 AS automated FROM chat WHERE direction = 'inbound' OR thread_id % 7 <> 0),
c AS (SELECT entity, count(*) AS items, count(*) FILTER (direction = 'inbound') AS received, count(*) FILTER (direction = 'outbound') AS sent, max(t) AS last FROM i GROUP BY entity HAVING count(*) FILTER (direction = 'outbound') >= {LEAST_SENT} AND NOT bool_or(automated)),
u AS (SELECT entity, address, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, address) AS place FROM i GROUP BY entity, address) SELECT entity, items, received, sent, last, (SELECT string_agg(address, ',' ORDER BY place) FROM u WHERE u.entity = c.entity AND place <= {ADDRESSES}) AS addresses FROM c""")
def correspondents_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, AGG-9: the people one writes with, and the addresses they use most."""
    items = chat_items(spark, sf_dir).filter("direction = 'inbound' OR thread_id % 7 <> 0")
    address = F.concat("kind", (F.col("thread_id") % 3).cast("string"), F.lit("@x.org"))
    told = items.select(F.col("thread_id").alias("entity"), "direction", "t", address.alias("address"), (F.col("thread_id") % 13 == 0).alias("automated"))
    return correspondents(told).withColumn("addresses", F.array_join("addresses", ","))


@query(f"""WITH p AS (SELECT split_part(p_type, ' ', 1) AS mime, p_size * 1000 AS bytes FROM part), m AS (SELECT mime, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM p GROUP BY mime ORDER BY files DESC, mime LIMIT {LISTED})
SELECT * FROM m UNION ALL SELECT NULL, count(*), sum(bytes)::BIGINT FROM p""")
def attachments_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: attachments in all (a null type), and the eight most frequent types."""
    files = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("mime"), (F.col("p_size") * 1000).cast("long").alias("bytes"))
    totals = [F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")]
    kinds = files.groupBy("mime").agg(*totals).orderBy(F.desc("files"), "mime").limit(LISTED)
    return kinds.unionByName(files.agg(*totals).select(F.lit(None).cast("string").alias("mime"), "files", "bytes"))
