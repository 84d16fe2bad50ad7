"""Noise: templates that a sender repeats, senders that only broadcast, and what is left without them.

A document's sender is its first address, its recipients are the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.nodes import MAIL
from tidepool.registry import query
from tidepool.sources.tables import table

#: How often a sender has to use a shape of title for it to be a template, and how long a shape is at least.
TEMPLATE, SHAPE = 5, 3


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, sender, recipients, title, t, outbound) of documents that hold an address."""
    found = F.expr(f"regexp_extract_all(lower(text), '{MAIL}', 0)".replace("\\", "\\\\"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), found.alias("a"), F.substring("text", 1, 12).alias("title")).filter("size(a) > 0")
    host = F.substring_index(F.element_at("a", 1), "@", -1)
    return rows.select("item", host.alias("sender"), F.transform(F.slice("a", 2, 1_000_000), lambda x: F.substring_index(x, "@", -1)).alias("recipients"), "title", (F.col("item") % 4 == 0).alias("outbound"))


_MAILS = f"""fa AS (SELECT doc_id AS item, regexp_extract_all(lower(text), '{MAIL}') AS a, substr(text, 1, 12) AS title FROM documents),
mails AS (SELECT item, regexp_extract(a[1], '@([^@]*)$', 1) AS sender, list_transform(a[2:], lambda x: regexp_extract(x, '@([^@]*)$', 1)) AS recipients, title, item % 4 = 0 AS outbound FROM fa WHERE len(a) > 0)"""
_SHAPE = "trim(regexp_replace(regexp_replace(lower(title), '[$£€]?[0-9][0-9,.:/-]*', '#', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


def templates(rows: DataFrame) -> DataFrame:
    """NOI-2: inbound items whose sender has used the same shape of title TEMPLATE times or more."""
    shaped = rows.filter("NOT outbound").withColumn("shape", T.title_shape(F.col("title"))).filter(F.char_length("shape") >= SHAPE)
    often = shaped.groupBy("sender", "shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TEMPLATE)
    return shaped.join(often, ["sender", "shape"]).select("item", "sender", "shape", "n")


def broadcasters(rows: DataFrame) -> DataFrame:
    """NOI-3: senders that nobody here ever wrote to, or whose name says that nobody reads the answer."""
    written = rows.filter("outbound").select(F.explode("recipients").alias("sender")).distinct()
    silent = rows.select("sender").distinct().join(written, "sender", "left_anti")
    named = rows.filter(F.col("sender").rlike(T.NO_REPLY)).select("sender")
    return silent.union(named).distinct()


def repeated(rows: DataFrame) -> DataFrame:
    """NOI-4: all but the first item of each title of a sender."""
    nth = F.row_number().over(Window.partitionBy("sender", F.lower(F.trim("title"))).orderBy("item"))
    return rows.withColumn("nth", nth).filter("nth > 1").select("item")


def noisy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NOI-5: items that are templates (of a sender, or repeats), and items that are broadcast (by their sender, or as templates)."""
    shaped = templates(rows).select("item")
    sent = rows.join(broadcasters(rows), "sender", "left_semi").select("item")
    return shaped.union(repeated(rows)).distinct(), sent.union(shaped).distinct()


_TEMPLATES = f"sh AS (SELECT item, sender, {_SHAPE} AS shape FROM mails WHERE NOT outbound), tp AS (SELECT item, sender, shape, count(*) OVER (PARTITION BY sender, shape) AS n FROM sh WHERE length(shape) >= {SHAPE} QUALIFY n >= {TEMPLATE})"
_BROADCAST = f"wr AS (SELECT DISTINCT unnest(recipients) AS sender FROM mails WHERE outbound), bc AS (SELECT DISTINCT sender FROM mails WHERE sender NOT IN (SELECT sender FROM wr) OR regexp_matches(sender, {T.sql(T.NO_REPLY)}))"


@query(f"WITH {_MAILS}, {_TEMPLATES} SELECT item, sender, shape, n FROM tp")
def mail_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOI-2: mails that are templates of their sender."""
    return templates(mails(spark, sf_dir))


@query(f"WITH {_MAILS}, {_BROADCAST} SELECT sender FROM bc")
def mail_broadcasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOI-3: senders that only broadcast."""
    return broadcasters(mails(spark, sf_dir))


@query(f"""WITH {_MAILS}, {_TEMPLATES}, {_BROADCAST}, rp AS (SELECT item FROM mails QUALIFY row_number() OVER (PARTITION BY sender, lower(trim(title)) ORDER BY item) > 1)
SELECT item, item IN (SELECT item FROM tp UNION SELECT item FROM rp) AS template, sender IN (SELECT sender FROM bc) OR item IN (SELECT item FROM tp) AS broadcast FROM mails""")
def mail_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOI-5: every mail, whether it is a template and whether it is broadcast."""
    rows = mails(spark, sf_dir)
    shaped, sent = noisy(rows)
    marked = rows.select("item").join(shaped.withColumn("template", F.lit(True)), "item", "left").join(sent.withColumn("broadcast", F.lit(True)), "item", "left")
    return marked.select("item", F.coalesce("template", F.lit(False)).alias("template"), F.coalesce("broadcast", F.lit(False)).alias("broadcast"))


def first_chunk_header(kind: Column, title: Column, author: Column, body: Column) -> Column:
    """CHK-3: a first chunk under a header of title and author; the header alone where there is no body."""
    named = F.when(kind == "event", F.concat(F.lit("Event: "), title)).otherwise(title)
    return F.concat_ws("\n", F.nullif(named, F.lit("")), F.when(author.isNotNull(), F.concat(F.lit("From: "), author)), F.nullif(body, F.lit("")))


@query("SELECT doc_id, md5(concat_ws(chr(10), nullif(CASE WHEN lang = 'en' THEN 'Event: ' || substr(text, 1, 30) ELSE substr(text, 1, 30) END, ''), 'From: ' || source, nullif(substr(text, 31), ''))) AS digest FROM documents")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-3: documents' first chunks with their headers."""
    body = F.expr("substr(text, 31)")
    kind = F.when(F.col("lang") == "en", "event").otherwise("message")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(first_chunk_header(kind, F.substring("text", 1, 30), F.col("source"), body)).alias("digest"))
