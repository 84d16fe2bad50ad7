"""Items by their natural keys: ids that follow from them, what a page of rows changes, and what has to be derived again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.upserts import content_hash
from tidepool.registry import query
from tidepool.sources.tables import table

#: What makes an item the same as before, and what is derived from it.
CONTENT = ["title", "body", "author", "participants", "starts", "ends", "state", "due", "recurrence"]
VERSIONS = ["derived_version", "derived_at", "entities_version", "classified_version", "relationships_version", "references_version", "episode_version", "commitment_version", "projection_version"]


def item_id(account: Column, external: Column) -> Column:
    """KEY-1: an item's id follows from its source, so reading it again never doubles it."""
    return F.substring(F.sha2(F.concat(account.cast("string"), F.lit("\0"), external.cast("string")), 256), 1, 24)


def chunk_id(item: Column, ordinal: Column) -> Column:
    """KEY-1."""
    return F.concat(item, F.lit(":"), ordinal.cast("string"))


def identifier_id(kind: Column, normalized: Column) -> Column:
    """KEY-1."""
    return F.concat(kind, F.lit(":"), normalized)


def upsert_items(store: DataFrame, page: DataFrame) -> DataFrame:
    """SNK-1, DED-1, INC-1: the store after a page: (item_id, CONTENT, content_hash, deleted, VERSIONS, change).

    ``page`` has (account_id, external_id, CONTENT, seen); of a key that comes
    twice the last seen counts.  What is the same as before is not touched;
    what has changed, or comes back after its deletion, loses all versions and
    so is derived again.
    """
    keyed = page.select(item_id(F.col("account_id"), F.col("external_id")).alias("item_id"), F.struct(*CONTENT, content_hash(*CONTENT).alias("content_hash")).alias("n"), "seen")
    new = keyed.groupBy("item_id").agg(F.max_by("n", F.struct("seen", "n.content_hash")).alias("n"))
    old = store.select("item_id", F.struct(*CONTENT, "content_hash", "deleted", *VERSIONS).alias("o"))
    both = old.join(new, "item_id", "full")
    same = F.col("n").isNull() | (F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")) & F.col("o.deleted").isNull() & F.col("o").isNotNull())
    change = F.when(F.col("n").isNull(), "absent").when(F.col("o").isNull(), "insert").when(same, "unchanged").otherwise("update")
    content = [F.when(same, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in (*CONTENT, "content_hash")]
    return both.select("item_id", *content, F.when(same, F.col("o.deleted")).alias("deleted"), *(F.when(same, F.col(f"o.{c}")).alias(c) for c in VERSIONS), change.alias("change"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """UPS-2: the rows of old, and of new those whose key is not there, the first of each key."""
    rest = [c for c in old.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti"))


def _blank(df: DataFrame) -> DataFrame:
    """The columns of content that documents do not have."""
    return df.withColumns({"author": F.lit(None).cast("string"), "participants": F.array().cast("array<string>"), "ends": F.lit(None).cast("long"), "state": F.lit(None).cast("string"), "due": F.lit(None).cast("long"), "recurrence": F.lit(None).cast("string")})


@query("""WITH o AS (SELECT substr(sha256(source || chr(0) || doc_id), 1, 24) AS item_id, doc_id, doc_id % 31 = 0 AS gone FROM documents), n AS (SELECT item_id, doc_id % 9 = 0 AS changed, false AS fresh FROM o WHERE doc_id % 4 <> 3 UNION ALL SELECT substr(sha256(source || chr(0) || (doc_id + 1000000)), 1, 24), false, true FROM documents WHERE doc_id % 10 = 0)
SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN n.item_id IS NULL THEN 'absent' WHEN o.item_id IS NULL THEN 'insert' WHEN changed OR gone THEN 'update' ELSE 'unchanged' END AS change, CASE WHEN n.item_id IS NULL OR (o.item_id IS NOT NULL AND NOT changed AND NOT gone) THEN 2 END AS derived_version, CASE WHEN n.item_id IS NULL OR (o.item_id IS NOT NULL AND NOT changed AND NOT gone) THEN 4 END AS projection_version,
n.item_id IS NULL AND gone AS deleted FROM o FULL JOIN n USING (item_id)""")
def items_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, KEY-1, DED-1, INC-1: a store of documents after a page in which some are changed, some are new, and some come twice."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("account_id"), "doc_id", F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), F.col("doc_id").alias("starts"))
    whole = _blank(docs)
    versions = {c: F.lit(4 if c == "projection_version" else 2).cast("long") for c in VERSIONS}
    store = whole.select(item_id(F.col("account_id"), F.col("doc_id")).alias("item_id"), *CONTENT, content_hash(*CONTENT).alias("content_hash"), F.when(F.col("doc_id") % 31 == 0, F.lit(9).cast("long")).alias("deleted")).withColumns(versions)
    again = whole.filter("doc_id % 4 <> 3").withColumn("body", F.when(F.col("doc_id") % 9 == 0, F.concat(F.coalesce("body", F.lit("")), F.lit("!"))).otherwise(F.col("body")))
    fresh = whole.filter("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    earlier = again.filter("doc_id % 20 = 1").withColumn("body", F.lit("an earlier form"))
    page = again.unionByName(fresh).withColumn("seen", F.lit(2)).unionByName(earlier.withColumn("seen", F.lit(1))).withColumnRenamed("doc_id", "external_id")
    return upsert_items(store, page).select("item_id", "change", "derived_version", "projection_version", F.col("deleted").isNotNull().alias("deleted"))


@query("""WITH old AS (SELECT l_orderkey AS item, l_suppkey AS entity, 'author' AS role FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)), new AS (SELECT l_orderkey AS item, l_suppkey AS entity, arg_min(CASE WHEN l_linenumber = 1 THEN 'other' WHEN l_linenumber % 2 = 0 THEN 'recipient' ELSE 'copied' END, l_linenumber) AS role FROM lineitem GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.item = n.item AND o.entity = n.entity)""")
def links_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-2: links of items to people, those there are left as they are."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("entity"), "l_linenumber")
    old = lines.filter("l_linenumber = 1").select("item", "entity").distinct().withColumn("role", F.lit("author"))
    role = F.when(F.col("l_linenumber") == 1, "other").when(F.col("l_linenumber") % 2 == 0, "recipient").otherwise("copied")
    return insert_new(old, lines.withColumn("role", role), ["item", "entity"], F.col("l_linenumber"))
