"""Passes with a budget: what goes to a model next, and what became of it, kept as sums per item.

A pass looks at the newest items that are not done; what cannot be a candidate
is marked for nothing, and the first so many of the rest go to a model.  What
failed is tried again one tier up, and given up after three failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.plans.lineage import scratch
from tidepool.registry import query
from tidepool.sources.tables import DOCUMENTS_SQL, document_items, table

#: How many items a pass looks at, failures until it gives up, and the highest tier.
POOL, MOST_FAILURES, HIGHEST = 4000, 3, 3
_ATTEMPT = "item long, attempt long, tier int, ok boolean"


def candidates(items: DataFrame, fits: Column, limit: int, pool: int = POOL) -> DataFrame:
    """PUR-14, COM-13: (item, verdict) of the newest ``pool`` of (item, t) that are not done: ``candidate`` or ``uninteresting``.

    Only the first ``limit`` that fit are candidates; those that fit beyond are
    left for the next pass and not returned.  Ties in time go to the smaller item.
    """
    newest = items.select("item", "t", F.coalesce(fits, F.lit(False)).alias("fits")).orderBy(F.desc("t"), "item").limit(pool)
    place = F.sum(F.col("fits").cast("int")).over(Window.orderBy(F.desc("t"), "item").rowsBetween(Window.unboundedPreceding, 0))
    judged = newest.withColumn("place", place)
    return judged.filter(~F.col("fits") | (F.col("place") <= limit)).select("item", F.when(F.col("fits"), "candidate").otherwise("uninteresting").alias("verdict"))


def judged(done: Column, failures: Column, tier: Column) -> tuple[Column, Column]:
    """The outcome of an item's attempts, and the tier of the next."""
    outcome = F.when(done, "done").when(failures >= MOST_FAILURES, "given_up").otherwise("retry")
    return outcome, F.when(done | (failures >= MOST_FAILURES), tier).otherwise(F.least(tier + 1, F.lit(HIGHEST)))


def _sums() -> list[Column]:
    """What is kept of an item's attempts."""
    return [F.count_if(~F.col("ok")).alias("failures"), F.max("tier").cast("int").alias("highest"), F.bool_or("ok").alias("done")]


def _outcomes(counted: DataFrame) -> DataFrame:
    outcome, tier = judged(F.col("done"), F.col("failures"), F.col("highest"))
    return counted.select("item", "failures", tier.cast("int").alias("tier"), outcome.alias("outcome"))


def outcomes(log: DataFrame) -> DataFrame:
    """PUR-13: (item, failures, tier, outcome) of a log of attempts (attempt, item, tier, ok), each attempt counted once."""
    return _outcomes(log.dropDuplicates(["attempt"]).groupBy("item").agg(*_sums()).withColumn("failures", F.col("failures").cast("int")))


def follow(stream: DataFrame, store: str) -> None:
    """Fold a stream of attempts into what is kept of every item under ``store``; goes on where it stopped.

    A batch holds its attempts against those of all batches before, so a
    repeated one is told however late it comes; of the rest it writes each
    item's sums, which :func:`states` adds up.  A batch that is done again
    writes the same again.
    """
    key = F.struct("item", "attempt")

    def save(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{store}/attempts"
        new = batch.withColumn("key", key).dropDuplicates(["key"])
        if number:
            earlier = spark.read.schema(f"{_ATTEMPT}, batch int").parquet(folder).filter(F.col("batch") < number)
            new = new.join(earlier.select(key.alias("key")), "key", "left_anti")
        new.select("item", "attempt", "tier", "ok").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        heard = spark.read.schema(_ATTEMPT).parquet(f"{folder}/batch={number}")
        heard.groupBy("item").agg(*_sums()).write.mode("overwrite").parquet(f"{store}/states/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, store: str) -> DataFrame:
    """(item, failures, tier, outcome): the last state of every item."""
    log = spark.read.schema("item long, failures long, highest int, done boolean").parquet(f"{store}/states")
    counted = log.groupBy("item").agg(F.sum("failures").cast("int").alias("failures"), F.max("highest").alias("highest"), F.bool_or("done").alias("done"))
    return _outcomes(counted)


@query(f"""WITH {DOCUMENTS_SQL}, n AS (SELECT item_id AS item, coalesce(contains(body, '@') OR length(body) > 2000, false) AS fits FROM items WHERE item_id % 3 <> 0 ORDER BY item_id DESC LIMIT {POOL}),
p AS (SELECT *, sum(fits::INTEGER) OVER (ORDER BY item DESC) AS place FROM n) SELECT item, CASE WHEN fits THEN 'candidate' ELSE 'uninteresting' END AS verdict FROM p WHERE NOT fits OR place <= 60""")
def candidates_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-14, COM-13: the documents a model reads next, and those it need not read, a third being done."""
    items = document_items(spark, sf_dir).filter("item_id % 3 <> 0").select(F.col("item_id").alias("item"), F.col("item_id").alias("t"), "body")
    return candidates(items, F.contains("body", F.lit("@")) | (F.char_length("body") > 2000), 60)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as attempts at a part's extraction, few of which succeed."""
    ok = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 5) & (F.col("l_quantity") < 12)
    number = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(number.alias("attempt"), F.col("l_partkey").alias("item"), (F.col("l_linenumber") % 3).cast("int").alias("tier"), ok.alias("ok"))


@query(f"""WITH a AS (SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS attempt, l_partkey AS item, l_linenumber % 3 AS tier, l_returnflag = 'A' AND l_linenumber > 5 AND l_quantity < 12 AS ok FROM lineitem),
c AS (SELECT item, count(*) FILTER (NOT ok) AS failures, max(tier) AS highest, bool_or(ok) AS done FROM a GROUP BY item)
SELECT item, failures::INTEGER AS failures, (CASE WHEN done OR failures >= {MOST_FAILURES} THEN highest ELSE least(highest + 1, {HIGHEST}) END)::INTEGER AS tier, CASE WHEN done THEN 'done' WHEN failures >= {MOST_FAILURES} THEN 'given_up' ELSE 'retry' END AS outcome FROM c""")
def attempts_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-13: attempts streamed in three batches of files, some twice, and what became of every item."""
    store = scratch(spark, "passes")
    made = _attempts(spark, sf_dir)
    made.unionByName(made.filter("attempt % 11 = 0")).repartition(48, F.xxhash64("attempt", F.rand(5))).write.parquet(f"{store}/source")
    follow(spark.readStream.schema("attempt long, item long, tier int, ok boolean").option("maxFilesPerTrigger", 16).parquet(f"{store}/source"), store)
    return states(spark, store)
