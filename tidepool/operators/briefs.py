"""What is said unprompted: due observations, those that another one covers left out, weighed and cut to a budget.

An observation is covered if all of its evidence is evidence of a better one
(more evidence, then more salience, then the smaller id).  As covering goes on
from set to larger set, being covered by a dropped one means being covered by a
kept one, so nothing has to be decided in turn: every set meets only the sets
that hold its rarest evidence, and that is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.tables import micros, table

#: How many observations a brief says, and how many more are looked at.
BUDGET, SPARE = 3, 25
DAY = 86_400_000_000
OPEN_STATES = ("pending", "surfaced")


def open_observations(observations: DataFrame, detector: str | None = None) -> DataFrame:
    """BRF-5: observations that are pending or surfaced, of one detector or of all."""
    found = observations.filter(F.col("state").isin(*OPEN_STATES))
    return found if detector is None else found.filter(F.col("detector") == detector)


def due_observations(observations: DataFrame, suppressed: DataFrame, now: int, most: int) -> DataFrame:
    """TOP-8: of each principal the most salient pending observations whose time is now, without those of silenced detectors.

    ``observations`` has (principal, id, detector, state, salience, earliest, expires, evidence); an end that is null is open.
    """
    timely = observations.filter("state = 'pending'").filter((F.coalesce("earliest", F.lit(now)) <= now) & (F.coalesce("expires", F.lit(now)) >= now))
    heard = timely.join(suppressed.select("detector").distinct(), "detector", "left_anti")
    rank = F.row_number().over(Window.partitionBy("principal").orderBy(F.desc("salience"), "id"))
    return heard.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def hydrated(observations: DataFrame, items: DataFrame) -> DataFrame:
    """BRF-1: (principal, id, salience, evidence, weight): evidence that is still there, and the greatest weight among it (1 without any).

    ``items`` has (item, weight), the live ones; a null weight is 1.
    """
    told = observations.select("principal", "id", "salience", F.explode_outer(F.array_distinct("evidence")).alias("item"))
    held = told.join(items.select("item", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.lit(True).alias("live")), "item", "left")
    gathered = held.groupBy("principal", "id").agg(F.first("salience").alias("salience"), F.array_sort(F.collect_set(F.when(F.col("live"), F.col("item")))).alias("evidence"), F.max("weight").alias("weight"))
    return gathered.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def without_covered(observations: DataFrame) -> DataFrame:
    """DED-4, SET-4: the observations (principal, id, salience, evidence) that no better one covers; those without evidence stay."""
    sets = observations.select("principal", "id", "salience", F.array_distinct("evidence").alias("evidence")).withColumn("size", F.size("evidence"))
    held = sets.select("principal", "id", F.explode("evidence").alias("item"))
    counted = held.groupBy("principal", "item").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(counted, ["principal", "item"]).groupBy("principal", "id").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    small = sets.join(rarest, ["principal", "id"]).select("principal", "item", F.col("id").alias("a"), F.struct("size", "salience", F.col("evidence").alias("e")).alias("x"))
    large = sets.select("principal", F.col("id").alias("b"), F.struct("size", "salience", F.col("evidence").alias("e")).alias("y"), F.explode("evidence").alias("item"))
    met = small.join(large, ["principal", "item"])
    bigger = F.col("y.size") > F.col("x.size")
    before = (F.col("y.size") == F.col("x.size")) & ((F.col("y.salience") > F.col("x.salience")) | ((F.col("y.salience") == F.col("x.salience")) & (F.col("b") < F.col("a"))))
    covered = met.filter((bigger | before) & (F.size(F.array_except("x.e", "y.e")) == 0)).select("principal", F.col("a").alias("id")).distinct()
    return observations.join(covered, ["principal", "id"], "left_anti")


def compose(observations: DataFrame, items: DataFrame, suppressed: DataFrame, now: int, budget: int = BUDGET) -> DataFrame:
    """BRF-1, TOOL-5: (principal, id, rank, salience, evidence, withheld): what a brief says, and how much is held back.

    Covered observations go before the budget, so three views of one matter do
    not use it up; weights change the order only.  Nothing is written, so the
    same is a preview.
    """
    distinct = without_covered(hydrated(due_observations(observations, suppressed, now, budget + SPARE), items))
    weighed = distinct.withColumn("salience", F.round(F.col("salience") * F.col("weight"), 6))
    order = Window.partitionBy("principal").orderBy(F.desc("salience"), "id")
    ranked = weighed.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("withheld", F.greatest(F.count(F.lit(1)).over(Window.partitionBy("principal")) - budget, F.lit(0)))
    return ranked.filter(F.col("rank") <= budget).select("principal", "id", "rank", "salience", "evidence", "withheld")


def surfaced(observations: DataFrame, brief: DataFrame) -> DataFrame:
    """BRF-1, BRF-4: the observations with those that a brief said marked; covered ones are left as they are."""
    said = brief.select("principal", "id").withColumn("said", F.lit(True))
    joined = observations.join(said, ["principal", "id"], "left")
    return joined.withColumn("state", F.when(F.coalesce("said", F.lit(False)) & (F.col("state") == "pending"), "surfaced").otherwise(F.col("state"))).drop("said")


# --- queries over orders as observations and suppliers as their evidence ----------

_SPAN = 2000 * DAY


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a customer's observations: a priority is a detector, suppliers are evidence."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("evidence"))
    made = micros("o_orderdate")
    state = F.when(F.col("o_orderstatus") == "P", "dismissed").otherwise("pending")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("principal"), F.col("o_orderpriority").alias("detector"), state.alias("state"), F.round(F.col("o_totalprice") / 600_000, 4).alias("salience"), made.alias("earliest"), (made + _SPAN).alias("expires"))
    return orders.join(lines, "o_orderkey", "left").select("principal", F.col("o_orderkey").alias("id"), "detector", "state", "salience", "earliest", "expires", F.coalesce("evidence", F.array().cast("array<bigint>")).alias("evidence"))


def _evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 13 <> 0").select(F.col("s_suppkey").alias("item"), F.when(F.col("s_suppkey") % 4 == 0, 0.25).alias("weight"))


_NOW = 990_000_000_000_000
_HYDRATED = f"""o AS (SELECT o_custkey AS principal, o_orderkey AS id, round(o_totalprice / 600000, 4) AS salience, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 600000, 4) DESC, o_orderkey) AS n FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND epoch_us(o_orderdate) <= {_NOW} AND epoch_us(o_orderdate) + {_SPAN} >= {_NOW} QUALIFY n <= {BUDGET + SPARE}),
ev AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey)) AS e, max(CASE WHEN l_suppkey % 4 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM lineitem WHERE l_suppkey % 13 <> 0 GROUP BY l_orderkey),
h AS (SELECT principal, o.id, salience, coalesce(e, []) AS e, coalesce(weight, 1.0::DOUBLE) AS weight, row_number() OVER (PARTITION BY principal ORDER BY len(coalesce(e, [])) DESC, salience DESC, o.id) AS n FROM o LEFT JOIN ev USING (id)),
turn(principal, n, kept, ids) AS (SELECT DISTINCT principal, 0::BIGINT, [[]::BIGINT[]][2:], []::BIGINT[] FROM h
  UNION ALL SELECT h.principal, h.n, CASE WHEN ok THEN list_append(kept, h.e) ELSE kept END, CASE WHEN ok THEN list_append(ids, h.id) ELSE ids END
  FROM (SELECT t.principal, t.n, t.kept, t.ids, x.id, x.e, len(x.e) = 0 OR len(list_filter(t.kept, lambda k: list_has_all(k, x.e))) = 0 AS ok FROM turn t JOIN h x ON x.principal = t.principal AND x.n = t.n + 1) AS s JOIN h ON h.principal = s.principal AND h.id = s.id),
kept AS (SELECT principal, unnest(arg_max(ids, n)) AS id FROM turn GROUP BY principal)"""


@query(f"""WITH RECURSIVE {_HYDRATED}, w AS (SELECT principal, id, round(salience * weight, 6) AS salience, len(e) AS evidence FROM kept JOIN h USING (principal, id))
SELECT principal, id, row_number() OVER (PARTITION BY principal ORDER BY salience DESC, id) AS rank, salience, evidence, greatest(count(*) OVER (PARTITION BY principal) - {BUDGET}, 0) AS withheld FROM w QUALIFY rank <= {BUDGET}""")
def briefs_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-1, DED-4, TOP-8, TOOL-5: everybody's brief, against a recursion that goes through the observations one by one."""
    silenced = spark.range(1).select(F.lit("5-LOW").alias("detector"))
    made = compose(observations(spark, sf_dir), _evidence_items(spark, sf_dir), silenced, _NOW)
    return made.withColumn("evidence", F.size("evidence").cast("long"))


@query("""WITH e AS (SELECT o_custkey AS principal, o_orderkey AS id, round(o_totalprice / 600000, 4) AS salience, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_suppkey IS NOT NULL)), []) AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT x.principal, x.id FROM e x WHERE len(x.e) = 0 OR NOT EXISTS (SELECT 1 FROM e y WHERE y.principal = x.principal AND list_has_all(y.e, x.e) AND (len(y.e) > len(x.e) OR (len(y.e) = len(x.e) AND (y.salience > x.salience OR (y.salience = x.salience AND y.id < x.id)))))""")
def evidence_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-4, DED-4: of all observations of a principal, those that no better one covers."""
    return without_covered(observations(spark, sf_dir)).select("principal", "id")


@query("SELECT o_orderpriority AS detector, count(*) AS open, round(avg(round(o_totalprice / 600000, 4)), 6) AS salience, min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority")
def observations_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-5: what is open, by detector."""
    return open_observations(observations(spark, sf_dir)).groupBy("detector").agg(F.count(F.lit(1)).alias("open"), F.round(F.avg("salience"), 6).alias("salience"), F.min("id").alias("first"))
