"""The evidence-carrying graph: edges, their components and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.components import components
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import micros, table

#: Edges below this confidence join nothing together.
JOINS = 0.45
#: A value held by more nodes than this links none of them.
MOST_HOLDERS = 8


def shared_value_edges(held: DataFrame, kind: str, confidence: float) -> DataFrame:
    """Edges between nodes that hold the same value; (value, node) in, values of many holders left out first.

    Each holder is linked to the holders after it, so a value of n holders
    makes n (n - 1) / 2 edges, at most 28.
    """
    distinct = cut(held.distinct())
    # Holders are counted before any are collected, so a value of very many is dropped as a number.
    counted = distinct.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, MOST_HOLDERS)).select("value")
    few = distinct.join(counted, "value", "left_semi").groupBy("value").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    pairs = few.select("value", F.posexplode("nodes").alias("at", "a"), "nodes").select("value", "a", F.explode(F.expr("slice(nodes, at + 2, 8)")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("value").alias("first_value")).select("a", "b", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.concat(F.lit("both hold "), F.col("first_value").cast("string")).alias("evidence"))


def strongest(edges: DataFrame) -> DataFrame:
    """One edge per pair and kind under a key of its own: the strongest, ties to the smaller evidence."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    merged = edges.groupBy(a.alias("a"), b.alias("b"), "kind").agg(F.max("confidence").alias("confidence"), F.min_by("evidence", F.struct(-F.col("confidence"), "evidence")).alias("evidence"))
    key = F.concat(F.lit("r_"), F.substring(F.sha2(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), "kind"), 256), 1, 20))
    return merged.withColumn("edge_id", key)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked by the same part shipped on one day, or by the same part and supplier within a month."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.expr("date_format(l_shipdate, 'yyyyMMdd')"))
    same_day = lines.select(F.concat_ws(":", F.col("l_partkey").cast("string"), "day").alias("value"), F.col("l_orderkey").alias("node"))
    same_source = lines.select(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.substring("day", 1, 6)).alias("value"), F.col("l_orderkey").alias("node"))
    return cut(strongest(shared_value_edges(same_day, "shares_reference", 0.95).unionByName(shared_value_edges(same_source, "about_same", 0.4))))


_EDGES = f"""l AS (SELECT l_orderkey AS node, l_partkey::VARCHAR AS p, l_suppkey::VARCHAR AS s, strftime(l_shipdate, '%Y%m%d') AS day FROM lineitem),
held AS (SELECT DISTINCT 'shares_reference' AS kind, 0.95::DOUBLE AS confidence, p || ':' || day AS value, node FROM l UNION ALL SELECT DISTINCT 'about_same', 0.4::DOUBLE, p || ':' || s || ':' || substr(day, 1, 6), node FROM l),
few AS (SELECT kind, value FROM held GROUP BY ALL HAVING count(*) BETWEEN 2 AND {MOST_HOLDERS}),
h AS (SELECT held.* FROM held JOIN few USING (kind, value)),
edges AS (SELECT x.node AS a, y.node AS b, kind, max(x.confidence) AS confidence, 'both hold ' || min(value) AS evidence FROM h x JOIN h y USING (kind, value) WHERE x.node < y.node GROUP BY x.node, y.node, kind)"""


@query(f"WITH {_EDGES} SELECT 'r_' || substr(sha256(a || '|' || b || '|' || kind), 1, 20) AS edge_id, a, b, kind, confidence, evidence FROM edges")
def edge_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-8, JOI-12, GRF-3: edges of orders that share a value, each pair once."""
    return _edges(spark, sf_dir)


@query(f"WITH {_EDGES} SELECT kind, count(*) AS edges, count(DISTINCT a) AS sources, round(avg(confidence), 6) AS confidence FROM edges GROUP BY kind")
def edge_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6: edges by kind."""
    return _edges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("a").alias("sources"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"WITH {_EDGES} SELECT p.o_orderpriority AS a_stream, q.o_orderpriority AS b_stream, count(*) AS edges FROM edges JOIN orders p ON p.o_orderkey = a JOIN orders q ON q.o_orderkey = b WHERE p.o_orderpriority <> q.o_orderpriority GROUP BY ALL")
def cross_source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6: edges between orders of different streams (here: priorities)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    edges = _edges(spark, sf_dir).select("a", "b")
    named = edges.join(orders.toDF("a", "a_stream"), "a").join(orders.toDF("b", "b_stream"), "b")
    return named.filter("a_stream <> b_stream").groupBy("a_stream", "b_stream").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {_EDGES}, two_ways AS (SELECT a AS node, b AS other, kind, confidence, evidence FROM edges UNION ALL SELECT b, a, kind, confidence, evidence FROM edges)
SELECT node, other, first(kind ORDER BY confidence DESC, kind) AS kind, max(confidence) AS confidence, count(*) - 1 AS also FROM two_ways GROUP BY node, other""")
def related_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-9, TOOL-11: each node's neighbours with the best edge and how many more there are."""
    edges = _edges(spark, sf_dir)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "kind", "confidence").union(edges.select("b", "a", "kind", "confidence"))
    return both.groupBy("node", "other").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("kind"), F.max("confidence").alias("confidence"), (F.count(F.lit(1)) - 1).alias("also"))


def situations(edges: DataFrame) -> DataFrame:
    """(node, situation): connected components over the edges that are strong enough."""
    return components(edges.filter(F.col("confidence") >= JOINS)).select("node", F.col("component").alias("situation"))


_COMPONENTS = f"""{_EDGES}, lk AS (SELECT a AS u, b AS v FROM edges WHERE confidence >= {JOINS} UNION SELECT b, a FROM edges WHERE confidence >= {JOINS}),
low(node, least) AS (SELECT u, u FROM lk UNION SELECT lk.v, low.least FROM low JOIN lk ON lk.u = low.node WHERE lk.v > low.least),
members AS (SELECT node, min(least) AS situation FROM low GROUP BY node)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, situation FROM members")
def situation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-12, SET-1: which situation each connected order belongs to."""
    return situations(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COMPONENTS}, o AS (SELECT o_orderkey AS node, o_orderpriority AS stream, o_orderstatus AS kind, epoch_us(o_orderdate) AS t FROM orders), nw AS (SELECT max(t) AS now FROM o),
gr AS (SELECT situation, count(*) AS members, count(DISTINCT stream) AS streams, count(DISTINCT kind) AS kinds, max(t) AS last, arg_min(node, (t, node)) AS first_node FROM members JOIN o USING (node) GROUP BY situation)
SELECT situation, members, streams, kinds, first_node, round((streams - 1) * 0.4 + (kinds - 1) * 0.25 + least(0.2, log10(members + 1) * 0.1) + greatest(0.0, 0.4 - (now - last) / 86400000000.0 * 0.008), 4)::DOUBLE AS salience FROM gr, nw WHERE members BETWEEN 2 AND 40 AND streams >= 2""")
def situation_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-13 to GRF-15, TOP-3: situations of 2 to 40 members in two streams or more, by salience."""
    members = cut(situations(_edges(spark, sf_dir)))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("stream"), F.col("o_orderstatus").alias("kind"), micros("o_orderdate").alias("t"))
    now = orders.agg(F.max("t").alias("now"))
    grouped = members.join(orders, "node").groupBy("situation").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("stream").alias("streams"), F.countDistinct("kind").alias("kinds"), F.max("t").alias("last"), F.min_by("node", F.struct("t", "node")).alias("first_node"))
    kept = grouped.filter("members BETWEEN 2 AND 40 AND streams >= 2").crossJoin(F.broadcast(now))
    age = (F.col("now") - F.col("last")) / 86_400_000_000.0
    score = (F.col("streams") - 1) * 0.4 + (F.col("kinds") - 1) * 0.25 + F.least(F.lit(0.2), F.log10(F.col("members") + 1) * 0.1) + F.greatest(F.lit(0.0), 0.4 - age * 0.008)
    return kept.select("situation", "members", "streams", "kinds", "first_node", F.round(score, 4).alias("salience"))


def carry_over(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Give proposed situations the ids of existing ones they overlap: two members and half of the smaller at least.

    Both have (id, node).  Every situation is matched once: a pair counts when
    each is the other's best, by shared members, share and id; what that leaves
    is matched again until nothing is.
    """
    sizes_new = proposed.groupBy("id").agg(F.count(F.lit(1)).alias("size_new"))
    sizes_old = existing.groupBy("id").agg(F.count(F.lit(1)).alias("size_old"))
    shared = proposed.toDF("new_id", "node").join(existing.toDF("old_id", "node"), "node").groupBy("new_id", "old_id").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(sizes_new.withColumnRenamed("id", "new_id"), "new_id").join(sizes_old.withColumnRenamed("id", "old_id"), "old_id")
    open_pairs = cut(sized.withColumn("ratio", F.col("shared") / F.least("size_new", "size_old")).filter("shared >= 2 AND ratio >= 0.5").select("new_id", "old_id", "shared", "ratio"))
    matched = None
    while open_pairs.take(1):
        order = [F.desc("shared"), F.desc("ratio"), F.asc("old_id"), F.asc("new_id")]
        best = open_pairs.withColumn("n", F.row_number().over(Window.partitionBy("new_id").orderBy(*order))).withColumn("o", F.row_number().over(Window.partitionBy("old_id").orderBy(*order)))
        found = cut(best.filter("n = 1 AND o = 1").select("new_id", "old_id"))
        matched = found if matched is None else matched.unionByName(found)
        open_pairs = cut(open_pairs.join(found.select("new_id"), "new_id", "left_anti").join(found.select("old_id"), "old_id", "left_anti"))
    return matched if matched is not None else open_pairs.select("new_id", "old_id")


#: The greedy matching of DuckDB's side: candidates one by one in their order, each side taken once.
_CARRIED = f"""WITH RECURSIVE {_COMPONENTS}, old_edges AS (SELECT e.* FROM edges e JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b WHERE x.o_orderdate < '2000-01-01' AND y.o_orderdate < '2000-01-01' AND confidence >= {JOINS}),
ok AS (SELECT a AS u, b AS v FROM old_edges UNION SELECT b, a FROM old_edges), olow(node, least) AS (SELECT u, u FROM ok UNION SELECT ok.v, olow.least FROM olow JOIN ok ON ok.u = olow.node WHERE ok.v > olow.least), old_members AS (SELECT node, min(least) AS old FROM olow GROUP BY node),
sn AS (SELECT situation, count(*) AS n FROM members GROUP BY 1), so AS (SELECT old, count(*) AS n FROM old_members GROUP BY 1), sh AS (SELECT situation, old, count(*) AS shared FROM members JOIN old_members USING (node) GROUP BY ALL),
c AS (SELECT situation, old, row_number() OVER (ORDER BY shared DESC, shared / least(sn.n, so.n) DESC, old, situation) AS n FROM sh JOIN sn USING (situation) JOIN so USING (old) WHERE shared >= 2 AND shared / least(sn.n, so.n) >= 0.5),
turn(n, news, olds) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT z.n, CASE WHEN free THEN list_append(news, situation) ELSE news END, CASE WHEN free THEN list_append(olds, old) ELSE olds END FROM (SELECT x.n, t.news, t.olds, x.situation, x.old, NOT list_contains(t.news, x.situation) AND NOT list_contains(t.olds, x.old) AS free FROM turn t JOIN c x ON x.n = t.n + 1) AS z),
last AS (SELECT arg_max(news, n) AS news, arg_max(olds, n) AS olds FROM turn) SELECT unnest(news) AS new_id, unnest(olds) AS old_id FROM last"""


@query(_CARRIED)
def situations_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-16, GRF-17, SIT-1: which situations of the orders up to 2000 go on in those of all orders."""
    edges = _edges(spark, sf_dir)
    old = table(spark, sf_dir, "orders").filter("o_orderdate < '2000-01-01'").select("o_orderkey")
    kept = edges.join(old.toDF("a"), "a", "left_semi").join(old.toDF("b"), "b", "left_semi")
    now = cut(situations(edges).select(F.col("situation").alias("id"), "node"))
    before = cut(situations(kept).select(F.col("situation").alias("id"), "node"))
    return carry_over(now, before)
