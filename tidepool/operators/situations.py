"""Situations as a user sees them: which components count, what they are called, and how they go on from run to run.

A run proposes situations anew; what the user decided about one, and its id and
first sight, are carried over to the proposal that shares most of its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.graph import _COMPONENTS, _edges, carry_over, situations
from tidepool.operators.identity import is_handle_title
from tidepool.operators.search import gated
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import micros, table

DAY = 86_400_000_000
#: How many nodes and streams a situation has, kinds of which it needs one, and how many a tool shows.
LEAST_NODES, MOST_NODES, LEAST_STREAMS, SPINE, SHOWN = 2, 40, 2, ("event", "task", "conversation"), 8


def salience(members: Column, streams: Column, kinds: Column, age: Column) -> Column:
    """GRF-15."""
    return F.round((streams - 1) * 0.4 + (kinds - 1) * 0.25 + F.least(F.lit(0.2), F.log10(members + 1) * 0.1) + F.greatest(F.lit(0.0), 0.4 - age * 0.008), 4)


def proposals(members: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """GRF-13 to GRF-15: (situation, title, kind, members, streams, starts, ends, salience, digest) of the components that are situations.

    ``members`` has (situation, node), ``nodes`` (node, kind, stream, t, title,
    one_way).  A component has 2 to 40 nodes of two streams or more and an
    event, a task or a conversation among them; several broadcast mails are one
    thing, so what is left besides has to be two nodes.  It is called after its
    first event, else its first task, else its first title that says something,
    else any; ties in time go to the smaller node.
    """
    held = members.join(nodes, "node")
    named, place = F.char_length(F.coalesce("title", F.lit(""))), F.struct("t", "node", "title")

    def first(test: Column) -> Column:
        return F.min(F.when(test, place))["title"]

    mail = (F.col("kind") == "message") & F.coalesce("one_way", F.lit(False))
    grouped = held.groupBy("situation").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("stream").alias("streams"),
        F.count_distinct("kind").alias("kinds"),
        F.count_if(mail).alias("broadcast"),
        F.bool_or(F.col("kind").isin(*SPINE)).alias("spine"),
        F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kind"),
        F.min("t").alias("starts"),
        F.max("t").alias("ends"),
        F.coalesce(first((F.col("kind") == "event") & (named > 2)), first((F.col("kind") == "task") & (named > 2)), first((named > 3) & ~is_handle_title(F.col("title"))), first(named > 0)).alias("title"),
    )
    sized = grouped.filter(F.col("members").between(LEAST_NODES, MOST_NODES) & (F.col("streams") >= LEAST_STREAMS) & F.col("spine")).filter("NOT (broadcast > 1 AND members - broadcast < 2)")
    # Only now are members listed, 40 at most.
    listed = members.join(sized.select("situation"), "situation", "left_semi").groupBy("situation").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), "|"), 256).alias("digest"))
    scored = sized.withColumn("salience", salience(F.col("members"), F.col("streams"), F.col("kinds"), (now - F.col("ends")) / DAY))
    return scored.join(listed, "situation").select("situation", "title", "kind", "members", "streams", "starts", "ends", "salience", "digest")


def reconcile(proposed: DataFrame, members: DataFrame, existing: DataFrame, existing_members: DataFrame, now: int) -> DataFrame:
    """GRF-17, SIT-1: (id, situation, title, title_source, state, digest, first_seen, last_changed, fate) of what is stored after a run.

    ``proposed`` is of :func:`proposals`, ``existing`` has (id, title,
    title_source, state, digest, first_seen, last_changed), both member tables
    (situation or id, node).  Ids are text or numbers, and of equal claims the
    smaller id has the first, numbers as numbers.  A proposal that goes on from a situation keeps its
    id, first sight and state, and a title the user wrote; its change is
    noted if its members differ.  Of situations that none goes on from, those
    the user decided on or named stay as ``kept``; others are ``merged`` if a
    node of theirs is proposed elsewhere, else ``retired``, with no state left.
    """
    matched = carry_over(members.select(F.col("situation").alias("id"), "node"), existing_members.select("id", "node")).select(F.col("new_id").alias("situation"), F.col("old_id").alias("id"))
    prior = existing.select("id", F.struct("title", "title_source", "state", "digest", "first_seen", "last_changed").alias("was"))
    joined = proposed.join(matched, "situation", "left").join(prior, "id", "left")
    new, same = F.col("was").isNull(), F.coalesce(F.col("was.digest") == F.col("digest"), F.lit(False))
    going_on = joined.select(
        F.coalesce(F.col("id").cast("string"), F.concat(F.lit("st_"), F.substring(F.sha2(F.concat_ws("|", F.lit(now).cast("string"), "digest"), 256), 1, 20))).alias("id"),
        "situation",
        F.when(F.col("was.title_source") == "user", F.col("was.title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("was.title_source", F.lit("derived")).alias("title_source"),
        F.coalesce("was.state", F.lit("open")).alias("state"),
        "digest",
        F.coalesce("was.first_seen", F.lit(now)).alias("first_seen"),
        F.when(same, F.col("was.last_changed")).otherwise(F.lit(now)).alias("last_changed"),
        F.when(new, "created").when(same, "carried").otherwise("changed").alias("fate"),
    )
    left = existing.join(matched.select("id"), "id", "left_anti")
    alive = existing_members.join(members.select("node").distinct(), "node", "left_semi").select("id").distinct().withColumn("alive", F.lit(True))
    decided = (F.col("state") != "open") | (F.col("title_source") == "user")
    fate = F.when(decided, "kept").when(F.coalesce("alive", F.lit(False)), "merged").otherwise("retired")
    gone = left.join(alive, "id", "left").withColumn("fate", fate)
    rest = gone.select(F.col("id").cast("string").alias("id"), F.lit(None).cast(proposed.schema["situation"].dataType).alias("situation"), "title", "title_source", F.when(decided, F.col("state")).alias("state"), "digest", "first_seen", "last_changed", "fate")
    return going_on.unionByName(rest)


def shown(found: DataFrame, members: DataFrame, nodes: DataFrame, limit: int = SHOWN, since: int | None = None) -> DataFrame:
    """TOOL-6: (situation, title, kind, streams, node, text, withheld) of the most salient situations, each member as the gate shows it.

    ``nodes`` has (node, title, level): restricted ones are only counted, those
    without a label count as sensitive.
    """
    recent = found if since is None else found.filter(F.col("ends") >= since)
    top = recent.orderBy(F.desc("salience"), F.desc("ends"), "situation").limit(limit).select("situation", "title", "kind", "streams")
    held = members.join(F.broadcast(top), "situation").join(nodes.select("node", F.col("title").alias("own"), "level"), "node")
    secret = F.coalesce("level", F.lit(1)) == 2
    counted = held.withColumn("withheld", F.sum(secret.cast("int")).over(Window.partitionBy("situation")))
    return counted.filter(~secret).select("situation", "title", "kind", "streams", "node", gated(F.col("own"), F.col("level")).alias("text"), "withheld")


# --- queries over orders as nodes ---------------------------------------------------

_NOW, _BEFORE = 1_000_000_000_000_000, "2000-01-01"
_KINDS = "CASE WHEN o_orderstatus = 'P' THEN 'event' WHEN o_orderkey % 5 = 0 THEN 'task' ELSE 'message' END"
_TITLES = "CASE WHEN o_orderkey % 7 = 0 THEN '+1 555 010 0199' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'order ' || o_orderkey END"
_LEVELS = "CASE WHEN o_orderkey % 9 = 0 THEN 2 WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0 END"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.expr(_KINDS).alias("kind"), F.col("o_orderpriority").alias("stream"), micros("o_orderdate").alias("t"), F.expr(_TITLES).alias("title"), (F.col("o_custkey") % 2 == 0).alias("one_way"), F.expr(_LEVELS).alias("level"), "o_orderdate")


def _proposed_sql(members: str, out: str) -> str:
    return f"""{out}_h AS (SELECT m.situation, n.* FROM {members} m JOIN n USING (node)),
{out} AS (SELECT situation, coalesce(arg_min(title, (t, node)) FILTER (kind = 'event' AND length(title) > 2), arg_min(title, (t, node)) FILTER (kind = 'task' AND length(title) > 2), arg_min(title, (t, node)) FILTER (length(title) > 3 AND NOT regexp_matches(title, '^[+]?[0-9][0-9 ().-]{{5,}}$')), arg_min(title, (t, node)) FILTER (length(title) > 0)) AS title,
  list_aggregate(list_sort(list(DISTINCT kind)), 'string_agg', '+') AS kind, count(*) AS members, count(DISTINCT stream) AS streams, min(t) AS starts, max(t) AS ends,
  round((count(DISTINCT stream) - 1) * 0.4 + (count(DISTINCT kind) - 1) * 0.25 + least(0.2, log10(count(*) + 1) * 0.1) + greatest(0.0, 0.4 - ({_NOW} - max(t)) / {DAY}.0::DOUBLE * 0.008), 4)::DOUBLE AS salience, sha256(list_aggregate(list_sort(list(node::VARCHAR)), 'string_agg', '|')) AS digest
  FROM {out}_h GROUP BY situation HAVING count(*) BETWEEN 2 AND 40 AND count(DISTINCT stream) >= 2 AND bool_or(kind IN {SPINE}) AND NOT (count(*) FILTER (kind = 'message' AND one_way) > 1 AND count(*) - count(*) FILTER (kind = 'message' AND one_way) < 2))"""


_NODES_SQL = f"n AS (SELECT o_orderkey AS node, {_KINDS} AS kind, o_orderpriority AS stream, epoch_us(o_orderdate) AS t, {_TITLES} AS title, o_custkey % 2 = 0 AS one_way, {_LEVELS} AS level, o_orderdate FROM orders)"


@query(f"WITH RECURSIVE {_COMPONENTS}, {_NODES_SQL}, {_proposed_sql('members', 'p')} SELECT * FROM p")
def situations_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-13 to GRF-15: situations with their spine, their titles and their salience."""
    return proposals(cut(situations(_edges(spark, sf_dir)).select("situation", "node")), _nodes(spark, sf_dir), _NOW)


@query(f"""WITH RECURSIVE {_COMPONENTS}, {_NODES_SQL}, {_proposed_sql('members', 'p')}, top AS (SELECT * FROM p ORDER BY salience DESC, ends DESC, situation LIMIT {SHOWN}), seen AS (SELECT top.situation, top.title, top.kind, streams, node, n.title AS own, level, count(*) FILTER (level = 2) OVER (PARTITION BY top.situation) AS withheld FROM top JOIN members USING (situation) JOIN n USING (node))
SELECT situation, title, kind, streams, node, CASE WHEN coalesce(level, 1) = 1 THEN '[sensitive] ' || substr(own, 1, 200) ELSE own END AS text, withheld FROM seen WHERE coalesce(level, 1) <> 2""")
def situations_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-6, POL-5, POL-6: the most salient situations, their members through the gate."""
    members, nodes = cut(situations(_edges(spark, sf_dir)).select("situation", "node")), _nodes(spark, sf_dir)
    return shown(proposals(members, nodes, _NOW), members, nodes)


@query(f"""WITH RECURSIVE {_COMPONENTS}, {_NODES_SQL}, old_edges AS (SELECT e.* FROM edges e JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE x.o_orderdate < '{_BEFORE}' AND y.o_orderdate < '{_BEFORE}' AND confidence >= 0.45),
ok AS (SELECT a AS u, b AS v FROM old_edges UNION SELECT b, a FROM old_edges), olow(node, least) AS (SELECT u, u FROM ok UNION SELECT ok.v, olow.least FROM olow JOIN ok ON ok.u = olow.node WHERE ok.v > olow.least), old_members AS (SELECT node, min(least) AS situation FROM olow GROUP BY node),
{_proposed_sql('members', 'p')}, {_proposed_sql('old_members', 'q')}, pm AS (SELECT situation, node FROM members WHERE situation IN (SELECT situation FROM p)), qm AS (SELECT situation AS old, node FROM old_members WHERE situation IN (SELECT situation FROM q)),
s AS (SELECT situation, old, count(*) AS shared FROM pm JOIN qm USING (node) GROUP BY ALL), c AS (SELECT situation, old, row_number() OVER (ORDER BY shared DESC, shared / least(p.members, q.members) DESC, old, s.situation) AS n FROM s JOIN p USING (situation) JOIN q ON q.situation = old WHERE shared >= 2 AND shared / least(p.members, q.members) >= 0.5),
turn(n, news, olds) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT c.n, CASE WHEN free THEN list_append(news, c.situation) ELSE news END, CASE WHEN free THEN list_append(olds, c.old) ELSE olds END FROM (SELECT t.*, x.situation, x.old, NOT list_contains(t.news, x.situation) AND NOT list_contains(t.olds, x.old) AS free FROM turn t JOIN c x ON x.n = t.n + 1) AS z JOIN c ON c.n = z.n + 1),
last AS (SELECT arg_max(news, n) AS news, arg_max(olds, n) AS olds FROM turn), m AS (SELECT unnest(news) AS situation, unnest(olds) AS old FROM last),
existing AS (SELECT situation AS old, CASE WHEN situation % 3 = 0 THEN 'mine ' || situation ELSE title END AS title, CASE WHEN situation % 3 = 0 THEN 'user' ELSE 'derived' END AS title_source, CASE WHEN situation % 5 = 0 THEN 'dismissed' ELSE 'open' END AS state, digest FROM q)
SELECT CASE WHEN e.old IS NULL THEN 'new' ELSE 'st_' || e.old END AS id, p.situation, CASE WHEN title_source = 'user' THEN e.title ELSE p.title END AS title, coalesce(title_source, 'derived') AS title_source, coalesce(state, 'open') AS state, p.digest, CASE WHEN e.old IS NULL THEN {_NOW} ELSE 5 END AS first_seen, CASE WHEN p.digest = e.digest THEN 7 ELSE {_NOW} END AS last_changed, CASE WHEN e.old IS NULL THEN 'created' WHEN p.digest = e.digest THEN 'carried' ELSE 'changed' END AS fate FROM p LEFT JOIN m USING (situation) LEFT JOIN existing e ON e.old = m.old
UNION ALL SELECT 'st_' || e.old, NULL, e.title, title_source, CASE WHEN state <> 'open' OR title_source = 'user' THEN state END, e.digest, 5, 7, CASE WHEN state <> 'open' OR title_source = 'user' THEN 'kept' WHEN EXISTS (SELECT 1 FROM qm JOIN pm USING (node) WHERE qm.old = e.old) THEN 'merged' ELSE 'retired' END FROM existing e WHERE e.old NOT IN (SELECT old FROM m)""")
def situations_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-16, GRF-17, SIT-1: situations of orders up to 2000, some named or dismissed, carried over into those of all orders."""
    edges, nodes = _edges(spark, sf_dir), _nodes(spark, sf_dir)
    earlier = nodes.filter(F.col("o_orderdate") < _BEFORE).select("node")
    old_edges = edges.join(earlier.toDF("a"), "a", "left_semi").join(earlier.toDF("b"), "b", "left_semi")

    def run(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        members = cut(situations(links).select("situation", "node"))
        made = cut(proposals(members, nodes, _NOW))
        return made, members.join(made.select("situation"), "situation", "left_semi")

    (proposed, members), (before, before_members) = run(edges), run(old_edges)
    mine, id = F.col("situation") % 3 == 0, F.col("situation")  # noqa: A001
    existing = before.select(id.alias("id"), F.when(mine, F.concat(F.lit("mine "), F.col("situation").cast("string"))).otherwise(F.col("title")).alias("title"), F.when(mine, "user").otherwise("derived").alias("title_source"), F.when(F.col("situation") % 5 == 0, "dismissed").otherwise("open").alias("state"), "digest", F.lit(5).cast("long").alias("first_seen"), F.lit(7).cast("long").alias("last_changed"))
    made = reconcile(proposed, members, existing, before_members.select(id.alias("id"), "node"), _NOW)
    # An id that is new follows from time and members; it is shown as new.
    return made.withColumn("id", F.when(F.col("fate") == "created", "new").otherwise(F.concat(F.lit("st_"), "id")))
