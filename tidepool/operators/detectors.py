"""Detectors that read what the other passes made: situations, commitments, recurring subjects.

Each gives observations: (dedup, title, salience, evidence, earliest, expires).
Evidence is mandatory; the key says what would be the same finding again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.graph import _COMPONENTS, _edges, situations
from tidepool.operators.noise import _BROADCAST, _MAILS, _TEMPLATES, mails, noisy
from tidepool.operators.texts import TOPICS_SQL, topics
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import TASKS_SQL, micros, table, tasks, turns

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Windows, bounds and weights of the detectors.
AHEAD, QUIET, MOST_SITUATIONS, MOST_EVIDENCE, LOOSE = 3 * DAY, 24 * HOUR, 20, 6, 0.8
DUE_SOON, MOST_DUE, LEAST_CONFIDENCE = 3 * DAY, 200, 0.65
MAIL_WINDOW, MOST_TOPICS = 10 * DAY, 12


def loose_ends(members: DataFrame, items: DataFrame, closed: DataFrame, now: int) -> DataFrame:
    """DET-4: open situations of two streams or more with an event within three days, whose last message is an old one of somebody else.

    ``members`` has (situation, item); ``items`` has (item, kind, direction,
    stream, t, title) of live items; ``closed`` the situations resolved or
    dismissed.  Those whose event comes first are looked at, at most
    MOST_SITUATIONS.  Ties in time go to the smaller item.
    """
    held = members.join(items, "item").join(closed.select("situation").distinct(), "situation", "left_anti")
    is_event, is_message = F.col("kind") == "event", F.col("kind") == "message"
    soon = is_event & F.col("t").between(now, now + AHEAD)
    # A situation is read as a few numbers and its earliest items; none is collected whole.
    grouped = held.groupBy("situation").agg(
        F.count_distinct("stream").alias("streams"),
        F.count_distinct("kind").alias("kinds"),
        F.min(F.when(soon, F.struct("t", "item"))).alias("coming"),
        F.min(F.when(is_event, F.struct("t", "item", "title"))).alias("event"),
        F.max(F.when(is_message, F.struct("t", (-F.col("item")).alias("less"), "direction", "title"))).alias("latest"),
    )
    looked = grouped.filter("streams >= 2 AND coming IS NOT NULL").orderBy("coming.t", "situation").limit(MOST_SITUATIONS)
    loose = looked.filter((F.col("latest.direction") == "inbound") & (now - F.col("latest.t") >= QUIET))
    place = F.row_number().over(Window.partitionBy("situation").orderBy("t", "item"))
    first = held.join(F.broadcast(loose.select("situation")), "situation", "left_semi").withColumn("place", place).filter(F.col("place") <= MOST_EVIDENCE)
    evidence = first.groupBy("situation").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("evidence"))
    days = F.round((now - F.col("latest.t")) / DAY).cast("long")
    return loose.join(evidence, "situation").select(
        F.concat(F.lit("loose:"), F.col("situation").cast("string")).alias("dedup"),
        F.concat(F.coalesce("event.title", F.lit("Something")), F.lit(" is coming up and the thread about it went quiet")).alias("title"),
        F.lit(LOOSE).alias("salience"),
        "evidence",
        F.lit(now).cast("long").alias("earliest"),
        (F.col("event.t") + DAY).alias("expires"),
        days.alias("quiet_days"),
        "kinds",
    )


def evidence_for(commitments: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """COM-14: (commitment, records, n) with the first of a commitment's (item, t) in order of time, and how many there are."""
    held = evidence.join(commitments.select("commitment"), "commitment", "left_semi")
    order = Window.partitionBy("commitment").orderBy("t", "item")
    first = held.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    listed = first.groupBy("commitment").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("records"))
    return listed.join(held.groupBy("commitment").agg(F.count(F.lit(1)).alias("n")), "commitment")


def due_commitments(commitments: DataFrame, evidence: DataFrame, now: int) -> DataFrame:
    """DET-5: what one has said one would do and is due within three days or over.

    ``commitments`` has (commitment, owner, title, state, due, occurs,
    confidence, recurring), ``evidence`` (commitment, item, t).  The MOST_DUE
    that are due first are looked at.  Recurring ones long over, those of
    others, weak ones and those without evidence say nothing.
    """
    when = F.coalesce("due", "occurs")
    first = commitments.filter(F.col("state").isin("stated", "scheduled")).withColumn("when", when).filter(F.col("when") <= now + DUE_SOON).orderBy("when", "commitment").limit(MOST_DUE)
    mine = first.filter((F.col("owner") == "me") & (F.col("confidence") >= LEAST_CONFIDENCE)).filter(~F.col("recurring") | (F.col("when") >= now - DUE_SOON))
    said = mine.join(evidence_for(mine, evidence, MOST_EVIDENCE), "commitment")
    over = F.col("when") < now
    days = F.round(F.abs(F.col("when") - now) / DAY).cast("long")
    ago = F.when(days == 0, "today").when(over, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
    weight = F.when(over, 0.6).otherwise(0.45) + F.when(F.col("n") > 1, 0.15).otherwise(0.0) + F.col("confidence") * 0.2
    return said.select(
        F.concat_ws(":", F.lit("commitment_due"), F.col("commitment").cast("string"), F.expr(f"cast(floor(`when` / {DAY}) as string)")).alias("dedup"),
        F.concat("title", F.when(over, F.lit(" was due ")).otherwise(F.lit(" is due ")), ago).alias("title"),
        F.round(F.least(F.lit(0.95), weight), 6).alias("salience"),
        F.col("records").alias("evidence"),
        F.when(over, F.lit(now)).otherwise(F.col("when") - DUE_SOON).cast("long").alias("earliest"),
        (F.col("when") + 10 * DAY).alias("expires"),
    )


def recurring_subjects(subjects: DataFrame, items: DataFrame, broadcast: DataFrame, now: int) -> DataFrame:
    """DET-8: recent mail that is about a subject which keeps coming back in conversations.

    ``subjects`` has (term, conversations, first) of at most MOST_TOPICS terms,
    ``items`` (item, t, title, body) of live mails of other sources,
    ``broadcast`` (item) of those that nobody corresponds with.  A subject's
    newest mail counts; a mail is said once, for its strongest subject.  All
    terms are looked for in one pass over the recent mails.
    """
    order = F.struct((-F.col("conversations")).alias("less"), "term", "first")
    # One row, of at most so many terms.
    listed = subjects.orderBy(F.desc("conversations"), "term").limit(MOST_TOPICS).agg(F.array_sort(F.collect_list(order)).alias("topics"))
    recent = items.filter(F.col("t") >= now - MAIL_WINDOW).join(broadcast.select("item").distinct(), "item", "left_anti")
    text = F.lower(F.concat_ws("\n", "title", "body"))
    met = recent.crossJoin(F.broadcast(listed)).withColumn("text", text)
    found = met.select("item", "t", "title", F.explode(F.filter("topics", lambda x: F.contains(F.col("text"), x["term"]))).alias("topic"))
    newest = found.groupBy("topic").agg(F.max(F.struct("t", (-F.col("item")).alias("less"), "title")).alias("m"))
    once = newest.groupBy(F.col("m.less").alias("less")).agg(F.min("topic").alias("topic"), F.first("m.title").alias("title"))
    n = -F.col("topic.less")
    return once.select(
        F.concat_ws(":", F.lit("recurring"), "topic.term", (-F.col("less")).cast("string")).alias("dedup"),
        F.concat(F.lit('"'), F.coalesce("title", F.lit("an email")), F.lit('" arrived, and '), F.col("topic.term"), F.lit(" has come up in "), n.cast("string"), F.lit(" conversations recently")).alias("title"),
        F.round(F.least(F.lit(0.75), 0.45 + n * 0.05), 6).alias("salience"),
        F.array(-F.col("less")).alias("evidence"),
        F.lit(now).cast("long").alias("earliest"),
        F.lit(now + 7 * DAY).cast("long").alias("expires"),
    )


# --- queries ------------------------------------------------------------------------

_MEMBER_KINDS = "CASE WHEN o_orderstatus = 'P' THEN 'event' WHEN o_orderkey % 5 = 0 THEN 'task' ELSE 'message' END"
_LOOSE_NOW = 969_840_000_000_000


@query(f"""WITH RECURSIVE {_COMPONENTS}, i AS (SELECT o_orderkey AS item, {_MEMBER_KINDS} AS kind, CASE WHEN o_custkey % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, o_orderpriority AS stream, epoch_us(o_orderdate) AS t, 'order ' || o_orderkey AS title FROM orders WHERE o_orderkey % 41 <> 0),
m AS (SELECT situation, i.* FROM members JOIN i ON i.item = node WHERE situation % 11 <> 0),
g AS (SELECT situation, count(DISTINCT stream) AS streams, count(DISTINCT kind) AS kinds, min(t) FILTER (kind = 'event' AND t BETWEEN {_LOOSE_NOW} AND {_LOOSE_NOW + AHEAD}) AS coming, arg_min(title, (t, item)) FILTER (kind = 'event') AS event, min(t) FILTER (kind = 'event') AS event_t,
  arg_max(direction, (t, -item)) FILTER (kind = 'message') AS direction, max(t) FILTER (kind = 'message') AS latest FROM m GROUP BY situation),
looked AS (SELECT * FROM g WHERE streams >= 2 AND coming IS NOT NULL ORDER BY coming, situation LIMIT {MOST_SITUATIONS})
SELECT 'loose:' || situation AS dedup, coalesce(event, 'Something') || ' is coming up and the thread about it went quiet' AS title, {LOOSE}::DOUBLE AS salience, {_LOOSE_NOW}::BIGINT AS earliest, event_t + {DAY} AS expires, round(({_LOOSE_NOW} - latest) / {DAY}.0::DOUBLE)::BIGINT AS quiet_days, kinds,
(SELECT string_agg(item, ',' ORDER BY t, item) FROM (SELECT item, t FROM m WHERE m.situation = looked.situation ORDER BY t, item LIMIT {MOST_EVIDENCE})) AS evidence FROM looked WHERE direction = 'inbound' AND {_LOOSE_NOW} - latest >= {QUIET}""")
def detector_loose_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-4: situations of orders with a coming event and an unanswered last word."""
    members = cut(situations(_edges(spark, sf_dir)).select("situation", F.col("node").alias("item")))
    direction = F.when(F.col("o_custkey") % 2 == 0, "inbound").otherwise("outbound")
    items = table(spark, sf_dir, "orders").filter("o_orderkey % 41 <> 0").select(F.col("o_orderkey").alias("item"), F.expr(_MEMBER_KINDS).alias("kind"), direction.alias("direction"), F.col("o_orderpriority").alias("stream"), micros("o_orderdate").alias("t"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"))
    closed = members.filter("situation % 11 = 0").select("situation")
    return loose_ends(members, items, closed, _LOOSE_NOW).withColumn("evidence", F.array_join("evidence", ","))


_DUE_NOW = 800_000_000_000_000


@query(f"""WITH {TASKS_SQL}, c AS (SELECT task_id, CASE WHEN owner_id % 3 = 0 THEN 'other' ELSE 'me' END AS owner, title, CASE WHEN state = 'completed' THEN 'done' ELSE 'stated' END AS state, due, 0.5 + (task_id % 50) * 0.01 AS confidence, title = '5-LOW' AS recurring FROM tasks WHERE due >= {_DUE_NOW - 60 * DAY}),
f AS (SELECT * FROM c WHERE state IN ('stated', 'scheduled') AND due <= {_DUE_NOW + DUE_SOON} ORDER BY due, task_id LIMIT {MOST_DUE}),
e AS (SELECT l_orderkey AS task_id, count(*) AS n, list(l_linenumber ORDER BY l_shipdate, l_linenumber) AS items FROM lineitem GROUP BY l_orderkey),
d AS (SELECT *, round(abs(due - {_DUE_NOW}) / {DAY}.0::DOUBLE)::BIGINT AS days, due < {_DUE_NOW} AS over FROM f JOIN e USING (task_id) WHERE owner = 'me' AND confidence >= {LEAST_CONFIDENCE} AND (NOT recurring OR due >= {_DUE_NOW - DUE_SOON}))
SELECT 'commitment_due:' || task_id || ':' || (due // {DAY}) AS dedup, title || CASE WHEN over THEN ' was due ' ELSE ' is due ' END || CASE WHEN days = 0 THEN 'today' WHEN over THEN days || ' days ago' ELSE 'in ' || days || ' days' END AS title,
round(least(0.95, CASE WHEN over THEN 0.6 ELSE 0.45 END + CASE WHEN n > 1 THEN 0.15 ELSE 0 END + confidence * 0.2), 6)::DOUBLE AS salience, array_to_string(items[1:{MOST_EVIDENCE}], ',') AS evidence, CASE WHEN over THEN {_DUE_NOW} ELSE due - {DUE_SOON} END AS earliest, due + {10 * DAY} AS expires FROM d""")
def detector_commitments_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-5, COM-14: one's own commitments that are due, with their evidence in order of time."""
    made = tasks(spark, sf_dir).filter(F.col("due") >= _DUE_NOW - 60 * DAY)
    commitments = made.select(
        F.col("task_id").alias("commitment"),
        F.when(F.col("owner_id") % 3 == 0, "other").otherwise("me").alias("owner"),
        "title",
        F.when(F.col("state") == "completed", "done").otherwise("stated").alias("state"),
        "due",
        F.lit(None).cast("long").alias("occurs"),
        (F.lit(0.5) + (F.col("task_id") % 50) * 0.01).alias("confidence"),
        (F.col("title") == "5-LOW").alias("recurring"),
    )
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commitment"), F.col("l_linenumber").alias("item"), micros("l_shipdate").alias("t"))
    return due_commitments(commitments, evidence, _DUE_NOW).withColumn("evidence", F.array_join("evidence", ","))


_STEP = 6 * HOUR


@query(f"""WITH {TOPICS_SQL}, {_MAILS}, {_TEMPLATES}, {_BROADCAST}, noise AS (SELECT item FROM mails WHERE sender IN (SELECT sender FROM bc) UNION SELECT item FROM tp),
i AS (SELECT doc_id AS item, doc_id * {_STEP} AS t, substr(text, 1, 60) AS title, lower(substr(text, 1, 60) || chr(10) || text) AS text FROM documents WHERE doc_id NOT IN (SELECT item FROM noise)), n AS (SELECT max(doc_id) * {_STEP} AS now FROM documents),
f AS (SELECT topics.*, row_number() OVER (ORDER BY conversations DESC, term) AS place, item, t, title, now FROM topics JOIN i ON contains(text, term), n WHERE t >= now - {MAIL_WINDOW}),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY term ORDER BY t DESC, item) = 1), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY item ORDER BY place) = 1)
SELECT 'recurring:' || term || ':' || item AS dedup, '"' || title || '" arrived, and ' || term || ' has come up in ' || conversations || ' conversations recently' AS title, round(least(0.75, 0.45 + conversations * 0.05), 6)::DOUBLE AS salience, item AS evidence, now AS earliest, now + {7 * DAY} AS expires FROM o""")
def detector_recurring_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-8: the newest documents about what conversations keep coming back to, but for noise."""
    documents = table(spark, sf_dir, "documents")
    # The newest time is a number.
    now = (documents.agg(F.max("doc_id").alias("m")).first()["m"] or 0) * _STEP
    items = documents.select(F.col("doc_id").alias("item"), (F.col("doc_id") * _STEP).alias("t"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))
    _, broadcast = noisy(mails(spark, sf_dir))
    subjects = topics(turns(spark, sf_dir)).select("term", "conversations", F.col("first_conv").alias("first"))
    return recurring_subjects(subjects, items, broadcast, now).withColumn("evidence", F.get("evidence", F.lit(0)))
