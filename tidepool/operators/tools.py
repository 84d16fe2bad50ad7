"""The tools that show things, each with the gate inside: items, conversations, what a node is part of, and who a handle is.

What a principal may see is decided first, then how much of it the gate lets
through; nothing is ranked or shown before both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.identity import _PARSED_SQL, _headers, parse_address, useful_name
from tidepool.operators.noise import _BROADCAST, _MAILS, _TEMPLATES, mails, noisy
from tidepool.operators.policy import _CLASSIFIED, classify
from tidepool.operators.search import _OWNED, MOST_CHARACTERS, MOST_EPISODES, Scope, gated, owned_items
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import DOCUMENTS_SQL, table, turns

#: Fixed value: how many vectors a chunked item has here.
CHUNKS = 4


def show_items(items: DataFrame, asked: DataFrame, scope: Scope) -> DataFrame:
    """TOOL-4, POL-5, POL-6: (item_id, kind, level, text) of the asked items that the scope holds, their texts through the gate.

    ``items`` are of ``owned_items``; a text is labelled as it is shown, one
    that cannot be labelled (null) counts as sensitive.
    """
    found = scope.within(items).join(asked, "item_id", "left_semi")
    level = F.when(F.col("body").isNotNull(), classify(F.col("body"))["level"])
    labelled = found.select("item_id", "kind", "body", level.alias("level"))
    return labelled.select("item_id", "kind", "level", gated(F.col("body"), F.col("level")).alias("text"))


_GATED = f"CASE WHEN level = 2 THEN '[withheld]' WHEN coalesce(level, 1) = 1 THEN '[sensitive] ' || substr(body, 1, 200) ELSE substr(body, 1, {MOST_CHARACTERS}) END"


@query(f"""WITH {_CLASSIFIED}, {_OWNED.removeprefix(DOCUMENTS_SQL + ', ')}, s AS (SELECT o.item_id, o.kind, c.level, {_GATED.replace('body', 'o.body')} AS text FROM owned o JOIN classified c USING (item_id) WHERE deleted IS NULL AND (custodian = 'ben' OR visibility = 'household') AND o.item_id % 10 < 8)
SELECT item_id, kind, level, length(text) AS characters, md5(text) AS digest FROM s""")
def items_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-4, FIL-2, POL-5, POL-6: items that a principal asks for, as far as scope and gate let them be seen."""
    items = owned_items(spark, sf_dir)
    asked = items.filter("item_id % 10 < 8").select("item_id")
    shown = show_items(items, asked, Scope(principal="ben"))
    return shown.select("item_id", "kind", "level", F.char_length("text").cast("long").alias("characters"), F.md5("text").alias("digest"))


def visible_episodes(episodes: DataFrame, streams: DataFrame, accounts: DataFrame, principal: str) -> DataFrame:
    """FIL-3: the episodes (stream, ...) whose stream (stream, account_id) belongs to an account (account_id, custodian) of the principal."""
    own = streams.join(accounts.filter(F.col("custodian") == principal), "account_id", "left_semi").select("stream")
    return episodes.join(own, "stream", "left_semi")


_TURNS_AS_ITEMS = "items AS (SELECT conv_id * 1000 + turn AS item_id, '' AS account_id, 'message' AS kind, '' AS title, text AS body, conv_id, turn, role FROM conversations)"
_SAID_SQL = _CLASSIFIED.replace(DOCUMENTS_SQL, _TURNS_AS_ITEMS)


@query(f"""WITH {_SAID_SQL}, l AS (SELECT i.conv_id, i.turn, i.body, CASE WHEN role = 'user' THEN 'Me' ELSE upper(substr(role, 1, 1)) || lower(substr(role, 2)) END AS speaker, level FROM items i JOIN classified c USING (item_id) WHERE conv_id % 20 % 3 = 0),
e AS (SELECT conv_id, count(*) AS turns, max(level) AS level, string_agg(speaker || ': ' || body, chr(10) ORDER BY turn, body) AS body FROM l GROUP BY conv_id), n AS (SELECT * FROM e ORDER BY conv_id DESC LIMIT {MOST_EPISODES}), s AS (SELECT conv_id, turns, level, {_GATED} AS text FROM n)
SELECT conv_id, turns, level, length(text) AS characters, md5(text) AS digest FROM s""")
def conversations_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-9, TOOL-10, FIL-3, AGG-22: a principal's newest conversations, each as sensitive as its most sensitive turn."""
    said = turns(spark, sf_dir).withColumn("stream", F.col("conv_id") % 20)
    streams = said.select("stream", F.col("stream").alias("account_id")).distinct()
    accounts = streams.select("account_id", F.when(F.col("account_id") % 3 == 0, "ann").otherwise("ben").alias("custodian"))
    visible = visible_episodes(said, streams, accounts, "ann")
    newest = visible.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(MOST_EPISODES)
    shown = visible.join(F.broadcast(newest), "conv_id", "left_semi")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text", "speaker"))), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n")
    # The level of a turn is found before its conversation is joined up.
    told = shown.withColumn("level", classify(F.col("text"))["level"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("level").alias("level"), lines.alias("body"))
    text = gated(F.col("body"), F.col("level"))
    return told.select("conv_id", "turns", "level", F.char_length(text).cast("long").alias("characters"), F.md5(text).alias("digest"))


def lifted(items: DataFrame, episode_items: DataFrame, left_out: DataFrame) -> DataFrame:
    """GRF-1: (item, node) of (item, kind): an item of an episode stands for the episode, any other for itself.

    Contacts and what is ``left_out`` (templates, the owner's own notes) are no
    subjects; so a dismissed episode takes its items along.
    """
    told = items.filter("kind <> 'contact'").join(left_out.select("item").distinct(), "item", "left_anti")
    return told.join(episode_items.select("item", "episode"), "item", "left").select("item", F.coalesce(F.concat(F.lit("episode:"), F.col("episode").cast("string")), F.concat(F.lit("item:"), F.col("item").cast("string"))).alias("node"))


def considered(items: DataFrame, episode_items: DataFrame, left_out: DataFrame) -> DataFrame:
    """SIT-3: (item, reason) of the items that need no look of their own: covered by an episode, contacts, or left out."""
    joined = items.join(episode_items.select("item", F.lit(True).alias("covered")).distinct(), "item", "left").join(left_out.select("item", F.lit(True).alias("out")).distinct(), "item", "left")
    reason = F.when(F.col("kind") == "contact", "contact").when(F.coalesce("out", F.lit(False)), "template").when(F.coalesce("covered", F.lit(False)), "in an episode")
    return joined.select("item", reason.alias("reason")).filter("reason IS NOT NULL")


def threads_for(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """SIT-2: (node, situation) of the asked nodes."""
    return members.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "situation")


def situation_items(members: DataFrame, node_items: DataFrame) -> DataFrame:
    """SIT-2: (situation, item): the items of a situation's nodes, each once."""
    return members.join(node_items, "node").select("situation", "item").distinct()


_ITEMS_SQL = f"""{_MAILS}, {_TEMPLATES}, {_BROADCAST}, noise AS (SELECT item FROM tp), it AS (SELECT doc_id AS item, CASE WHEN lang = 'es' THEN 'contact' ELSE 'message' END AS kind, doc_id // 7 AS episode, source IN ('src1', 'src2', 'src3') AS chat FROM documents)"""


def _graph_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as items, those of three sources in episodes of seven, and the templates among them."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.when(F.col("lang") == "es", "contact").otherwise("message").alias("kind"), "source")
    episodes = items.filter(F.col("source").isin("src1", "src2", "src3")).select("item", F.expr("item div 7").alias("episode"))
    templates, _ = noisy(mails(spark, sf_dir))
    return items.drop("source"), episodes, templates


@query(f"WITH {_ITEMS_SQL}, rp AS (SELECT item FROM mails QUALIFY row_number() OVER (PARTITION BY sender, lower(trim(title)) ORDER BY item) > 1) SELECT item, CASE WHEN chat THEN 'episode:' || episode ELSE 'item:' || item END AS node FROM it WHERE kind <> 'contact' AND item NOT IN (SELECT item FROM noise UNION SELECT item FROM rp)")
def subjects_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-1: the nodes that items stand for, without templates and contacts."""
    return lifted(*_graph_items(spark, sf_dir))


@query(f"""WITH {_ITEMS_SQL}, rp AS (SELECT item FROM mails QUALIFY row_number() OVER (PARTITION BY sender, lower(trim(title)) ORDER BY item) > 1)
SELECT item, CASE WHEN kind = 'contact' THEN 'contact' WHEN item IN (SELECT item FROM noise UNION SELECT item FROM rp) THEN 'template' ELSE 'in an episode' END AS reason FROM it WHERE kind = 'contact' OR chat OR item IN (SELECT item FROM noise UNION SELECT item FROM rp)""")
def items_considered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIT-3: items that need no look of their own, and why."""
    return considered(*_graph_items(spark, sf_dir))


def handle_names(handles: DataFrame, identifiers: DataFrame, people: DataFrame) -> DataFrame:
    """JOI-16, ENT-7: (handle, name) of (handle): what to call whoever a handle belongs to.

    ``identifiers`` has (entity, kind, normalized, confidence, occurrences),
    ``people`` (entity, name).  A person's own name comes first if it is one to
    show, then their best name identifier (by confidence, then how often it was
    seen, then the smaller), then the handle itself.  A handle of several people
    is that of the smallest entity.
    """
    owner = identifiers.filter("kind IN ('email', 'phone')").groupBy(F.col("normalized").alias("handle")).agg(F.min("entity").alias("entity"))
    best = identifiers.filter("kind = 'name'").groupBy("entity").agg(F.min_by("normalized", F.struct(-F.col("confidence"), -F.col("occurrences"), "normalized")).alias("said"))
    joined = handles.select("handle").distinct().join(owner, "handle", "left").join(people.select("entity", "name"), "entity", "left").join(best, "entity", "left")
    own = F.when(F.coalesce(useful_name(F.col("name")), F.lit(False)), F.col("name"))
    return joined.select("handle", F.coalesce(own, "said", "handle").alias("name"))


@query(f"""WITH {_PARSED_SQL}, hd AS (SELECT coalesce(email, phone) AS handle, min('c' || c_custkey) AS entity FROM named WHERE email IS NOT NULL OR phone IS NOT NULL GROUP BY 1),
sd AS (SELECT 'c' || o_custkey AS entity, lower(o_orderpriority) AS said, max(0.5 + (o_orderkey % 4) * 0.1) AS confidence, count(*) AS occurrences FROM orders GROUP BY ALL), bs AS (SELECT entity, arg_min(said, (-confidence, -occurrences, said)) AS said FROM sd GROUP BY entity),
pp AS (SELECT 'c' || c_custkey AS entity, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '+1 555 0100' END AS name FROM customer)
SELECT handle, coalesce(CASE WHEN NOT regexp_matches(name, '^[+]?[0-9 ().-]{{7,20}}$') THEN name END, said, handle) AS name FROM hd LEFT JOIN pp USING (entity) LEFT JOIN bs USING (entity)""")
def handles_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-16, ENT-7: what to call whoever writes from an address or a phone."""
    parsed = cut(_headers(spark, sf_dir).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), parse_address(F.col("header")).alias("p")))
    own = parsed.select("entity", F.when(F.col("p.email").isNotNull(), "email").otherwise("phone").alias("kind"), F.coalesce("p.email", "p.phone").alias("normalized"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("occurrences")).filter("normalized IS NOT NULL")
    said = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.lower("o_orderpriority").alias("normalized")).agg(F.max(F.lit(0.5) + (F.col("o_orderkey") % 4) * 0.1).alias("confidence"), F.count(F.lit(1)).alias("occurrences"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "+1 555 0100").alias("name"))
    identifiers = own.unionByName(said.withColumn("kind", F.lit("name")))
    return handle_names(own.select(F.col("normalized").alias("handle")), identifiers, people)


def normalized(vector: Column) -> Column:
    """RET-13: a vector of unit length; one of no length, or null, stays as it is."""
    values = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(values, lambda x: x / norm)).otherwise(values)


def first_vectors(chunks: DataFrame) -> DataFrame:
    """WIN-7: (item, vector) of (item, ordinal, vector): the vector of an item's first chunk, of unit length."""
    return chunks.groupBy("item").agg(F.min_by("vector", "ordinal").alias("vector")).select("item", normalized(F.col("vector")).alias("vector"))


@query(f"""WITH c AS (SELECT vec_id // {CHUNKS} AS item, arg_min(embedding, vec_id % {CHUNKS}) AS e FROM embeddings GROUP BY 1), v AS (SELECT item, list_transform(e, lambda x: x::DOUBLE) AS e FROM c), n AS (SELECT item, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
SELECT item, round(e[1] / norm, 6) AS first, round(list_sum(list_transform(e, lambda x: (x / norm) * (x / norm))), 6) AS length FROM n""")
def vectors_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7, RET-13: items' first chunks at unit length."""
    chunks = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {CHUNKS}").alias("item"), (F.col("vec_id") % CHUNKS).alias("ordinal"), F.col("embedding").alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return first_vectors(chunks).select("item", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(length, 6).alias("length"))


def both_ways(relation: DataFrame) -> DataFrame:
    """SET-5: a relation (a, b) with its reverse, each pair once."""
    return relation.select("a", "b").union(relation.select("b", "a")).distinct()


@query("WITH c AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) SELECT a, b FROM c UNION SELECT b, a FROM c")
def suppliers_in_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-5: suppliers that follow one another in an order, as a relation that goes both ways."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    return both_ways(lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("a"), "b"))


@query("""WITH r AS (SELECT o_orderkey AS task, o_custkey AS owner, CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) + 2592000000000 END AS due, epoch_us(o_orderdate) AS made FROM orders WHERE o_orderstatus <> 'F')
SELECT task, owner, coalesce(due, made) AS due, row_number() OVER (PARTITION BY owner ORDER BY coalesce(due, made), task) AS place FROM r QUALIFY place <= 10""")
def reminders_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-6: everybody's next ten open reminders, by when they are due or else were made."""
    from tidepool.sources.tables import micros

    made = micros("o_orderdate")
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("owner"), F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, made + 2_592_000_000_000), made).alias("due"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("due", "task"))
    return open_.withColumn("place", place.cast("long")).filter("place <= 10")
