"""One table of nodes: messages, tasks, events and conversations, whatever they came from.

Documents stand for mails, benchmark items for tasks, pages for calendar events
and conversations for episodes; the given tables have no times for these, so
each gets one from its id.  Operators take any table of these columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.registry import query
from tidepool.sources.tables import TURNS_SQL, table, turns

HOUR, DAY = 3_600_000_000, 86_400_000_000
START = 1_700_000_000_000_000
#: Node texts end here (the reference's own feature).
MOST_TEXT = 4000
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def node_key(kind: str, id: Column) -> Column:  # noqa: A002
    return F.concat(F.lit(f"{kind}:"), id.cast("string"))


def parse_node(key: Column) -> tuple[Column, Column]:
    """(kind, id) of a node key; a bare episode id is an episode, any other bare id an item."""
    colon = F.instr(key, ":")
    bare = F.when(F.startswith(key, F.lit("ep_")), "episode").otherwise("item")
    return F.when(colon > 0, F.substring_index(key, ":", 1)).otherwise(bare), F.when(colon > 0, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, kind, stream, t, ends, title, text): text is the title, a newline and the body, up to MOST_TEXT characters."""

    def shaped(df: DataFrame, kind: str, id: str, stream: Column, step: int, title: Column, body: Column, lasts: int | None = None) -> DataFrame:  # noqa: A002
        t = F.lit(START) + F.col(id) * step
        ends = F.lit(None).cast("long") if lasts is None else t + lasts
        return df.select(node_key(kind, F.col(id)).alias("node"), F.lit(kind).alias("kind"), stream.alias("stream"), t.alias("t"), ends.alias("ends"), title.alias("title"), F.substring(F.concat_ws("\n", title, body), 1, MOST_TEXT).alias("text"))

    said = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n").alias("text"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    parts = [
        shaped(table(spark, sf_dir, "documents"), "message", "doc_id", F.col("source"), 6 * HOUR, F.substring("text", 1, 60), F.col("text")),
        shaped(table(spark, sf_dir, "benchmark"), "task", "item_id", F.lit("tasks"), 150 * HOUR, F.substring("text", 1, 60), F.lit(None).cast("string")),
        shaped(table(spark, sf_dir, "pages"), "event", "page_id", F.lit("calendar"), 24 * HOUR, title, F.lit(None).cast("string"), lasts=2 * HOUR),
        shaped(said, "episode", "conv_id", F.lit("chat"), 12 * HOUR, F.lit(None).cast("string"), F.col("text"), lasts=HOUR),
    ]
    return reduce(DataFrame.unionByName, parts)


def _shape_sql(kind: str, id: str, stream: str, step: int, title: str, body: str, source: str, lasts: int | None = None) -> str:  # noqa: A002
    t = f"{START} + {id} * {step}"
    return f"SELECT '{kind}:' || {id} AS node, '{kind}' AS kind, {stream} AS stream, ({t})::BIGINT AS t, {'NULL' if lasts is None else f'{t} + {lasts}'}::BIGINT AS ends, {title} AS title, substr(concat_ws(chr(10), {title}, {body}), 1, {MOST_TEXT}) AS text FROM {source}"


NODES_SQL = f"""{TURNS_SQL}, said AS (SELECT conv_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id), nodes AS (
{_shape_sql('message', 'doc_id', 'source', 6 * HOUR, 'substr(text, 1, 60)', 'text', 'documents')} UNION ALL
{_shape_sql('task', 'item_id', "'tasks'", 150 * HOUR, 'substr(text, 1, 60)', 'NULL::VARCHAR', 'benchmark')} UNION ALL
{_shape_sql('event', 'page_id', "'calendar'", 24 * HOUR, "regexp_extract(html, '<title>([^<]*)</title>', 1)", 'NULL::VARCHAR', 'pages', 2 * HOUR)} UNION ALL
{_shape_sql('episode', 'conv_id', "'chat'", 12 * HOUR, 'NULL::VARCHAR', 'text', 'said', HOUR)})"""


@query(f"WITH {NODES_SQL} SELECT node, kind, stream, t, ends, title, length(text) AS characters, md5(text) AS digest FROM nodes")
def nodes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-2, NOD-1, NOD-2, JOI-14: items and episodes as one table of nodes."""
    return nodes(spark, sf_dir).select("node", "kind", "stream", "t", "ends", "title", F.char_length("text").cast("long").alias("characters"), F.md5("text").alias("digest"))


@query("SELECT 'episode:' || conv_id AS node, conv_id || '/' || turn AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations")
def node_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOD-3, NOD-6: an episode's member items in order of time."""
    from pyspark.sql import Window

    said = table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return said.select(node_key("episode", F.col("conv_id")).alias("node"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item"), place.cast("long").alias("place"))


def people(found: DataFrame) -> DataFrame:
    """(node, person): the distinct hosts that a node's addresses write from; the owner's own host is the owner and is left out."""
    mails = F.expr(f"regexp_extract_all(lower(text), '{MAIL}', 0)".replace("\\", "\\\\"))
    return found.select("node", F.explode(F.array_distinct(F.transform(mails, lambda m: F.substring_index(m, "@", -1)))).alias("person")).filter(~F.startswith("person", F.lit("mail0.")))


PEOPLE_SQL = f"people AS (SELECT DISTINCT node, person FROM (SELECT node, regexp_extract(unnest(regexp_extract_all(lower(text), '{MAIL}')), '@(.*)$', 1) AS person FROM nodes) WHERE NOT starts_with(person, 'mail0.'))"


@query(f"WITH {NODES_SQL}, {PEOPLE_SQL} SELECT node, count(*) AS people, string_agg(person, ',' ORDER BY person) AS who FROM people GROUP BY node")
def node_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOD-4: each node's people but for oneself."""
    return people(nodes(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("people"), F.array_join(F.array_sort(F.collect_list("person")), ",").alias("who"))


@query("SELECT source AS stream, count(*) AS items FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) FILTER (text LIKE '%@%') > 0) GROUP BY source")
def conversational_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOD-7: streams that people write in, and their items."""
    documents = table(spark, sf_dir, "documents")
    written = documents.filter("text LIKE '%@%'").select("source").distinct()
    return documents.join(written, "source", "left_semi").groupBy(F.col("source").alias("stream")).agg(F.count(F.lit(1)).alias("items"))


def node_terms(found: DataFrame) -> DataFrame:
    """(node, term): a node's content terms."""
    return found.select("node", F.explode(T.content_terms(F.col("text"))).alias("term"))
