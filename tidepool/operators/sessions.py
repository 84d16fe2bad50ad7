"""Conversation episodes: sessions of a thread, their transcripts and people."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, TURNS_SQL, chat_items, turns

#: An episode ends where nothing is said for more than four hours, at 80 messages, or 36 hours after it began.
GAP = 4 * 3_600_000_000
MOST_ITEMS = 80
MOST_SPAN = 36 * 3_600_000_000
#: Characters of a transcript's line, and of the whole.
LINE, WHOLE = 600, 6000


def by_gap(items: DataFrame, gap: int = GAP) -> DataFrame:
    """Add ``run``: the number of the item's gap-separated run within its thread, from 0."""
    order = Window.partitionBy("thread_id").orderBy("t", "item_id")
    new = (F.col("t") - F.lag("t").over(order) > gap).cast("int")
    return items.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(order).cast("long"))


def _parts(batches: Iterator[pd.DataFrame], gap: int, most_items: int, most_span: int) -> Iterator[pd.DataFrame]:
    """Items sorted by thread and time: the run and the part of it that each falls into."""
    thread, run, part, last, anchor, held = None, 0, 0, 0, 0, 0
    for batch in batches:
        runs, parts = [], []
        for own, t in zip(batch["thread_id"].tolist(), batch["t"].tolist()):
            if own != thread:
                thread, run, part, anchor, held = own, 0, 0, t, 0
            elif t - last > gap:
                run, part, anchor, held = run + 1, 0, t, 0
            elif held >= most_items or t - anchor > most_span:
                part, anchor, held = part + 1, t, 0
            runs.append(run)
            parts.append(part)
            last, held = t, held + 1
        yield batch.assign(run=runs, part=parts)


def episodes(items: DataFrame, gap: int = GAP, most_items: int = MOST_ITEMS, most_span: int = MOST_SPAN) -> DataFrame:
    """Episodes (thread_id, run, part, members): runs, cut further at the limits of size and span.

    Where a cut falls depends on the cuts before it, so a thread's items go by
    as a sorted stream that keeps a counter and a time; only then are members
    collected, at most ``most_items`` of them.
    """
    slim = items.select("thread_id", "t", "item_id", "direction").repartition("thread_id").sortWithinPartitions("thread_id", "t", "item_id")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    placed = slim.mapInPandas(lambda it: _parts(it, gap, most_items, most_span), ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", run long, part int")
    return placed.groupBy("thread_id", "run", "part").agg(F.sort_array(F.collect_list(F.struct("t", "item_id", "direction"))).alias("members"))


def _episodes_sql(gap: int, most_items: int, most_span: int) -> str:
    return f"""{CHAT_SQL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {gap} THEN 1 ELSE 0 END AS new FROM chat WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id)),
q AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY t, item_id)::BIGINT AS run FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY thread_id, run ORDER BY t, item_id) AS n FROM q),
e AS (SELECT thread_id, run, n, item_id, t, 0 AS part, t AS anchor, 1 AS held FROM n WHERE n = 1
UNION ALL SELECT n.thread_id, n.run, n.n, n.item_id, n.t, CASE WHEN held >= {most_items} OR n.t - anchor > {most_span} THEN part + 1 ELSE part END, CASE WHEN held >= {most_items} OR n.t - anchor > {most_span} THEN n.t ELSE anchor END, CASE WHEN held >= {most_items} OR n.t - anchor > {most_span} THEN 1 ELSE held + 1 END
FROM e JOIN n ON n.thread_id = e.thread_id AND n.run = e.run AND n.n = e.n + 1)"""


def episode_id(members: Column) -> Column:
    """A key of the episode's items, whatever their order."""
    ids = F.array_sort(F.transform(members, lambda m: m["item_id"].cast("string")))
    return F.concat(F.lit("ep_"), F.substring(F.sha2(F.array_join(ids, "|"), 256), 1, 16))


def speaker_lines(text: Column, speaker: Column) -> Column:
    """A turn as a line of a transcript: white space collapsed, cut to a length, empty if nothing is said."""
    said = F.substring(F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " ")), 1, LINE)
    return F.when(said != "", F.concat(speaker, F.lit(": "), said))


def transcripts(lines: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """(group, transcript, speakers, n_lines): lines joined until the whole is used up, then "..."."""
    by = Window.partitionBy(group).orderBy(order)
    told = lines.withColumn("line", speaker_lines(F.col("text"), F.col("speaker"))).filter("line IS NOT NULL")
    used = told.withColumn("used", F.sum(F.char_length("line") + 1).over(by) - F.char_length("line") - 1)
    cut = used.withColumn("line", F.when(F.col("used") < WHOLE, F.col("line")).otherwise("..."))
    kept = cut.withColumn("over", F.sum((F.col("used") >= WHOLE).cast("int")).over(by)).filter("over <= 1")
    joined = kept.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, "line", "speaker"))).alias("x"))
    return joined.select(
        group,
        F.array_join(F.transform("x", lambda m: m["line"]), "\n").alias("transcript"),
        F.array_join(F.array_remove(F.array_distinct(F.transform("x", lambda m: m["speaker"])), "Me"), ", ").alias("speakers"),
        F.size("x").cast("long").alias("n_lines"),
    )


_RUNS = f"""{CHAT_SQL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM chat WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY t, item_id)::BIGINT AS run FROM g)"""


@query(f"WITH {_RUNS} SELECT thread_id, run, count(*) AS items, min(t) AS starts, max(t) AS ends, count(*) FILTER (direction = 'outbound') AS outbound FROM runs GROUP BY thread_id, run")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-1: threads cut into runs where a gap exceeds four hours."""
    return by_gap(chat_items(spark, sf_dir)).groupBy("thread_id", "run").agg(F.count(F.lit(1)).alias("items"), F.min("t").alias("starts"), F.max("t").alias("ends"), F.count_if(F.col("direction") == "outbound").alias("outbound"))


@query(f"WITH RECURSIVE {_episodes_sql(GAP, MOST_ITEMS, MOST_SPAN)} SELECT 'ep_' || substr(sha256(string_agg(item_id::VARCHAR, '|' ORDER BY item_id::VARCHAR)), 1, 16) AS episode_id, thread_id, count(*) AS items, min(t) AS starts, max(t) AS ends FROM e GROUP BY thread_id, run, part")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-2, SES-6: episodes with their limits of size and span, under a key of their members."""
    made = episodes(chat_items(spark, sf_dir))
    return made.select(episode_id(F.col("members")).alias("episode_id"), "thread_id", F.size("members").cast("long").alias("items"), F.element_at("members", 1)["t"].alias("starts"), F.element_at("members", -1)["t"].alias("ends"))


@query(f"WITH RECURSIVE {_episodes_sql(12 * 3_600_000_000, 3, 6 * 3_600_000_000)} SELECT thread_id, run, part, count(*) AS items, min(t) AS starts FROM e GROUP BY thread_id, run, part")
def episode_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-2: episodes under limits that bind on these data (3 messages, 6 hours)."""
    made = episodes(chat_items(spark, sf_dir), gap=12 * 3_600_000_000, most_items=3, most_span=6 * 3_600_000_000)
    return made.select("thread_id", "run", "part", F.size("members").cast("long").alias("items"), F.element_at("members", 1)["t"].alias("starts"))


@query(f"""WITH {TURNS_SQL}, l AS (SELECT *, substr(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')), 1, {LINE}) AS said FROM turns),
m AS (SELECT conv_id, turn, speaker, speaker || ': ' || said AS line FROM l WHERE said <> ''),
u AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS used FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, sum((used >= {WHOLE})::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS over_all FROM u),
d AS (SELECT conv_id, speaker, min(turn) AS first FROM k WHERE over_all <= 1 AND speaker <> 'Me' GROUP BY conv_id, speaker),
s AS (SELECT conv_id, string_agg(speaker, ', ' ORDER BY first) AS speakers FROM d GROUP BY conv_id)
SELECT conv_id, string_agg(CASE WHEN used < {WHOLE} THEN line ELSE '...' END, chr(10) ORDER BY turn) AS transcript, coalesce(min(s.speakers), '') AS speakers, count(*) AS n_lines
FROM k LEFT JOIN s USING (conv_id) WHERE over_all <= 1 GROUP BY conv_id""")
def transcript_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-3 to SES-5: conversations as transcripts with their speakers."""
    return transcripts(turns(spark, sf_dir))


@query(f"""WITH {CHAT_SQL}, c AS (SELECT thread_id, max(t) AS last, count(*) AS messages, count(*) FILTER (direction = 'outbound') AS sent FROM chat GROUP BY thread_id)
SELECT * FROM c ORDER BY last DESC, thread_id LIMIT 40""")
def correspondents_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7, TOOL-2: the most recent correspondents."""
    return chat_items(spark, sf_dir).groupBy("thread_id").agg(F.max("t").alias("last"), F.count(F.lit(1)).alias("messages"), F.count_if(F.col("direction") == "outbound").alias("sent")).orderBy(F.desc("last"), "thread_id").limit(40)


@query(f"""WITH {TURNS_SQL} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, text FROM turns QUALIFY back <= 2""")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2, WIN-6, CNV-2: the last turns of each conversation, numbered from the end."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns(spark, sf_dir).withColumn("back", back.cast("long")).filter("back <= 2").select("conv_id", "turn", "back", "text")


@query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, speaker, unnest(string_split(text, chr(10))) AS line FROM turns WHERE speaker <> 'Me')
SELECT conv_id, speaker, count(*) AS quotes, sum(length(line))::BIGINT AS characters FROM s WHERE trim(line) <> '' GROUP BY conv_id, speaker""")
def quotes_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-14: what each other speaker said, line by line."""
    lines = turns(spark, sf_dir).filter("speaker <> 'Me'").select("conv_id", "speaker", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.trim("line") != "").groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("quotes"), F.sum(F.char_length("line").cast("long")).alias("characters"))
