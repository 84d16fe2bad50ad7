"""Candidate pairs of nodes, and the rules that link them or say why not.

Candidates share a rare word, a person or a stretch of time, each with its own
bound on partners as a feature; the rules are expressions over a pair.  Rare
words are those of few nodes, so a word's group is small by definition; the
others are the nearest in time (:mod:`bands`), and people of very many nodes in
a window are bulk and skipped before any pair is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.bands import nearest_in_band
from tidepool.operators.nodes import DAY, HOUR, NODES_SQL, PEOPLE_SQL, node_terms, nodes, people
from tidepool.plans.lineage import cut
from tidepool.registry import query

#: Windows and bounds of the candidates and rules.
CONTENT_SPAN, CONTENT_MOST = 60 * DAY, 12
PERSON_SPAN, PERSON_MOST, PERSON_BULK = 14 * DAY, 60, 240
TASK_SPAN, TASK_MOST, TASK_BACK_MOST = 21 * DAY, 40, 20
MOST_CANDIDATES = 200
ARRANGES_SPAN, TRACKS_SPAN, ADJACENT_SPAN, SINGLE_WORD_SPAN = 21 * DAY, 7 * DAY, 2 * HOUR, 30 * DAY
SPEAKS = ("message", "episode")


def rare_terms(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, term, df, weight, solo) of every node's rare words, and the one row (n, ceiling, solo) they follow from."""
    terms = cut(node_terms(found))
    n = found.agg(F.count(F.lit(1)).alias("n"))
    size = n.withColumn("ceiling", F.least(F.lit(120), F.greatest(F.lit(5), F.round(F.col("n") * 0.005)))).withColumn("solo", F.greatest(F.lit(3), F.round(F.col("ceiling") / 6)))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size)).filter("df <= ceiling")
    return terms.join(counted.select("term", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("weight"), "solo"), "term"), size


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
RARE_SQL = f"""w AS (SELECT node, list_filter(string_split_regex(regexp_replace(lower(substr(text, 1, 1500)), {T.sql(T.LINKS)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: length(x) >= 4 AND regexp_matches(x, '\\p{{L}}') AND NOT list_contains({_STOP}, x)) AS w FROM nodes),
u AS (SELECT node, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM w), f AS (SELECT node, term, min(place) AS place FROM u GROUP BY ALL),
terms AS (SELECT node, term FROM f QUALIFY row_number() OVER (PARTITION BY node ORDER BY place) <= 24),
size AS (SELECT count(*) AS n, least(120, greatest(5, round(count(*) * 0.005))) AS ceiling, greatest(3, round(least(120, greatest(5, round(count(*) * 0.005))) / 6)) AS solo FROM nodes),
counted AS (SELECT term, count(*) AS df, round(ln(min(n)::DOUBLE / count(*)), 6) AS weight, min(solo) AS solo FROM terms, size GROUP BY term HAVING count(*) <= min(ceiling)),
rare AS (SELECT node, term, df, weight, solo FROM terms JOIN counted USING (term))"""


def _near(met: DataFrame, by: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("away", "b"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def content_candidates(found: DataFrame, rare: DataFrame) -> DataFrame:
    """(a, b, via): per rare word of a, the items and the episodes nearest to it that hold the word, at most so many of each."""
    holders = rare.select("term", "node").join(found.select("node", "t", (F.col("kind") == "episode").alias("is_episode")), "node")
    left = holders.select("term", F.col("node").alias("a"), F.col("t").alias("at"))
    right = holders.select("term", F.col("node").alias("b"), F.col("t").alias("bt"), "is_episode")
    met = left.join(right, "term").filter("a <> b").withColumn("away", F.abs(F.col("at") - F.col("bt"))).filter(F.col("away") <= CONTENT_SPAN)
    return _near(met, ["a", "term", "is_episode"], CONTENT_MOST).select("a", "b", F.concat(F.lit("word:"), "term").alias("via"), "away")


_CONTENT_SQL = f"""ch AS (SELECT r.term, r.node, n.t, n.kind = 'episode' AS is_episode FROM rare r JOIN nodes n USING (node)),
content AS (SELECT l.node AS a, r.node AS b, 'word:' || l.term AS via, abs(l.t - r.t) AS away FROM ch l JOIN ch r ON l.term = r.term AND l.node <> r.node AND abs(l.t - r.t) <= {CONTENT_SPAN}
  QUALIFY row_number() OVER (PARTITION BY l.node, l.term, r.is_episode ORDER BY abs(l.t - r.t), r.node) <= {CONTENT_MOST})"""


def person_candidates(found: DataFrame, who: DataFrame) -> DataFrame:
    """(a, b, via, away): nodes of a's people around it; a person of more than PERSON_BULK nodes in a's window is bulk, which is counted before any pair is made."""
    timed = who.join(found.select("node", "t"), "node").select(F.col("node").alias("id"), F.col("person").alias("key"), "t")
    near = nearest_in_band(timed, timed, width=PERSON_SPAN, most=PERSON_MOST, bulk=PERSON_BULK)
    return near.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.concat(F.lit("person:"), "key").alias("via"), "away")


_PERSON_SQL = f"""pt AS (SELECT node, person, t FROM people JOIN nodes USING (node)),
pm AS (SELECT l.node AS a, r.node AS b, l.person, abs(l.t - r.t) AS away, count(*) OVER (PARTITION BY l.node, l.person) AS n FROM pt l JOIN pt r ON l.person = r.person AND abs(l.t - r.t) <= {PERSON_SPAN}),
person AS (SELECT a, b, 'person:' || person AS via, away FROM pm WHERE n <= {PERSON_BULK} AND a <> b QUALIFY row_number() OVER (PARTITION BY a, person ORDER BY away, b) <= {PERSON_MOST})"""


def task_candidates(found: DataFrame) -> DataFrame:
    """(a, b, via, away): what is near a task in time, and the tasks near what was said."""

    def near(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
        sides = [side.select(F.col("node").alias("id"), F.lit(0).alias("key"), "t") for side in (left, right)]
        return nearest_in_band(*sides, width=TASK_SPAN, most=most)

    task, said, other = found.filter("kind = 'task'"), found.filter(F.col("kind").isin(*SPEAKS)), found.filter("kind <> 'task'")
    both = near(task, other, TASK_MOST).unionByName(near(said, task, TASK_BACK_MOST))
    return both.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.lit("task").alias("via"), "away")


_TASK_SQL = f"""task AS (SELECT * FROM (SELECT l.node AS a, r.node AS b, 'task' AS via, abs(l.t - r.t) AS away FROM nodes l JOIN nodes r ON abs(l.t - r.t) <= {TASK_SPAN} WHERE l.kind = 'task' AND r.kind <> 'task'
  QUALIFY row_number() OVER (PARTITION BY l.node ORDER BY abs(l.t - r.t), r.node) <= {TASK_MOST}) UNION ALL
SELECT * FROM (SELECT l.node AS a, r.node AS b, 'task' AS via, abs(l.t - r.t) AS away FROM nodes l JOIN nodes r ON abs(l.t - r.t) <= {TASK_SPAN} WHERE l.kind IN {SPEAKS} AND r.kind = 'task'
  QUALIFY row_number() OVER (PARTITION BY l.node ORDER BY abs(l.t - r.t), r.node) <= {TASK_BACK_MOST}))"""


def merged(candidates: list[DataFrame], most: int = MOST_CANDIDATES) -> DataFrame:
    """(a, b, via, away): each pair once with all that led to it, and of each node the nearest."""
    union = candidates[0]
    for more in candidates[1:]:
        union = union.unionByName(more)
    pairs = union.groupBy("a", "b").agg(F.array_sort(F.collect_set("via")).alias("via"), F.min("away").alias("away"))
    return _near(pairs, ["a"], most)


_MERGED_SQL = f"""merged AS (SELECT a, b, list_sort(list_distinct(list(via))) AS via, min(away) AS away FROM (SELECT * FROM content UNION ALL SELECT * FROM person UNION ALL SELECT * FROM task) GROUP BY a, b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY min(away), b) <= {MOST_CANDIDATES})"""
_ALL_SQL = f"WITH {NODES_SQL}, {PEOPLE_SQL}, {RARE_SQL}, {_CONTENT_SQL}, {_PERSON_SQL}, {_TASK_SQL}, {_MERGED_SQL}"


class _Given:
    """What the queries below share, each part computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.nodes = cut(nodes(spark, sf_dir))
        self.people = cut(people(self.nodes))
        self.rare, self.size = rare_terms(self.nodes)
        self.rare = cut(self.rare)

    def candidates(self) -> DataFrame:
        return merged([content_candidates(self.nodes, self.rare), person_candidates(self.nodes, self.people), task_candidates(self.nodes)])


@query(f"{_ALL_SQL} SELECT a, b, via, away FROM content")
def content_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-6, JOI-11, TOP-7: pairs by rare words, the twelve nearest items and episodes per word."""
    given = _Given(spark, sf_dir)
    return content_candidates(given.nodes, given.rare)


@query(f"{_ALL_SQL} SELECT a, b, via, away FROM person")
def person_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-4, JOI-13: pairs by a shared person within two weeks, bulk left out."""
    given = _Given(spark, sf_dir)
    return person_candidates(given.nodes, given.people)


@query(f"{_ALL_SQL} SELECT a, b, via, away FROM task")
def task_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-5: tasks and what is near them in time."""
    return task_candidates(nodes(spark, sf_dir))


@query(f"{_ALL_SQL} SELECT a, b, array_to_string(via, '|') AS via, away FROM merged")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-7: all candidates, each pair once with its reasons."""
    return _Given(spark, sf_dir).candidates().select("a", "b", F.array_join("via", "|").alias("via"), "away")


def paired(candidates: DataFrame, found: DataFrame, rare: DataFrame, who: DataFrame) -> DataFrame:
    """Candidates with both nodes (structs x of a, y of b), the rare words of x that y's text holds, their weight, and the people both have."""
    side = F.struct("kind", "stream", "t", "ends", "title", F.lower("text").alias("low"))
    told = rare.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("term", "df", "weight", "solo"))).alias("terms"))
    shown = who.groupBy("node").agg(F.collect_set("person").alias("who"))
    left = found.select(F.col("node").alias("a"), side.alias("x")).join(told.withColumnRenamed("node", "a"), "a", "left").join(shown.select(F.col("node").alias("a"), F.col("who").alias("x_who")), "a", "left")
    right = found.select(F.col("node").alias("b"), side.alias("y")).join(shown.select(F.col("node").alias("b"), F.col("who").alias("y_who")), "b", "left")
    both = candidates.join(left, "a").join(right, "b")
    words = F.filter(F.coalesce("terms", F.array().cast("array<struct<term:string,df:bigint,weight:double,solo:double>>")), lambda w: F.contains(F.col("y.low"), w["term"]))
    shared = F.size(F.array_intersect(F.coalesce("x_who", F.array().cast("array<string>")), F.coalesce("y_who", F.array().cast("array<string>"))))
    return both.withColumn("words", words).withColumn("shared", shared).withColumn("strong", (F.size("words") > 1) | (F.get("words", F.lit(0))["df"] <= F.get("words", F.lit(0))["solo"]))


_PAIRED_SQL = f"""{_ALL_SQL}, p AS (SELECT a, b, m.via, x.kind AS xk, y.kind AS yk, x.stream AS xs, y.stream AS ys, x.t AS xt, y.t AS yt, x.ends AS xe, y.ends AS ye, lower(x.text) AS xl, lower(y.text) AS yl, x.title AS xtitle, y.title AS ytitle,
  (SELECT count(*) FROM people c JOIN people d ON c.person = d.person WHERE c.node = a AND d.node = b) AS shared
  FROM merged m JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b),
pw AS (SELECT a, b, count(*) AS n, min(df) AS df, min(solo) AS solo, sum(weight) AS weight, string_agg(term, ',' ORDER BY term) AS words FROM p JOIN rare ON rare.node = a AND contains(yl, term) GROUP BY a, b),
paired AS (SELECT p.*, coalesce(n, 0) AS n_words, coalesce(n > 1 OR df <= solo, false) AS strong, coalesce(weight, 0) AS weight, coalesce(words, '') AS words FROM p LEFT JOIN pw USING (a, b))"""


def _words(column: str = "words") -> Column:
    return F.array_join(F.transform(column, lambda w: w["term"]), ",")


def arranges(pairs: DataFrame) -> DataFrame:
    """LNK-3, LNK-9: of pairs oriented (said, event): the edge, or why there is none."""
    turned = pairs.filter(F.col("x.kind").isin(*SPEAKS) & (F.col("y.kind") == "event"))
    gap = F.col("y.t") - F.coalesce("x.ends", "x.t")
    title = F.trim(F.lower(F.coalesce("y.title", F.lit(""))))
    named = (F.char_length(title) > 6) & F.contains(F.col("x.low"), title)
    some, met = F.size("words") > 0, F.col("shared") > 0
    rejected = F.when(gap <= 0, "after the event").when(gap > ARRANGES_SPAN, "past the window").when(~named & ~some & ~met, "nothing in common")
    kind = F.when(named, "arranges").when(some & F.col("strong"), "arranges").otherwise("mentions_when")
    confidence = F.when(named, 0.85).when(some & F.col("strong"), 0.7).when(some, 0.45).otherwise(0.4)
    return turned.select("a", "b", F.when(rejected.isNull(), kind).alias("kind"), F.when(rejected.isNull(), confidence).alias("confidence"), rejected.alias("rejected"))


_ARRANGES_SQL = f"""arr AS (SELECT a, b, yt - coalesce(xe, xt) AS gap, length(trim(lower(coalesce(ytitle, '')))) > 6 AND contains(xl, trim(lower(coalesce(ytitle, '')))) AS named, n_words > 0 AS worded, strong, shared > 0 AS met FROM paired WHERE xk IN {SPEAKS} AND yk = 'event'),
arranged AS (SELECT *, CASE WHEN gap <= 0 THEN 'after the event' WHEN gap > {ARRANGES_SPAN} THEN 'past the window' WHEN NOT named AND NOT worded AND NOT met THEN 'nothing in common' END AS rejected FROM arr)"""


@query(f"""{_PAIRED_SQL}, {_ARRANGES_SQL} SELECT a, b, CASE WHEN rejected IS NULL THEN CASE WHEN named OR (worded AND strong) THEN 'arranges' ELSE 'mentions_when' END END AS kind,
CASE WHEN rejected IS NULL THEN CASE WHEN named THEN 0.85::DOUBLE WHEN worded AND strong THEN 0.7::DOUBLE WHEN worded THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END END AS confidence, rejected FROM arranged""")
def arranges_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK-3, LNK-8: what was said before an event and seems to have arranged it."""
    given = _Given(spark, sf_dir)
    return arranges(paired(given.candidates(), given.nodes, given.rare, given.people))


def tracks(pairs: DataFrame) -> DataFrame:
    """LNK-4: of pairs (task, other): linked if most of the task's long words, two at least, are in the other's text."""
    turned = pairs.filter((F.col("x.kind") == "task") & (F.col("y.kind") != "task"))
    words = F.filter(F.split(F.lower(F.coalesce("x.title", F.lit(""))), "[^A-Za-z0-9_]+"), lambda w: F.char_length(w) > 4)
    hits = F.size(F.filter("long", lambda w: F.contains(F.col("y.low"), w)))
    staged = turned.withColumn("long", words).withColumn("hits", hits)
    gap = F.abs(F.col("x.t") - F.col("y.t"))
    rejected = F.when(gap > TRACKS_SPAN, "not the nearest occasion").when(F.size("long") == 0, "no long words").when((F.col("hits") < 2) | (F.col("hits") < F.size("long") * 0.6), "too few words")
    return staged.select("a", "b", F.when(rejected.isNull(), 0.7).alias("confidence"), rejected.alias("rejected"), F.col("hits").cast("long").alias("hits"))


@query(f"""{_PAIRED_SQL}, tr AS (SELECT a, b, abs(xt - yt) AS gap, yl, list_filter(string_split_regex(lower(coalesce(xtitle, '')), '[^A-Za-z0-9_]+'), lambda w: length(w) > 4) AS long FROM paired WHERE xk = 'task' AND yk <> 'task'),
th AS (SELECT *, len(list_filter(long, lambda w: contains(yl, w))) AS hits FROM tr),
tj AS (SELECT *, CASE WHEN gap > {TRACKS_SPAN} THEN 'not the nearest occasion' WHEN len(long) = 0 THEN 'no long words' WHEN hits < 2 OR hits < len(long) * 0.6 THEN 'too few words' END AS rejected FROM th)
SELECT a, b, CASE WHEN rejected IS NULL THEN 0.7::DOUBLE END AS confidence, rejected, hits FROM tj""")
def tracks_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK-4: tasks and what they are about."""
    given = _Given(spark, sf_dir)
    return tracks(paired(given.candidates(), given.nodes, given.rare, given.people))


def about_same(pairs: DataFrame) -> DataFrame:
    """LNK-5, LNK-7: of pairs from different streams that a rare word brought together: linked by the rare words that both hold."""
    turned = pairs.filter((F.col("x.stream") != F.col("y.stream")) & F.exists("via", lambda v: F.startswith(v, F.lit("word:"))))
    gap = F.abs(F.coalesce("x.ends", "x.t") - F.col("y.t"))
    weight = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["weight"])
    confidence = F.least(F.lit(0.8), 0.4 + weight / 30) * F.greatest(F.lit(0.8), 1 - gap / CONTENT_SPAN / 5)
    rejected = F.when(F.size("words") == 0, "word too common").when(~F.col("strong"), "one common word").when((F.size("words") == 1) & (gap > SINGLE_WORD_SPAN), "one word, far apart")
    return turned.select("a", "b", F.when(rejected.isNull(), F.round(confidence, 2)).alias("confidence"), rejected.alias("rejected"), _words().alias("words"))


@query(f"""{_PAIRED_SQL}, ab AS (SELECT *, abs(coalesce(xe, xt) - yt) AS gap FROM paired WHERE xs <> ys AND len(list_filter(via, lambda v: v LIKE 'word:%')) > 0),
aj AS (SELECT *, CASE WHEN n_words = 0 THEN 'word too common' WHEN NOT strong THEN 'one common word' WHEN n_words = 1 AND gap > {SINGLE_WORD_SPAN} THEN 'one word, far apart' END AS rejected FROM ab)
SELECT a, b, CASE WHEN rejected IS NULL THEN round(least(0.8, 0.4 + weight / 30) * greatest(0.8, 1 - gap::DOUBLE / {CONTENT_SPAN} / 5), 2) END AS confidence, rejected, words FROM aj""")
def about_same_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK-5, LNK-7: nodes of different streams about the same rare subject."""
    given = _Given(spark, sf_dir)
    return about_same(paired(given.candidates(), given.nodes, given.rare, given.people))


def adjacent(pairs: DataFrame, within: int = ADJACENT_SPAN) -> DataFrame:
    """LNK-6: of pairs from different streams close in time: linked if they share a person."""
    turned = pairs.filter((F.col("x.stream") != F.col("y.stream")) & (F.abs(F.col("x.t") - F.col("y.t")) <= within))
    return turned.select("a", "b", F.when(F.col("shared") > 0, 0.35).alias("confidence"), F.when(F.col("shared") == 0, "no shared person").alias("rejected"))


@query(f"{_PAIRED_SQL} SELECT a, b, CASE WHEN shared > 0 THEN 0.35::DOUBLE END AS confidence, CASE WHEN shared = 0 THEN 'no shared person' END AS rejected FROM paired WHERE xs <> ys AND abs(xt - yt) <= {ADJACENT_SPAN}")
def adjacent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK-6: close in time, same person, different streams."""
    given = _Given(spark, sf_dir)
    return adjacent(paired(given.candidates(), given.nodes, given.rare, given.people))


@query(f"""WITH chat AS (SELECT event_id AS item_id, user_id AS thread_id, epoch_us(ts) AS t FROM events),
n AS (SELECT item_id, thread_id, t, lead(item_id) OVER w AS after, lead(t) OVER w AS after_t FROM chat WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id))
SELECT least(item_id, after) AS a, greatest(item_id, after) AS b, 'same_thread' AS kind, 1.0::DOUBLE AS confidence FROM n WHERE after_t - t <= {30 * DAY}""")
def same_thread_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK-1, GRF-2, WIN-1: neighbours in a thread within thirty days."""
    from tidepool.operators.threads import neighbours
    from tidepool.sources.tables import chat_items

    near = neighbours(chat_items(spark, sf_dir), 30 * DAY).filter("after IS NOT NULL")
    return near.select(F.least("item_id", "after").alias("a"), F.greatest("item_id", "after").alias("b"), F.lit("same_thread").alias("kind"), F.lit(1.0).alias("confidence"))


def explained(pairs: DataFrame) -> DataFrame:
    """GRF-11, LNK-8: (a, b, linker, kind, confidence, rejected): what every rule says of every candidate, by the code that draws the edges."""
    parts = [
        arranges(pairs).select("a", "b", F.lit("arranges").alias("linker"), "kind", "confidence", "rejected"),
        tracks(pairs).select("a", "b", F.lit("tracks").alias("linker"), F.when(F.col("rejected").isNull(), "tracks").alias("kind"), "confidence", "rejected"),
        about_same(pairs).select("a", "b", F.lit("about_same").alias("linker"), F.when(F.col("rejected").isNull(), "about_same").alias("kind"), "confidence", "rejected"),
        adjacent(pairs).select("a", "b", F.lit("adjacent").alias("linker"), F.when(F.col("rejected").isNull(), "adjacent").alias("kind"), "confidence", "rejected"),
    ]
    return reduce(DataFrame.unionByName, parts)


def why(pairs: DataFrame, node: str) -> DataFrame:
    """GRF-11: the same for one node's candidates; nothing is written."""
    return explained(pairs.filter(F.col("a") == node))


@query(f"""{_PAIRED_SQL}, {_ARRANGES_SQL}, tr AS (SELECT a, b, abs(xt - yt) AS gap, yl, list_filter(string_split_regex(lower(coalesce(xtitle, '')), '[^A-Za-z0-9_]+'), lambda w: length(w) > 4) AS long FROM paired WHERE xk = 'task' AND yk <> 'task'),
th AS (SELECT *, len(list_filter(long, lambda w: contains(yl, w))) AS hits FROM tr), ab AS (SELECT *, abs(coalesce(xe, xt) - yt) AS gap FROM paired WHERE xs <> ys AND len(list_filter(via, lambda v: v LIKE 'word:%')) > 0),
j AS (SELECT 'arranges' AS linker, rejected FROM arranged UNION ALL SELECT 'tracks', CASE WHEN gap > {TRACKS_SPAN} THEN 'not the nearest occasion' WHEN len(long) = 0 THEN 'no long words' WHEN hits < 2 OR hits < len(long) * 0.6 THEN 'too few words' END FROM th
UNION ALL SELECT 'about_same', CASE WHEN n_words = 0 THEN 'word too common' WHEN NOT strong THEN 'one common word' WHEN n_words = 1 AND gap > {SINGLE_WORD_SPAN} THEN 'one word, far apart' END FROM ab
UNION ALL SELECT 'adjacent', CASE WHEN shared = 0 THEN 'no shared person' END FROM paired WHERE xs <> ys AND abs(xt - yt) <= {ADJACENT_SPAN})
SELECT linker, coalesce(rejected, 'drawn') AS outcome, count(*) AS pairs FROM j GROUP BY ALL""")
def links_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-11, LNK-8: how often each rule drew an edge, and why it did not."""
    given = _Given(spark, sf_dir)
    judged = explained(cut(paired(given.candidates(), given.nodes, given.rare, given.people)))
    return judged.groupBy("linker", F.coalesce("rejected", F.lit("drawn")).alias("outcome")).agg(F.count(F.lit(1)).alias("pairs"))


def relate(found: DataFrame, who: DataFrame, rare: DataFrame) -> DataFrame:
    """GRF-10: candidates of all kinds judged by all rules: (a, b, kind, confidence, detector), each pair and kind once."""
    pairs = cut(paired(merged([content_candidates(found, rare), person_candidates(found, who), task_candidates(found)]), found, rare, who))
    made = [
        arranges(pairs).filter("rejected IS NULL").select("a", "b", "kind", "confidence"),
        tracks(pairs).filter("rejected IS NULL").select("a", "b", F.lit("tracks").alias("kind"), "confidence"),
        about_same(pairs).filter("rejected IS NULL").select("a", "b", F.lit("about_same").alias("kind"), "confidence"),
        adjacent(pairs).filter("rejected IS NULL").select("a", "b", F.lit("adjacent").alias("kind"), "confidence"),
    ]
    union = made[0]
    for more in made[1:]:
        union = union.unionByName(more)
    return union.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").agg(F.max("confidence").alias("confidence"))


@query(f"""{_PAIRED_SQL}, {_ARRANGES_SQL}, tr AS (SELECT a, b, abs(xt - yt) AS gap, yl, list_filter(string_split_regex(lower(coalesce(xtitle, '')), '[^A-Za-z0-9_]+'), lambda w: length(w) > 4) AS long FROM paired WHERE xk = 'task' AND yk <> 'task'),
th AS (SELECT *, len(list_filter(long, lambda w: contains(yl, w))) AS hits FROM tr), ab AS (SELECT *, abs(coalesce(xe, xt) - yt) AS gap FROM paired WHERE xs <> ys AND len(list_filter(via, lambda v: v LIKE 'word:%')) > 0),
e AS (SELECT a, b, CASE WHEN named OR (worded AND strong) THEN 'arranges' ELSE 'mentions_when' END AS kind, CASE WHEN named THEN 0.85::DOUBLE WHEN worded AND strong THEN 0.7::DOUBLE WHEN worded THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM arranged WHERE rejected IS NULL
UNION ALL SELECT a, b, 'tracks', 0.7::DOUBLE FROM th WHERE gap <= {TRACKS_SPAN} AND len(long) > 0 AND hits >= 2 AND hits >= len(long) * 0.6
UNION ALL SELECT a, b, 'about_same', round(least(0.8, 0.4 + weight / 30) * greatest(0.8, 1 - gap::DOUBLE / {CONTENT_SPAN} / 5), 2) FROM ab WHERE n_words > 0 AND strong AND (n_words > 1 OR gap <= {SINGLE_WORD_SPAN})
UNION ALL SELECT a, b, 'adjacent', 0.35::DOUBLE FROM paired WHERE xs <> ys AND abs(xt - yt) <= {ADJACENT_SPAN} AND shared > 0)
SELECT least(a, b) AS a, greatest(a, b) AS b, kind, max(confidence) AS confidence FROM e GROUP BY 1, 2, 3""")
def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-10: the whole pass over all nodes: candidates, rules, one edge per pair and kind."""
    given = _Given(spark, sf_dir)
    return relate(given.nodes, given.people, given.rare)
