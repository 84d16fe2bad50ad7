"""People and what they owe: entities, commitments, observations and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.threads import band_nearest
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, TASKS_SQL, chat_items, micros, table, tasks

DAY = 86_400_000_000


@query("""SELECT c_custkey AS entity_id, any_value(c_name) AS name, any_value(n_name) AS nation, count(o_orderkey) AS items, count(*) FILTER (o_orderstatus = 'F') AS done, max(epoch_us(o_orderdate)) AS last
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY items DESC, entity_id LIMIT 50""")
def entity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, AGG-9, JOI-1, JOI-2: the entities with most items."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max(micros("o_orderdate")).alias("last"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))
    joined = people.join(counted, "entity_id", "left").select("entity_id", "name", "nation", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("done", F.lit(0)).alias("done"), "last")
    return joined.orderBy(F.desc("items"), "entity_id").limit(50)


def find_people(people: DataFrame, name: str) -> DataFrame:
    """People whose id, name or alias fits: equal, alike, or beginning with the question."""
    asked = name.lower().strip()
    return people.filter((F.lower("name") == asked) | F.contains(F.lower("name"), F.lit(asked)) | F.exists("aliases", lambda a: F.startswith(a, F.lit(asked))))


@query("SELECT c_custkey AS entity_id, c_name AS name FROM customer WHERE lower(c_name) = '00012' OR contains(lower(c_name), '00012') OR starts_with(lower(string_split(c_name, '#')[2]), '00012')")
def entity_lookup_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by a part of their name."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.array(F.coalesce(F.try_element_at(F.split(F.lower("c_name"), "#"), F.lit(2)), F.lit(""))).alias("aliases"))
    return find_people(people, "00012").select("entity_id", "name")


@query(f"WITH {TASKS_SQL}, n AS (SELECT max(made) AS now FROM tasks) SELECT task_id, owner_id, title, due FROM tasks, n WHERE state = 'open' AND due >= now - 14 * {DAY} ORDER BY due, task_id LIMIT 100")
def commitments_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COM-6, COM-11, TOP-5: open commitments by when they are due."""
    made = tasks(spark, sf_dir)
    now = made.agg(F.max("made").alias("now"))
    return made.crossJoin(F.broadcast(now)).filter(f"state = 'open' AND due >= now - 14 * {DAY}").orderBy("due", "task_id").limit(100).select("task_id", "owner_id", "title", "due")


@query(f"""WITH {TASKS_SQL}, n AS (SELECT max(made) AS now FROM tasks), s AS (SELECT l_orderkey AS task_id, max(epoch_us(l_shipdate)) AS evidence FROM lineitem GROUP BY l_orderkey)
SELECT task_id, owner_id, due, evidence FROM tasks LEFT JOIN s USING (task_id), n WHERE state = 'open' AND due < now - 14 * {DAY} AND (evidence IS NULL OR evidence < now - 14 * {DAY})""")
def commitments_lapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COM-10, DET-7: commitments long due that nothing was heard of lately."""
    made = tasks(spark, sf_dir)
    now = made.agg(F.max("made").alias("now"))
    heard = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max(micros("l_shipdate")).alias("evidence"))
    joined = made.filter("state = 'open'").join(heard, "task_id", "left").crossJoin(F.broadcast(now))
    return joined.filter(f"due < now - 14 * {DAY} AND (evidence IS NULL OR evidence < now - 14 * {DAY})").select("task_id", "owner_id", "due", "evidence")


@query(f"""WITH {TASKS_SQL}, m AS (SELECT x.task_id AS left_id, y.task_id AS right_id, abs(x.due - y.made) AS away FROM tasks x JOIN tasks y ON x.owner_id = y.owner_id AND abs(x.due - y.made) <= 7 * {DAY} WHERE x.state = 'open' AND y.state = 'completed')
SELECT left_id, right_id, away, row_number() OVER (PARTITION BY left_id ORDER BY away, right_id) AS rank FROM m QUALIFY rank <= 2""")
def commitments_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-6, JOI-3, COM-8: open commitments with what their owner did within a week of the due date."""
    made = tasks(spark, sf_dir)
    left = made.filter("state = 'open'").select(F.col("task_id").alias("id"), "owner_id", F.col("due").alias("t"))
    right = made.filter("state = 'completed'").select(F.col("task_id").alias("id"), "owner_id", F.col("made").alias("t"))
    return band_nearest(left, right, "owner_id", 7 * DAY, 2)


_WORDS = f"list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in T.TITLE_STOPWORDS)}], w))))"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_brand AS owner, {_WORDS} AS words FROM part), u AS (SELECT id, owner, words, unnest(words) AS word FROM p),
c AS (SELECT DISTINCT x.id AS a, y.id AS b, x.words AS xw, y.words AS yw FROM u x JOIN u y ON x.owner = y.owner AND x.word = y.word AND x.id < y.id AND y.id - x.id <= 40)
SELECT a, b, round(len(list_intersect(xw, yw))::DOUBLE / len(list_distinct(list_concat(xw, yw))), 6) AS similarity FROM c WHERE len(list_intersect(xw, yw))::DOUBLE / len(list_distinct(list_concat(xw, yw))) >= 0.6""")
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COM-1 to COM-3, JOI-18: titles of one owner, close together, that share most of their words."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), T.title_words(F.col("p_name")).alias("words"))
    said = items.select("id", "owner", "words", F.explode("words").alias("word"))
    # Ids stand for time: a bucket as wide as the band and the next one.
    left = said.toDF("a", "owner", "aw", "word").withColumn("bucket", F.explode(F.expr("transform(array(0, 1), d -> a div 40 + d)")))
    right = said.toDF("b", "owner", "bw", "word").withColumn("bucket", F.expr("b div 40"))
    met = left.join(right, ["owner", "word", "bucket"]).filter("a < b AND b - a <= 40").dropDuplicates(["a", "b"])
    return met.withColumn("similarity", F.round(T.jaccard(F.col("aw"), F.col("bw")), 6)).filter("similarity >= 0.6").select("a", "b", "similarity")


MOST_INTERESTS = 10_000


@query("""WITH i AS (SELECT label AS interest, min(vec_id) AS vec_id FROM embeddings GROUP BY label), q AS (SELECT interest, embedding AS q FROM i JOIN embeddings USING (vec_id)),
s AS (SELECT vec_id, interest, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM embeddings, q)
SELECT vec_id, interest, score FROM s WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, interest) = 1""")
def interest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-19, DET-3, INT-2: vectors with the interest nearest to them, if near enough."""
    vectors = table(spark, sf_dir, "embeddings")
    # Interests are what a user follows: one vector per label here; a longer list than MOST_INTERESTS is refused, not broadcast.
    first = cut(vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")))
    if first.count() > MOST_INTERESTS:
        raise ValueError(f"more than {MOST_INTERESTS} interests")
    listed = first.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("interest"), "q"))).alias("interests"))
    scored = F.expr("transform(interests, i -> named_struct('score', round(aggregate(zip_with(embedding, i.q, (x, y) -> cast(x as double) * cast(y as double)), 0D, (a, x) -> a + x), 6), 'less', -i.interest, 'interest', i.interest))")
    best = vectors.crossJoin(F.broadcast(listed)).select("vec_id", F.array_max(scored).alias("x"))
    return best.filter("x.score >= 0.55").select("vec_id", F.col("x.interest").alias("interest"), F.col("x.score").alias("score"))


@query(f"""WITH {CHAT_SQL}, n AS (SELECT max(t) AS now FROM chat), s AS (SELECT thread_id, kind, count(*) AS evidence, max(t) AS last, round(least(1.0::DOUBLE, 0.3 + 0.05 * count(*)) - (max(now) - max(t)) / 86400000000.0::DOUBLE * 0.01, 6) AS salience FROM chat, n WHERE direction = 'inbound' GROUP BY thread_id, kind)
SELECT thread_id, kind, evidence, salience FROM s ORDER BY salience DESC, last DESC, thread_id, kind LIMIT 28""")
def brief_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most salient of what came in, by thread and kind."""
    items = chat_items(spark, sf_dir)
    now = items.agg(F.max("t").alias("now"))
    seen = items.filter("direction = 'inbound'").groupBy("thread_id", "kind").agg(F.count(F.lit(1)).alias("evidence"), F.max("t").alias("last")).crossJoin(F.broadcast(now))
    salience = F.round(F.least(F.lit(1.0), 0.3 + 0.05 * F.col("evidence")) - (F.col("now") - F.col("last")) / 86_400_000_000.0 * 0.01, 6)
    return seen.withColumn("salience", salience).orderBy(F.desc("salience"), F.desc("last"), "thread_id", "kind").limit(28).select("thread_id", "kind", "evidence", "salience")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS stream, o_orderdate::DATE AS day FROM orders), r AS (SELECT stream, day, row_number() OVER (PARTITION BY stream ORDER BY day DESC) AS nth, row_number() OVER (PARTITION BY stream, date_trunc('week', day) ORDER BY day DESC) AS in_week, dense_rank() OVER (PARTITION BY stream ORDER BY date_trunc('week', day) DESC) AS week FROM d)
SELECT stream, strftime(day, '%Y-%m-%d') AS day FROM r WHERE nth <= 7 OR (in_week = 1 AND week <= 11)""")
def retention_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8, SNK-3: which snapshots stay: the seven newest, and the newest of each of the last weeks."""
    days = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), F.to_date("o_orderdate").alias("day")).distinct()
    week = F.expr("date_sub(day, weekday(day))")
    ranked = days.withColumn("w", week).select(
        "stream",
        "day",
        F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("day"))).alias("nth"),
        F.row_number().over(Window.partitionBy("stream", "w").orderBy(F.desc("day"))).alias("in_week"),
        F.dense_rank().over(Window.partitionBy("stream").orderBy(F.desc("w"))).alias("week"),
    )
    return ranked.filter("nth <= 7 OR (in_week = 1 AND week <= 11)").select("stream", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {CHAT_SQL}, n AS (SELECT max(t) AS now FROM chat), l AS (SELECT thread_id, max(t) AS last, CASE WHEN count(*) > 60 THEN 3600000000 ELSE {DAY} END AS every FROM chat GROUP BY thread_id)
SELECT thread_id, last + every AS next_run, last + every <= now AS due FROM l, n""")
def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-4, INC-8: when each thread's schedule runs next, and whether that is due."""
    items = chat_items(spark, sf_dir)
    now = items.agg(F.max("t").alias("now"))
    last = items.groupBy("thread_id").agg(F.max("t").alias("last"), F.when(F.count(F.lit(1)) > 60, F.lit(3_600_000_000)).otherwise(F.lit(DAY)).alias("every"))
    return last.crossJoin(F.broadcast(now)).select("thread_id", (F.col("last") + F.col("every")).alias("next_run"), (F.col("last") + F.col("every") <= F.col("now")).alias("due"))
