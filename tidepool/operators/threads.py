"""Joins within threads and across time: neighbours, bands, latest of a kind, open loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.bands import nearest_in_band
from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, chat_items

HOUR, DAY = 3_600_000_000, 86_400_000_000


@query(f"""WITH {CHAT_SQL} SELECT thread_id, max(t) FILTER (direction = 'inbound') AS last_inbound, max(t) FILTER (direction = 'outbound') AS last_outbound, count(*) FILTER (direction = 'outbound') AS sent
FROM chat GROUP BY thread_id HAVING last_inbound IS NOT NULL AND (last_outbound IS NULL OR last_outbound < last_inbound)""")
def unclosed_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-1, JOI-6, JOI-8: threads whose latest inbound message has no answer; one grouping instead of an inequality join."""
    latest = chat_items(spark, sf_dir).groupBy("thread_id").agg(F.max(F.when(F.col("direction") == "inbound", F.col("t"))).alias("last_inbound"), F.max(F.when(F.col("direction") == "outbound", F.col("t"))).alias("last_outbound"), F.count_if(F.col("direction") == "outbound").alias("sent"))
    return latest.filter("last_inbound IS NOT NULL AND (last_outbound IS NULL OR last_outbound < last_inbound)")


@query(f"WITH {CHAT_SQL} SELECT thread_id, item_id, t, kind FROM chat WHERE direction = 'inbound' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY t DESC, item_id DESC) = 1")
def latest_inbound_per_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-7: the latest inbound message of each thread, combined on the map side."""
    best = chat_items(spark, sf_dir).filter("direction = 'inbound'").groupBy("thread_id").agg(F.max(F.struct("t", "item_id", "kind")).alias("x"))
    return best.select("thread_id", F.col("x.item_id").alias("item_id"), F.col("x.t").alias("t"), F.col("x.kind").alias("kind"))


def neighbours(items: DataFrame, within: int) -> DataFrame:
    """Each item with the one before and after it in its thread, if close enough."""
    order = Window.partitionBy("thread_id").orderBy("t", "item_id")
    near = items.select("item_id", "thread_id", "t", F.lag("item_id").over(order).alias("before"), F.lag("t").over(order).alias("before_t"), F.lead("item_id").over(order).alias("after"), F.lead("t").over(order).alias("after_t"))
    return near.select("item_id", "thread_id", F.when(F.col("t") - F.col("before_t") <= within, F.col("before")).alias("before"), F.when(F.col("after_t") - F.col("t") <= within, F.col("after")).alias("after"))


@query(f"""WITH {CHAT_SQL}, n AS (SELECT *, lag(item_id) OVER w AS b, lag(t) OVER w AS bt, lead(item_id) OVER w AS a, lead(t) OVER w AS at_ FROM chat WINDOW w AS (PARTITION BY thread_id ORDER BY t, item_id))
SELECT item_id, thread_id, CASE WHEN t - bt <= {6 * HOUR} THEN b END AS before, CASE WHEN at_ - t <= {6 * HOUR} THEN a END AS after FROM n""")
def asof_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-10, GRF-2: neighbours in a thread within six hours."""
    return neighbours(chat_items(spark, sf_dir), 6 * HOUR)


def band_nearest(left: DataFrame, right: DataFrame, key: str, width: int, most: int) -> DataFrame:
    """(left_id, right_id, away, rank): for every left row the ``most`` right rows of its key nearest in time; both sides have (id, key, t)."""
    found = nearest_in_band(left.withColumnRenamed(key, "key"), right.withColumnRenamed(key, "key"), width=width, most=most)
    return found.select("left_id", "right_id", "away", "rank")


@query(f"""WITH {CHAT_SQL}, m AS (SELECT l.item_id AS left_id, r.item_id AS right_id, abs(l.t - r.t) AS away FROM chat l JOIN chat r ON l.thread_id = r.thread_id AND abs(l.t - r.t) <= {2 * DAY} WHERE l.kind = 'purchase' AND r.kind = 'view')
SELECT left_id, right_id, away, row_number() OVER (PARTITION BY left_id ORDER BY away, right_id) AS rank FROM m QUALIFY rank <= 3""")
def band_topk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-9, GRF-5: the three views nearest to each purchase of a thread, within two days."""
    items = chat_items(spark, sf_dir).withColumnRenamed("item_id", "id")
    return band_nearest(items.filter("kind = 'purchase'"), items.filter("kind = 'view'"), "thread_id", 2 * DAY, 3)


@query(f"WITH {CHAT_SQL} SELECT item_id, thread_id FROM chat WHERE kind = 'error' AND thread_id IN (SELECT thread_id FROM chat WHERE kind = 'signup') AND thread_id NOT IN (SELECT thread_id FROM chat WHERE direction = 'outbound' AND t > 1706000000000000)")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-4, JOI-5: errors of threads that signed up and did not write lately."""
    items = chat_items(spark, sf_dir)
    signed = items.filter("kind = 'signup'").select("thread_id").distinct()
    late = items.filter("direction = 'outbound' AND t > 1706000000000000").select("thread_id").distinct()
    return items.filter("kind = 'error'").join(signed, "thread_id", "left_semi").join(late, "thread_id", "left_anti").select("item_id", "thread_id")


@query(f"""WITH {CHAT_SQL}, c AS (SELECT item_id, thread_id, t, (t - lag(t) OVER (PARTITION BY thread_id ORDER BY t, item_id)) AS gap FROM chat WHERE kind = 'purchase'),
m AS (SELECT thread_id, median(gap) AS mid, count(gap) AS n FROM c WHERE gap IS NOT NULL GROUP BY thread_id),
d AS (SELECT thread_id, median(abs(gap - mid)) AS mad FROM c JOIN m USING (thread_id) WHERE gap IS NOT NULL GROUP BY thread_id)
SELECT thread_id, round(mid / {HOUR}, 6) AS median_hours, round(mad / {HOUR}, 6) AS mad_hours, n AS gaps FROM m JOIN d USING (thread_id)""")
def gap_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, WIN-5: median and median absolute deviation of the gaps between a thread's purchases."""
    order = Window.partitionBy("thread_id").orderBy("t", "item_id")
    gaps = chat_items(spark, sf_dir).filter("kind = 'purchase'").select("thread_id", (F.col("t") - F.lag("t").over(order)).alias("gap")).filter("gap IS NOT NULL")
    middle = gaps.groupBy("thread_id").agg(F.median("gap").alias("mid"), F.count("gap").alias("gaps"))
    spread = gaps.join(middle, "thread_id").groupBy("thread_id").agg(F.median(F.abs(F.col("gap") - F.col("mid"))).alias("mad"))
    return middle.join(spread, "thread_id").select("thread_id", F.round(F.col("mid") / HOUR, 6).alias("median_hours"), F.round(F.col("mad") / HOUR, 6).alias("mad_hours"), "gaps")
