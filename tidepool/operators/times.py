"""Local times and the labels that evidence is told with, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.tables import micros, table

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: Times before 1990 or more than a year ahead are no times.
EARLIEST = 631_152_000_000_000


def instant(t: Column) -> Column:
    return F.timestamp_micros(t)


def local(t: Column, zone: str) -> Column:
    """The wall clock of a zone at an instant, as a zone-less timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), t / SECOND))


def utc_offset(t: Column, zone: str) -> Column:
    """TIM-2: a zone's offset at an instant, as +HH:MM."""
    minutes = F.expr("1") * F.round((_micros(local(t, zone)) - t) / MINUTE).cast("int")
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def _micros(wall: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), wall)


def local_iso(t: Column, zone: str) -> Column:
    """TIM-2: an instant as ISO 8601 with its zone's offset."""
    return F.concat(F.date_format(local(t, zone), "yyyy-MM-dd'T'HH:mm:ss"), utc_offset(t, zone))


def at_local(date: Column, hour: int, minute: int, zone: str) -> Column:
    """TIM-3: the instant of a wall-clock time on a date."""
    wall = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.to_timestamp_ntz(F.concat(date, F.lit(f" {hour:02d}:{minute:02d}:00"))))
    return _micros(wall)


def plausible(t: Column, fallback: Column, now: Column, *, future: bool = True) -> Column:
    """FIL-8: a time, or the fallback where it cannot be one."""
    latest = now + 365 * DAY if future else now
    return F.when(t.isNotNull() & (t >= EARLIEST) & (t <= latest), t).otherwise(fallback)


def apple_time(value: Column) -> Column:
    """SRC-5: seconds or nanoseconds since 2001 as milliseconds since 1970."""
    return F.when(value > 1e11, value / 1e6).otherwise(value * 1000).cast("long") + 978_307_200_000


def format_bytes(n: Column) -> Column:
    """TIM-6: a size with its unit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = n / 1024.0**power
        shown = F.when(value >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
        out = F.when(n >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(ms: Column) -> Column:
    """TIM-6: seconds, minutes or hours."""
    seconds = F.round(ms / 1000).cast("long")
    minutes = F.floor(seconds / 60)
    text = lambda c: c.cast("string")
    return F.when(seconds < 60, F.concat(text(seconds), F.lit("s"))).when(minutes < 60, F.concat(text(minutes), F.lit("m "), text(seconds % 60), F.lit("s"))).otherwise(F.concat(text(F.floor(minutes / 60)), F.lit("h "), text(minutes % 60), F.lit("m")))


def human_when(t: Column, now: Column, zone: str) -> Column:
    """TIM-5: "Mon, Aug 3, 2:05 PM", with the year only where it is another."""
    wall = local(t, zone)
    same = F.year(wall) == F.year(local(now, zone))
    return F.when(same, F.date_format(wall, "EEE, MMM d, h:mm a")).otherwise(F.date_format(wall, "EEE, MMM d, yyyy, h:mm a"))


def useful_from(t: Column, zone: str) -> Column:
    """BRF-3: the next working hour: Monday to Thursday 7 to 18, Friday 7 to 15, else the next weekday at 7; as a wall clock in the zone."""
    wall = local(t, zone)
    day = F.dayofweek(wall)  # Sunday is 1
    hour = F.hour(wall)
    closes = F.when(day == 6, 15).otherwise(18)
    midnight = F.date_trunc("day", wall).cast("timestamp_ntz")
    working = day.between(2, 6)
    ahead = F.when(working & (hour < 7), 0).when(day == 6, 3).when(day == 7, 2).otherwise(1)
    start = midnight + F.make_dt_interval(ahead.cast("int"), F.lit(7), F.lit(0), F.lit(0))
    return F.when(working & (hour >= 7) & (hour < closes), wall).otherwise(start)


_ZONE = "America/New_York"
_WALL = f"((ts AT TIME ZONE 'UTC') AT TIME ZONE '{_ZONE}')"


@query(f"""SELECT event_id, strftime({_WALL}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN d < 0 THEN '-' ELSE '+' END || lpad((abs(d) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(d) % 60)::VARCHAR, 2, '0') AS iso,
strftime({_WALL}, '%Y-%m-%d') AS day, hour({_WALL})::INTEGER AS hour, dayofweek({_WALL})::INTEGER AS weekday, strftime({_WALL}, '%a, %b %-d, ') || CASE WHEN year({_WALL}) = 2024 THEN '' ELSE year({_WALL}) || ', ' END || strftime({_WALL}, '%-I:%M %p') AS shown
FROM (SELECT *, date_diff('minute', ts, {_WALL}) AS d FROM events)""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-1, TIM-2, TIM-4, TIM-5: events in a zone's own time."""
    rows = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("t"))
    t, now = F.col("t"), F.lit(1_706_000_000_000_000)
    return rows.select("event_id", local_iso(t, _ZONE).alias("iso"), F.date_format(local(t, _ZONE), "yyyy-MM-dd").alias("day"), F.hour(local(t, _ZONE)).alias("hour"), (F.dayofweek(local(t, _ZONE)) - 1).alias("weekday"), human_when(t, now, _ZONE).alias("shown"))


@query(f"""WITH w AS (SELECT event_id, {_WALL} AS wall FROM events), d AS (SELECT *, dayofweek(wall) AS day, hour(wall) AS h FROM w)
SELECT event_id, epoch_us(CASE WHEN day BETWEEN 1 AND 5 AND h >= 7 AND h < CASE WHEN day = 5 THEN 15 ELSE 18 END THEN wall
ELSE date_trunc('day', wall) + INTERVAL 7 HOUR + CASE WHEN day BETWEEN 1 AND 5 AND h < 7 THEN INTERVAL 0 DAY WHEN day = 5 THEN INTERVAL 3 DAY WHEN day = 6 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END END) AS useful FROM d""")
def working_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-3: when an event is best told."""
    rows = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("t"))
    return rows.select("event_id", _micros(useful_from(F.col("t"), _ZONE)).alias("useful"))


@query("""SELECT o_orderkey, epoch_us((strptime(strftime(o_orderdate, '%Y-%m-%d') || ' 09:30:00', '%Y-%m-%d %H:%M:%S') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS opens,
CASE WHEN epoch_us(o_orderdate) >= 631152000000000 AND epoch_us(o_orderdate) <= 883612800000000 + 31536000000000 THEN epoch_us(o_orderdate) ELSE 0 END AS told FROM orders""")
def wall_clock_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-3, FIL-8: half past nine on each order's day as an instant, and order times that can be ones."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), micros("o_orderdate").alias("t"))
    return rows.select("o_orderkey", at_local(F.col("day"), 9, 30, _ZONE).alias("opens"), plausible(F.col("t"), F.lit(0).cast("long"), F.lit(883_612_800_000_000)).alias("told"))


@query("""SELECT doc_id, CASE WHEN b >= 1048576 THEN CASE WHEN b / 1048576.0 >= 100 THEN printf('%.0f', round(b / 1048576.0::DOUBLE)) ELSE printf('%.1f', round(b / 1048576.0::DOUBLE, 1)) END || ' MB' WHEN b >= 1024 THEN CASE WHEN b / 1024.0 >= 100 THEN printf('%.0f', round(b / 1024.0::DOUBLE)) ELSE printf('%.1f', round(b / 1024.0::DOUBLE, 1)) END || ' KB' ELSE b || ' B' END AS size,
CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s // 60) % 60) || 'm' END AS lasts FROM (SELECT doc_id, n_chars * 37 AS b, round(n_chars * 997 / 1000)::BIGINT AS s FROM documents)""")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-6: sizes and durations as labels."""
    return table(spark, sf_dir, "documents").select("doc_id", format_bytes(F.col("n_chars") * 37).alias("size"), format_duration(F.col("n_chars") * 997).alias("lasts"))
