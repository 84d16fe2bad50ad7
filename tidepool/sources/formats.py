"""Calendar, task and contact files as tables, and the encodings found in mail.

Files are unfolded, split into components and properties with built-in
functions; a component becomes a map of its properties, so a file of any number
of entries is exploded, never parsed in one go.  Python takes part only where a
charset has to be decoded.
"""

from __future__ import annotations

import base64
import quopri
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidepool.registry import query
from tidepool.sources.tables import table

#: Parts of an attachment that are kept at most (the reference's own features).
MOST_ATTACHED = 40_000


def unfolded(text: Column) -> Column:
    """SRC-10: lines that go on after a line break and a blank, joined."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]", "")


def unescaped(value: Column) -> Column:
    """SRC-24: a property's text with its escapes undone."""
    out = F.regexp_replace(value, r"\\[nN]", "\n")
    return F.regexp_replace(out, r"\\([,;\\])", "$1")


def entries(files: DataFrame, text: str, component: str) -> DataFrame:
    """A row per component of a file: the file's other columns, ``lines`` (its unfolded lines)."""
    body = unfolded(F.col(text))
    found = F.regexp_extract_all(body, F.lit(rf"(?s)BEGIN:{component}\n(.*?)END:{component}"), 1)
    rest = [c for c in files.columns if c != text]
    exploded = files.select(*rest, F.explode(found).alias("entry"))
    # Nested components (alarms) have properties of their own, which are not the entry's.
    own = F.regexp_replace("entry", r"(?s)BEGIN:([A-Z]+)\n.*?END:\1\n", "")
    return exploded.select(*rest, F.filter(F.split(own, "\n"), lambda x: x != "").alias("lines"))


def prop(lines: str, name: str) -> Column:
    """A property's value: the first line of this name, with or without a group and parameters."""
    line = F.get(F.filter(lines, lambda x: x.rlike(rf"^(?:[A-Za-z0-9-]+\.)?{name}[;:]")), F.lit(0))
    # The value starts behind the first colon that is in no quoted parameter.
    return F.regexp_replace(line, r'^(?:[^":]|"[^"]*")*:', "")


def params(lines: str, name: str) -> Column:
    return F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(rf"^(?:[A-Za-z0-9-]+\.)?{name}[;:]")), F.lit(0)), r'^[^;:]*((?:;(?:[^":;]|"[^"]*")*)*):', 1)


def calendar_time(value: Column, parameters: Column) -> Column:
    """SRC-10: a date, a UTC time or a floating time (taken as UTC) as microseconds."""
    dated = F.contains(parameters, F.lit("VALUE=DATE")) | (F.char_length(value) == 8)
    digits = F.regexp_replace(value, "[^0-9]", "")
    wall = F.when(dated, F.concat(F.substring(digits, 1, 8), F.lit("000000"))).otherwise(F.substring(digits, 1, 14))
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.try_to_timestamp(wall, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def calendar_events(files: DataFrame, text: str) -> DataFrame:
    """SRC-10: (uid, title, place, starts, ends, all_day, rule, attendees) of every event."""
    found = entries(files, text, "VEVENT")
    attendees = F.transform(F.filter("lines", lambda x: x.rlike("^ATTENDEE[;:]")), lambda x: F.lower(F.regexp_replace(x, r"(?i)^.*mailto:", "")))
    starts, ends = (calendar_time(prop("lines", n), params("lines", n)) for n in ("DTSTART", "DTEND"))
    rest = [c for c in files.columns if c != text]
    return found.select(*rest, prop("lines", "UID").alias("uid"), unescaped(prop("lines", "SUMMARY")).alias("title"), unescaped(prop("lines", "LOCATION")).alias("place"), starts.alias("starts"), ends.alias("ends"), F.contains(params("lines", "DTSTART"), F.lit("VALUE=DATE")).alias("all_day"), prop("lines", "RRULE").alias("rule"), attendees.alias("attendees"))


def calendar_tasks(files: DataFrame, text: str) -> DataFrame:
    """SRC-11: (uid, title, due, done, rule) of every task; done by status, by a completion time or at 100 percent."""
    found = entries(files, text, "VTODO")
    done = (F.upper(prop("lines", "STATUS")) == "COMPLETED") | prop("lines", "COMPLETED").isNotNull() | (F.coalesce(prop("lines", "PERCENT-COMPLETE").cast("int"), F.lit(0)) >= 100)
    rest = [c for c in files.columns if c != text]
    return found.select(*rest, prop("lines", "UID").alias("uid"), unescaped(prop("lines", "SUMMARY")).alias("title"), calendar_time(prop("lines", "DUE"), params("lines", "DUE")).alias("due"), F.coalesce(done, F.lit(False)).alias("done"), prop("lines", "RRULE").alias("rule"))


def contact_cards(files: DataFrame, text: str) -> DataFrame:
    """SRC-12: (uid, name, emails, phones, org) of every card; without FN the name is put together from N."""
    found = entries(files, text, "VCARD")

    def every(name: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x.rlike(rf"^(?:[A-Za-z0-9-]+\.)?{name}[;:]")), lambda x: F.regexp_replace(x, r'^(?:[^":]|"[^"]*")*:', ""))

    parts = F.split(prop("lines", "N"), ";")
    pieced = F.trim(F.concat_ws(" ", F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.nullif(F.get(parts, F.lit(0)), F.lit(""))))
    rest = [c for c in files.columns if c != text]
    return found.select(*rest, prop("lines", "UID").alias("uid"), F.coalesce(F.nullif(unescaped(prop("lines", "FN")), F.lit("")), pieced).alias("name"), F.transform(every("EMAIL"), F.lower).alias("emails"), F.transform(every("TEL"), lambda x: F.regexp_replace(x, "[^0-9+]", "")).alias("phones"), unescaped(prop("lines", "ORG")).alias("org"))


@F.pandas_udf(StringType())
def decoded_words(values: pd.Series) -> pd.Series:
    """SRC-16: mail headers with their encoded words (=?charset?B or Q?...?=) decoded; what cannot be read stays."""
    import re

    word = re.compile(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=")

    def plain(match: re.Match) -> str:
        charset, kind, data = match.groups()
        try:
            raw = base64.b64decode(data) if kind in "Bb" else quopri.decodestring(data.replace("_", " "))
            return raw.decode(charset)
        except (LookupError, ValueError):
            return match[0]

    # Blanks between two encoded words are not text.
    return values.map(lambda v: None if v is None else word.sub(plain, re.sub(r"(\?=)\s+(=\?)", r"\1\2", v)))


def _binary_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of readable text in binary values: the longest run of letters that is no class name."""
    import re

    run = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]{2,}")
    for batch in batches:
        texts = []
        for blob in batch["blob"]:
            found = [r.strip("+ ") for r in run.findall(bytes(blob or b"").decode("utf-8", "replace"))]
            good = [f for f in found if not re.match(r"^(NS[A-Z]|streamtyped|__k)", f) and re.search(r"\w", f)]
            texts.append(max(good, key=len, default=None))
        yield pd.DataFrame({"id": batch["id"], "text": texts})


def attributed_text(blobs: DataFrame) -> DataFrame:
    """SRC-4: (id, blob) in, (id, text) out: the text inside archived rich text."""
    return blobs.mapInPandas(_binary_texts, "id long, text string")


def attached_text(mime: Column, content: Column) -> Column:
    """SRC-15: the text of an attachment by its type, bounded; null for types that hold none."""
    from tidepool.text import strip_html

    text = F.try_validate_utf8(content)
    return F.substring(F.when(mime == "text/html", strip_html(text)).when(mime.rlike("^(?:text/|application/json)"), text), 1, MOST_ATTACHED)


# --- files made of the given tables, read back -----------------------------------------


def _stamp(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")


def _calendar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, part, text): orders as calendar files, an event and a task per order, long lines folded; a part holds the orders of a range of keys."""
    key = F.col("o_orderkey")
    title = F.concat(F.lit("Order\\, "), F.col("o_orderpriority"), F.lit("\\; of the customer with the number "), F.col("o_custkey").cast("string"))
    folded = F.regexp_replace(F.concat(F.lit("SUMMARY:"), title), "(.{40})", "$1\r\n ")
    starts = F.when(key % 4 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(F.concat(F.lit('DTSTART;X-NOTE="a:b":'), _stamp(F.col("o_orderdate"))))
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), key.cast("string")), folded, starts, F.lit("BEGIN:VALARM\r\nSUMMARY:alarm\r\nEND:VALARM"), F.concat(F.lit("ATTENDEE;CN=\"X\":mailto:C"), F.col("o_custkey").cast("string"), F.lit("@Example.org")), F.lit("END:VEVENT"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("STATUS:COMPLETED")).when(F.col("o_orderstatus") == "P", F.lit("PERCENT-COMPLETE:50")).otherwise(F.lit("PERCENT-COMPLETE:100"))
    todo = F.concat_ws("\r\n", F.lit("BEGIN:VTODO"), F.concat(F.lit("UID:t"), key.cast("string")), F.concat(F.lit("DUE:"), _stamp(F.col("o_orderdate"))), status, F.lit("END:VTODO"))
    made = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 64).alias("file"), F.concat_ws("\r\n", event, todo).alias("entry"), key)
    # A file is as long as its part of the orders; it is exploded again when it is read.
    joined = made.groupBy("file", F.expr("o_orderkey div 4096").alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "entry"))), lambda x: x["entry"]), "\r\n").alias("body"))
    return joined.select("file", "part", F.concat(F.lit("BEGIN:VCALENDAR\r\n"), "body", F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))


@query("""SELECT o_orderkey % 64 AS file, o_orderkey::VARCHAR AS uid, 'Order, ' || o_orderpriority || '; of the customer with the number ' || o_custkey AS title,
epoch_us(CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END) AS starts, o_orderkey % 4 = 0 AS all_day, 'c' || o_custkey || '@example.org' AS attendee FROM orders""")
def calendar_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-24: orders written as calendar files and read again."""
    found = calendar_events(_calendar_files(spark, sf_dir), "text")
    return found.select("file", "uid", "title", "starts", "all_day", F.get("attendees", F.lit(0)).alias("attendee"))


@query("SELECT 't' || o_orderkey AS uid, epoch_us(date_trunc('second', o_orderdate)) AS due, o_orderstatus <> 'P' AS done FROM orders")
def tasks_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: orders written as tasks and read again."""
    return calendar_tasks(_calendar_files(spark, sf_dir), "text").select("uid", "due", "done")


@query("""SELECT c_custkey::VARCHAR AS uid, CASE WHEN c_custkey % 3 = 0 THEN 'Given ' || c_mktsegment ELSE c_name || ', Ltd' END AS name, 'c' || c_custkey || '@x.org' AS email, '+1555' || lpad(c_custkey::VARCHAR, 7, '0') AS phone FROM customer""")
def cards_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: customers written as contact cards and read again."""
    key = F.col("c_custkey").cast("string")
    named = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("N:"), F.col("c_mktsegment"), F.lit(";Given;;;"))).otherwise(F.concat(F.lit("FN:"), F.col("c_name"), F.lit("\\, Ltd")))
    card = F.concat_ws("\n", F.lit("BEGIN:VCARD"), F.concat(F.lit("UID:"), key), named, F.concat(F.lit("item1.EMAIL;TYPE=home:C"), key, F.lit("@X.org")), F.concat(F.lit("TEL;TYPE=\"cell:x\":+1 (555) "), F.lpad(key, 7, "0")), F.lit("END:VCARD\n"))
    files = table(spark, sf_dir, "customer").select(card.alias("text"))
    return contact_cards(files, "text").select("uid", "name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"))


@query("SELECT doc_id, substr(text, 1, 40) AS subject FROM documents WHERE text IS NOT NULL")
def encoded_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: the starts of documents encoded as mail subjects and decoded."""
    start = F.substring("text", 1, 40)
    encoded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(start, "UTF-8")), F.lit("?="))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", decoded_words(F.regexp_replace(encoded, "[\r\n]", "")).alias("subject"))


@query("SELECT event_id, CASE WHEN value * 1000 > 1e11 THEN (value * 1000 / 1e6)::BIGINT ELSE trunc(value * 1000 * 1000)::BIGINT END + 978307200000 AS ms FROM events")
def apple_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: seconds since 2001 as milliseconds since 1970."""
    from tidepool.operators.times import apple_time

    return table(spark, sf_dir, "events").select("event_id", apple_time(F.col("value") * 1000).alias("ms"))


@query("SELECT page_id, length(substr(html, 1, 40000)) AS characters FROM pages")
def attachments_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: pages as attached plain text, bounded."""
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(attached_text(F.lit("text/plain"), F.encode("html", "UTF-8"))).cast("long").alias("characters"))
