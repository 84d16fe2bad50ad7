"""Multi-status answers of calendar and contact servers: XML with namespaces, read into rows for the file readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.formats import _calendar_files, calendar_events

_PROP = "struct<getetag:string,displayname:string,`sync-token`:string,`calendar-data`:string,`address-data`:string>"
MULTISTATUS = f"`sync-token` string, response array<struct<href:string,status:string,propstat:array<struct<status:string,prop:{_PROP}>>>>"


def multistatus(answer: Column) -> Column:
    """SRC-13: the parsed answer; prefixes of namespaces do not matter, and an answer that is no XML is null."""
    return F.from_xml(answer, MULTISTATUS, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def resources(answers: DataFrame, column: str) -> DataFrame:
    """SRC-13: the answers' other columns with (href, etag, calendar, card, gone) of every response.

    Properties that the server did not find (a status other than 200) are
    null; a response whose own status is 404 is ``gone``, as changed
    collections report what was deleted.  Answers without a response give no row.
    """
    rest = [c for c in answers.columns if c != column]
    each = answers.select(*(F.col(f"`{c}`") for c in rest), F.explode(multistatus(F.col(f"`{column}`"))["response"]).alias("r"))
    found = F.filter("r.propstat", lambda p: F.coalesce(p["status"], F.lit("")).rlike(r"\b200\b"))

    def first(name: str) -> Column:
        return F.get(F.filter(F.transform(found, lambda p: p["prop"][name]), lambda v: v.isNotNull()), F.lit(0))

    gone = F.coalesce(F.col("r.status"), F.lit("")).rlike(r"\b404\b")
    return each.select(*(F.col(f"`{c}`") for c in rest), F.trim("r.href").alias("href"), F.trim(first("getetag"), F.lit('" ')).alias("etag"), first("calendar-data").alias("calendar"), first("address-data").alias("card"), gone.alias("gone"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer, page, xml): calendar files as a server would send them, a few to an answer, with prefixes of its own choice.

    An answer comes in pages, each with a part of its files, so that no page grows with the orders.
    """
    files = _calendar_files(spark, sf_dir)
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    data = F.when(F.col("file") % 2 == 0, escaped).otherwise(F.concat(F.lit("<![CDATA["), "text", F.lit("]]>")))
    name = F.col("file").cast("string")
    found = F.concat(F.lit("<d:propstat><d:prop><d:getetag>\"e"), name, F.lit("\"</d:getetag><c:calendar-data>"), data, F.lit("</c:calendar-data></d:prop><d:status>HTTP/1.1 200 OK</d:status></d:propstat>"))
    missing = F.lit("<d:propstat><d:prop><c:address-data/></d:prop><d:status>HTTP/1.1 404 Not Found</d:status></d:propstat>")
    one = F.concat(F.lit("<d:response><d:href> /cal/"), name, F.lit(".ics </d:href>"), missing, found, F.lit("</d:response>"))
    gone = F.concat(F.lit("<d:response><d:href>/cal/old"), name, F.lit(".ics</d:href><d:status>HTTP/1.1 404 Not Found</d:status></d:response>"))
    listed = files.select((F.col("file") % 8).alias("answer"), F.col("part").alias("page"), F.concat(one, gone).alias("x"), "file").groupBy("answer", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "x"))), lambda s: s["x"]), "\n").alias("body"))
    head, tail = '<?xml version="1.0" encoding="utf-8"?>\n<d:multistatus xmlns:d="DAV:" xmlns:c="urn:ietf:params:xml:ns:caldav">', "<d:sync-token>t1</d:sync-token></d:multistatus>"
    return listed.select("answer", "page", F.concat(F.lit(head), "body", F.lit(tail)).alias("xml"))


@query("SELECT f % 8 AS answer, '/cal/' || f || '.ics' AS href, 'e' || f AS etag, false AS gone FROM (SELECT DISTINCT o_orderkey % 64 AS f FROM orders) UNION ALL SELECT f % 8, '/cal/old' || f || '.ics', NULL, true FROM (SELECT DISTINCT o_orderkey % 64 AS f FROM orders)")
def dav_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: what a server says it has, and what is gone."""
    # A file that goes on in the next page is named there again.
    return resources(_answers(spark, sf_dir), "xml").select("answer", "href", "etag", "gone").distinct()


@query("""SELECT '/cal/' || o_orderkey % 64 || '.ics' AS href, o_orderkey::VARCHAR AS uid, 'Order, ' || o_orderpriority || '; of the customer with the number ' || o_custkey AS title,
epoch_us(CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END) AS starts, o_orderkey % 4 = 0 AS all_day FROM orders""")
def dav_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13, SRC-10: events out of a server's answers, by the reader of calendar files."""
    files = resources(_answers(spark, sf_dir), "xml").filter("calendar IS NOT NULL").select("href", "calendar")
    return calendar_events(files, "calendar").select("href", "uid", "title", "starts", "all_day")
