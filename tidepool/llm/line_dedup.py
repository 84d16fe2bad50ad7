"""Line dedup: lines that many documents share are dropped from all of them.

Lines are exploded as 96-bit hashes of their normalised form, one per document
and distinct line, so what is shuffled and counted is fixed-size rows that
combine on the map side: a line that every document holds is one row per task.
The frequent hashes then find, by a hash join, the positions to drop; only
those positions travel to their documents, whose kept lines are sliced out
between them.  A hot line's positions are spread over salts, and its count is
small however often it occurs.

All of it is DataFrame expressions; texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm._sql import shielded

#: White space stripped off both ends of a line, after the ASCII definition [\x20\x09-\x0D].
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case (of ASCII lines by the faster ``lower``)."""
    return F.trim(F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER)), F.lit(_SPACE))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g"))


def dedup_lines(df: DataFrame, text: str = "text", *, least_documents: int = 10, least_length: int = 1, salts: int = 8) -> DataFrame:
    """Drop every line whose key is found in at least ``least_documents`` rows.

    Keys shorter than ``least_length`` code points are never dropped.  Each row
    is a document, repeated rows too.  Adds ``n_lines`` (before) and
    ``n_dropped``, replaces ``text`` by the lines that stay, joined by newlines;
    the other columns stay.  A null or empty text is one empty line; a text
    whose lines all go is left empty.  Columns called n_lines or n_dropped are
    replaced.
    """
    df, other, named = shielded(df)
    text = other.get(text, text)
    rest = [c for c in df.columns if c not in (text, "n_lines", "n_dropped")]
    # Rows that agree in all columns get the same result, so a hash of the row may stand for it in the join.
    everything = [F.col(f"`{c}`").cast("string") if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in [*rest, text]]
    rows = df.select(*[f"`{c}`" for c in rest], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text), F.xxhash64(*everything).alias("__r"), F.hash(*everything).alias("__q"))
    hashed = rows.select(
        "__r",
        "__q",
        F.transform(F.transform(F.split(F.col(f"`{text}`"), "\n", -1), line_key), lambda k: F.when(F.char_length(k) >= least_length, _hashes(k))).alias("__keys"),
    )
    # The outer forms of explode: Spark would evaluate the inner ones' arrays once more, in a filter it infers.
    counted = (
        hashed.select(F.explode_outer(F.array_distinct("__keys")).alias("x"))
        .filter("x IS NOT NULL")
        .groupBy(F.col("x.h").alias("h"), F.col("x.g").alias("g"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_documents)
    )
    frequent = counted.select("h", "g", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    places = hashed.select("__r", "__q", F.posexplode_outer("__keys").alias("at", "x")).filter("x IS NOT NULL")
    places = places.select("__r", "__q", "at", F.col("x.h").alias("h"), F.col("x.g").alias("g"), F.pmod("__q", F.lit(salts)).alias("s"))
    drops = places.join(frequent, ["h", "g", "s"], "left_semi").groupBy("__r", "__q").agg(F.array_sort(F.collect_set("at")).alias("__drops"))
    joined = rows.join(drops, ["__r", "__q"], "left")
    lines = joined.withColumn("__lines", F.split(F.col(f"`{text}`"), "\n", -1))
    size = F.size("__lines")
    # Between two dropped positions a and b the lines a + 1 .. b - 1 stay.
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), "__drops").alias("a"), F.concat("__drops", F.array(size)).alias("b"))
    kept = F.flatten(F.transform(edges, lambda e: F.slice("__lines", e["a"] + 2, e["b"] - e["a"] - 1)))
    out = lines.select(
        *[f"`{c}`" for c in rest],
        F.when(F.col("__drops").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n")).alias(text),
        size.cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return named(out)


def digest(deduped: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    return deduped.select(*keep, "n_lines", "n_dropped", F.sha2(F.col(text), 256).alias("kept_sha256"))


def oracle_sql(least_documents: int = 10) -> str:
    """DuckDB SQL of the digest over all documents."""
    key = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line, {key} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= {least_documents})
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r"""
