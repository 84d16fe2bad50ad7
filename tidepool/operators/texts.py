"""Operators on texts: terms and their rarity, shapes, references, pages, chunks, contacts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import DOCUMENTS_SQL, TURNS_SQL, document_items, table, turns


def _list(words: Iterable[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TERMS = f"""{DOCUMENTS_SQL}, w AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(substr(body, 1, 1500)), {T.sql(T.LINKS)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: length(x) >= 4 AND regexp_matches(x, '\\p{{L}}') AND NOT list_contains({_list(T.STOPWORDS)}, x)) AS w FROM items),
u AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM w), f AS (SELECT item_id, term, min(place) AS place FROM u GROUP BY ALL),
terms AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY place) AS nth FROM f QUALIFY nth <= 24)"""


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, nth, term) of every item's content terms."""
    return items.select("item_id", F.posexplode(T.content_terms(F.col("body"))).alias("nth", "term")).select("item_id", (F.col("nth") + 1).cast("long").alias("nth"), "term")


@query(f"WITH {_TERMS} SELECT item_id, nth, term FROM terms")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRM-1: each document's content terms."""
    return item_terms(document_items(spark, sf_dir))


@query(f"WITH {_TERMS} SELECT term, count(*) AS df FROM terms GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRM-2: in how many documents each term is found."""
    return item_terms(document_items(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def distinctive(terms: DataFrame, items: DataFrame) -> DataFrame:
    """(term, df, weight) of terms that are rare enough for the store's size."""
    # One row: the size of the store and the ceiling that follows from it.
    size = items.agg(F.count(F.lit(1)).alias("n")).select("n", F.least(F.lit(120), F.greatest(F.lit(5), F.round(F.col("n") * 0.005))).alias("ceiling"))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.crossJoin(F.broadcast(size)).filter("df <= ceiling").select("term", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("weight"))


_RARE = f"""{_TERMS}, n AS (SELECT count(*) AS n, least(120, greatest(5, round(count(*) * 0.005))) AS ceiling FROM items),
rare AS (SELECT term, count(*) AS df, round(ln(min(n)::DOUBLE / count(*)), 6) AS weight FROM terms, n GROUP BY term HAVING count(*) <= min(ceiling))"""


@query(f"WITH {_RARE} SELECT term, df, weight FROM rare")
def term_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRM-3, TRM-4: distinctive terms and their weights."""
    items = document_items(spark, sf_dir)
    return distinctive(item_terms(items), items)


#: Fixed value: how many holders of a word an item is paired with, the nearest ones.
MOST_PER_TERM = 12


@query(f"""WITH {_RARE}, h AS (SELECT item_id, term, weight FROM terms JOIN rare USING (term)),
p AS (SELECT x.item_id AS a, y.item_id AS b, x.weight FROM h x JOIN h y ON x.term = y.term AND x.item_id < y.item_id QUALIFY row_number() OVER (PARTITION BY x.item_id, x.term ORDER BY y.item_id) <= {MOST_PER_TERM})
SELECT a, b, count(*) AS words, round(least(0.8, 0.4 + sum(weight) / 30), 2) AS confidence FROM p GROUP BY a, b HAVING count(*) >= 2""")
def content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-11, LNK-5: documents linked by two or more distinctive words; per word each meets the twelve nearest after it.

    A distinctive word has few holders by definition, so a word's group is small.
    """
    items = document_items(spark, sf_dir)
    # Terms are read off the texts once, for their frequencies and for the pairs.
    terms = cut(item_terms(items))
    held = terms.join(distinctive(terms, items), "term").select("item_id", "term", "weight")
    near = Window.partitionBy("term").orderBy("item_id").rowsBetween(1, MOST_PER_TERM)
    after = held.withColumn("others", F.collect_list("item_id").over(near))
    pairs = after.select(F.col("item_id").alias("a"), "weight", F.explode("others").alias("b"))
    linked = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("words"), F.sum("weight").alias("w"))
    return linked.filter("words >= 2").select("a", "b", "words", F.round(F.least(F.lit(0.8), 0.4 + F.col("w") / 30), 2).alias("confidence"))


#: The common tables of the recurring topics: ``topics`` has term, conversations, first_conv and last_conv.
TOPICS_SQL = f"""{TURNS_SQL}, w AS (SELECT conv_id, unnest(list_distinct(list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY turn)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 4 AND length(x) < 20 AND NOT list_contains({_list(T.TOPIC_STOPWORDS)}, x)))) AS term FROM turns GROUP BY conv_id),
c AS (SELECT count(DISTINCT conv_id) AS n FROM turns),
topics AS (SELECT term, count(*) AS conversations, min(conv_id) AS first_conv, max(conv_id) AS last_conv FROM w, c GROUP BY term, n HAVING count(*) >= 3 AND (n < 50 OR count(*) <= 0.08 * n) ORDER BY conversations DESC, term LIMIT 12)"""


def topics(said: DataFrame) -> DataFrame:
    """TOP-10: (term, conversations, first_conv, last_conv) of terms that come back in several conversations, but not in all."""
    stop = F.array(*(F.lit(w) for w in T.TOPIC_STOPWORDS))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (F.char_length(w) > 4) & (F.char_length(w) < 20) & ~F.array_contains(stop, w))
    told = said.select("conv_id", F.explode(F.array_distinct(words)).alias("term")).distinct()
    corpus = said.agg(F.countDistinct("conv_id").alias("n"))
    counted = told.groupBy("term").agg(F.count(F.lit(1)).alias("conversations"), F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"))
    kept = counted.filter("conversations >= 3").crossJoin(F.broadcast(corpus)).filter("n < 50 OR conversations <= 0.08 * n")
    return kept.orderBy(F.desc("conversations"), "term").limit(12).drop("n")


@query(f"WITH {TOPICS_SQL} SELECT term, conversations, first_conv, last_conv FROM topics")
def topics_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-10, AGG-21, TRM-5: terms that come back in several conversations, but not in all."""
    return topics(turns(spark, sf_dir))


_SHAPE = "trim(regexp_replace(regexp_replace(lower(title), '[$£€]?[0-9][0-9,.:/-]*', '#', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query(f"WITH {DOCUMENTS_SQL}, s AS (SELECT item_id, account_id, {_SHAPE} AS shape FROM items) SELECT account_id, shape, count(*) AS items FROM s WHERE length(shape) >= 3 GROUP BY account_id, shape HAVING count(*) >= 3")
def title_shape_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOI-1, NOI-2: shapes of titles that an account repeats."""
    shaped = document_items(spark, sf_dir).select("account_id", T.title_shape(F.col("title")).alias("shape")).filter(F.char_length("shape") >= 3)
    return shaped.groupBy("account_id", "shape").agg(F.count(F.lit(1)).alias("items")).filter("items >= 3")


@query(f"WITH {DOCUMENTS_SQL}, s AS (SELECT item_id, account_id, lower(trim(title)) AS title FROM items) SELECT item_id, account_id, title FROM s QUALIFY row_number() OVER (PARTITION BY account_id, title ORDER BY item_id) > 1")
def repeat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOI-4, WIN-4: all but the first item of each title of an account."""
    titled = document_items(spark, sf_dir).select("item_id", "account_id", F.lower(F.trim("title")).alias("title"))
    nth = F.row_number().over(Window.partitionBy("account_id", "title").orderBy("item_id"))
    return titled.withColumn("nth", nth).filter("nth > 1").drop("nth")


def references(items: DataFrame, scan: int = 4000) -> DataFrame:
    """(item_id, kind, value): the distinct codes of each item."""
    found = [
        items.select("item_id", F.lit(kind).alias("kind"), F.explode(F.expr(f"regexp_extract_all(substr(body, 1, {scan}), {_literal(T.java(pattern))}, 1)")).alias("value"))
        for kind, pattern in T.REFERENCES
    ]
    union = found[0].unionByName(found[1]).unionByName(found[2])
    tidy = union.withColumn("value", F.upper(F.regexp_replace("value", r"[ \t\n\r\f]+", "")))
    return tidy.filter((F.char_length("value") >= 5) & F.col("value").rlike("[0-9]") & ~F.col("value").rlike(T.NO_REFERENCE)).distinct()


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_REFERENCES = f"{DOCUMENTS_SQL}, r AS (" + " UNION ALL ".join(f"SELECT item_id, '{kind}' AS kind, unnest(regexp_extract_all(substr(body, 1, 4000), {T.sql(pattern)}, 1)) AS value FROM items" for kind, pattern in T.REFERENCES) + f"""),
refs AS (SELECT DISTINCT item_id, kind, upper(regexp_replace(value, '[ \\t\\n\\r\\f]+', '', 'g')) AS value FROM r WHERE length(regexp_replace(value, '[ \\t\\n\\r\\f]+', '', 'g')) >= 5 AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(upper(value), {T.sql(T.NO_REFERENCE)}))"""


@query(f"WITH {_REFERENCES} SELECT item_id, kind, value FROM refs")
def reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF-1: reference codes in documents."""
    return references(document_items(spark, sf_dir))


@query("SELECT page_id, length(t) AS characters, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<style[\\s\\S]*?</style>', ' ', 'g'), '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t FROM pages)")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: pages as text."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("t")).select("page_id", F.char_length("t").cast("long").alias("characters"), F.md5("t").alias("digest"))


@query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: pages per host."""
    return table(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


@query("SELECT doc_id AS item_id, place AS ordinal, substr(text, place * 2000 + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 1999) // 2000))) AS place FROM documents)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-4: texts cut every 2,000 characters."""
    last = F.greatest(F.lit(0), F.expr("(char_length(text) + 1999) div 2000 - 1"))
    places = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("ordinal"))
    return places.select("item_id", "ordinal", F.expr("substr(text, cast(ordinal * 2000 + 1 as int), 2000)").alias("chunk"))


def strip_boilerplate(text: Column) -> Column:
    """A mail's text without its tail and quoted lines."""
    out = text
    for pattern in T.BOILERPLATE:
        out = F.regexp_replace(out, T.java(pattern), "")
    # Reply headers and quoted lines.
    for pattern in (r"(?im)^\s*on .{0,80}wrote:[\s\S]*\z", r"(?im)^\s*-{2,}\s*original message\s*-{2,}[\s\S]*\z", r"(?m)^\s*>+.*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def cut_window(text: str, target: int = 1200, overlap: int = 150, least: int = 40, most: int = 4) -> list[str]:
    """Overlapping windows that end at a paragraph, a sentence or a word where one is past the middle."""
    if len(text) <= target:
        return [text]
    out: list[str] = []
    at = 0
    while at < len(text) and len(out) < most:
        end = min(at + target, len(text))
        if end < len(text):
            for mark in ("\n\n", ". ", " "):
                found = text.rfind(mark, 0, end + len(mark))
                if found > at + target / 2:
                    end = found + len(mark)
                    break
        piece = text[at:end].strip()
        if len(piece) >= least or not out:
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def _chunk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["chunk"] = [cut_window(t or "") for t in batch["text"]]
        out = batch.drop(columns="text").explode("chunk")
        out["ordinal"] = out.groupby(level=0).cumcount()
        yield out[["item_id", "ordinal", "chunk"]]


@query()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1, CHK-2: overlapping windows; each depends on where the one before ended."""
    bounded = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.substring(strip_boilerplate(F.col("text")), 1, 8000).alias("text"))
    return bounded.mapInPandas(_chunk_batches, "item_id long, ordinal long, chunk string")


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


@query(f"""WITH a AS (SELECT doc_id, lower(trim(unnest(regexp_extract_all(text, '{_MAIL}')))) AS m FROM documents),
s AS (SELECT doc_id, regexp_replace(m, '@[^@]*$', '') AS local, regexp_extract(m, '@([^@]*)$', 1) AS domain FROM a), p AS (SELECT doc_id, CASE WHEN strpos(local, '+') > 1 THEN substr(local, 1, strpos(local, '+') - 1) ELSE local END AS local, domain FROM s)
SELECT CASE WHEN domain IN ('gmail.com', 'googlemail.com') THEN replace(local, '.', '') || '@gmail.com' ELSE local || '@' || domain END AS email, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM p GROUP BY 1""")
def email_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-1: addresses found in documents, in the form they are grouped by."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, {_literal(_MAIL)}, 0)")).alias("m"))
    return found.groupBy(T.email(F.col("m")).alias("email")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))


@query(f"""WITH p AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_PHONE.replace("+", "+")}')), '[^0-9]', '', 'g') AS d FROM documents)
SELECT CASE WHEN length(d) BETWEEN 8 AND 15 THEN '+' || d END AS phone, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM p GROUP BY 1""")
def phone_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-6: phone numbers found in documents, with their country."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, {_literal(_PHONE)}, 0)")).alias("p"))
    return found.groupBy(T.phone(F.col("p")).alias("phone")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, regexp_matches(text, {T.sql(T.INTENT)}) AS intent, regexp_matches(text, {T.sql(T.FACT)}) AND NOT regexp_matches(text, {T.sql(T.NEVER_STORE)}) AS fact FROM turns WHERE speaker = 'Me'")
def intents_and_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COM-7, FAC-1: turns that state an intent or a lasting fact."""
    said = turns(spark, sf_dir).filter("speaker = 'Me'")
    return said.select("conv_id", "turn", F.col("text").rlike(T.java(T.INTENT)).alias("intent"), (F.col("text").rlike(T.java(T.FACT)) & ~F.col("text").rlike(T.java(T.NEVER_STORE))).alias("fact"))
