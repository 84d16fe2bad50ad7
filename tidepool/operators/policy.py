"""Sensitivity, redaction and the policy gate, as expressions over each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.registry import query
from tidepool.sources.tables import DOCUMENTS_SQL, document_items

LEVELS = ("normal", "sensitive", "restricted")
#: (id, priority, kind or any, least level or any, effect); the first that fits decides, none denies.
RULES = [("restricted_local", 10, None, 2, "local_only"), ("sensitive_redacted", 20, None, 1, "redacted"), ("fr_local", 30, "fr", None, "local_only"), ("default_allowed", 90, None, None, "allowed")]


def has_card(text: Column, low: Column) -> Column:
    """A digit run beside card words, one of whose candidates of 13 to 19 digits passes the Luhn check."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(f"({T.CARD_RUN})"), 1), lambda c: F.regexp_replace(c, "[^0-9]", ""))
    return T.hinted("card number", text, low) & text.rlike(T.java(T.CARD_WORDS)) & text.rlike(T.java(T.CARD_HINT)) & F.exists(digits, lambda d: F.char_length(d).between(13, 19) & T.luhn(d))


def classify(text: Column) -> Column:
    """A struct of level (2 restricted, 1 sensitive, 0 normal) and reasons of a text.

    Each pattern is tried once, and only on texts that hold what it must hold.
    """

    def found(low: Column) -> Column:
        hits = [(level, T.hinted(why, text, low) & text.rlike(T.java(pattern)), why) for level, pattern, why in T.SIGNALS] + [(2, has_card(text, low), "card number")]
        return F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(why).alias("why"))) for level, hit, why in hits)))

    def told(hits: Column) -> Column:
        return F.struct(F.coalesce(F.array_max(F.transform(hits, lambda h: h["level"])), F.lit(0)).alias("level"), F.array_join(F.transform(hits, lambda h: h["why"]), "; ").alias("reasons"))

    # Arrays of one element bind the lower-cased text and the hits, so that neither is made twice.
    return F.element_at(F.transform(F.transform(F.array(F.lower(text)), found), told), 1)


def redact(df: DataFrame, text: str) -> DataFrame:
    """Replace the text by its redacted form and add ``n_<kind>`` for each rule, applied in order."""
    for kind, pattern, by in T.REDACTIONS:
        hint = T.hinted(kind, F.col(text), F.lower(text))
        df = df.withColumn("__hit", F.coalesce(hint, F.lit(False)))
        counted = F.when(F.col(text).isNull(), F.lit(None)).when(F.col("__hit"), F.regexp_count(text, F.lit(T.java(pattern)))).otherwise(0)
        df = df.withColumn(f"n_{kind}", counted.cast("long")).withColumn(text, F.when(F.col("__hit"), F.regexp_replace(text, T.java(pattern), by)).otherwise(F.col(text)))
    return df.drop("__hit")


#: Rules are a list that users write; more of them than this are refused rather than sent to every task.
MOST_RULES = 10_000


def decide(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``effect`` of the first rule that fits an item's (kind, level); without one the item is denied.

    Items get the rules as one array; more than MOST_RULES of them are an error.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("priority", "rule", "kind", "least", "effect"))).alias("rules"))
    fits = F.filter("rules", lambda r: (r["kind"].isNull() | (r["kind"] == F.col("kind"))) & (r["least"].isNull() | (F.col("level") >= r["least"])))
    first = items.crossJoin(F.broadcast(listed)).withColumn("first", F.get(fits, F.lit(0)))
    return first.select(*items.columns, F.coalesce("first.rule", F.lit("none")).alias("rule"), F.coalesce("first.effect", F.lit("local_only")).alias("effect"))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, priority int, kind string, least int, effect string")


_LUHN = "(list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INT ELSE substr(d, length(d) - i, 1)::INT * 2 - CASE WHEN substr(d, length(d) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
_HITS = ", ".join(f"CASE WHEN regexp_matches(body, {T.sql(p)}) THEN {level} ELSE 0 END AS h{i}" for i, (level, p, _) in enumerate(T.SIGNALS))
_N = len(T.SIGNALS)
_CLASSIFIED = f"""{DOCUMENTS_SQL}, cards AS (SELECT item_id, bool_or(length(d) BETWEEN 13 AND 19 AND {_LUHN}) AS luhn FROM (SELECT item_id, regexp_replace(unnest(regexp_extract_all(body, '{T.CARD_RUN}')), '[^0-9]', '', 'g') AS d FROM items) GROUP BY item_id),
hits AS (SELECT item_id, kind, body, {_HITS}, CASE WHEN coalesce(luhn, false) AND regexp_matches(body, {T.sql(T.CARD_HINT)}) AND regexp_matches(body, {T.sql(T.CARD_WORDS)}) THEN 2 ELSE 0 END AS h{_N} FROM items LEFT JOIN cards USING (item_id)),
classified AS (SELECT item_id, kind, body, greatest({', '.join(f'h{i}' for i in range(_N + 1))}) AS level, concat_ws('; ', {', '.join(f"CASE WHEN h{i} > 0 THEN '{why}' END" for i, (_, _, why) in enumerate(T.SIGNALS))}, CASE WHEN h{_N} > 0 THEN 'card number' END) AS reasons FROM hits)"""
_VALUES = ", ".join(f"('{r}', {p}, {'NULL' if k is None else repr(k)}, {'NULL' if least is None else least}, '{e}')" for r, p, k, least, e in RULES)
_DECIDED = f"""{_CLASSIFIED}, rules(rule, priority, rkind, least, effect) AS (VALUES {_VALUES}),
decided AS (SELECT item_id, c.kind, body, level, coalesce(rule, 'none') AS rule, coalesce(effect, 'local_only') AS effect FROM classified c LEFT JOIN rules ON (rkind IS NULL OR rkind = c.kind) AND (least IS NULL OR level >= least) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY priority, rule) = 1)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_items(spark, sf_dir).select("item_id", "kind", "body", classify(F.col("body")).alias("c")).select("item_id", "kind", "body", "c.level", "c.reasons")


@query(f"WITH {_CLASSIFIED} SELECT item_id, level, reasons FROM classified")
def classify_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POL-1, POL-2: every document's sensitivity and why."""
    return _classified(spark, sf_dir).select("item_id", "level", "reasons")


def _redaction_sql() -> str:
    steps, source = [], "SELECT item_id, body AS t FROM items"
    names: list[str] = []
    for i, (kind, pattern, by) in enumerate(T.REDACTIONS):
        names.append(f"n_{kind}")
        kept = "".join(f", {n}" for n in names[:-1])
        to = by.replace("$1", "\\1").replace("$2", "\\2")
        steps.append(f"r{i} AS (SELECT item_id{kept}, len(regexp_extract_all(t, {T.sql(pattern)}))::BIGINT AS n_{kind}, regexp_replace(t, {T.sql(pattern)}, '{to}', 'g') AS t FROM ({source}))")
        source = f"SELECT * FROM r{i}"
    return f"WITH {DOCUMENTS_SQL}, {', '.join(steps)} SELECT item_id, {', '.join(names)}, length(t) AS characters, md5(t) AS digest FROM r{len(steps) - 1}"


@query(_redaction_sql())
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POL-3: documents redacted rule by rule."""
    redacted = redact(document_items(spark, sf_dir).select("item_id", F.col("body").alias("t")), "t")
    return redacted.select("item_id", *(f"n_{k}" for k, _, _ in T.REDACTIONS), F.char_length("t").cast("long").alias("characters"), F.md5("t").alias("digest"))


@query(f"WITH {_DECIDED} SELECT item_id, rule, effect FROM decided")
def policy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POL-4, POL-8: the rule that decides on each document."""
    return decide(_classified(spark, sf_dir), _rules(spark)).select("item_id", "rule", "effect")


@query(f"WITH {_DECIDED} SELECT effect, count(*) AS items, sum(octet_length(encode(body)))::BIGINT AS bytes, max(level) AS strictest, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM decided GROUP BY effect")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POL-5, AGG-22: what the gate lets through, redacts and withholds."""
    decided = decide(_classified(spark, sf_dir), _rules(spark))
    return decided.groupBy("effect").agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("body").cast("long")).alias("bytes"), F.max("level").alias("strictest"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
