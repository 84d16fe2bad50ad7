"""Facts: one id for one statement, however it is worded, and decisions that stand.

A statement read again next month must not bring back what was rejected, nor
take back what was confirmed, so what is known is never proposed again; only
its confidence may rise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.state import quote_found
from tidepool.registry import query
from tidepool.sources.tables import table

# Words that make no difference to a fact, and the confidence of a proposal at most.
STOPWORDS = "the a an to for and or of in on at with is are was were be been my our his her their i we you it this that does do not no".split()
MOST_CONFIDENCE = 0.8


def normal_fact(statement: Column) -> Column:
    """FAC-2: a statement's distinct words of two letters or more, without small ones, in order."""
    words = F.split(F.lower(statement), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: (F.char_length(w) > 1) & ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), w))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def fact_id(principal: Column, normalized: Column) -> Column:
    """FAC-2, KEY-1: a fact's id."""
    return F.concat(F.lit("ft_"), F.substring(F.sha2(F.concat_ws("|", principal.cast("string"), normalized), 256), 1, 16))


def proposals(said: DataFrame) -> DataFrame:
    """FAC-3: (id, principal, statement, confidence, at) of what a model proposed, as far as its quote stands in the text it is from.

    ``said`` has (principal, statement, quote, text, confidence, at); of several
    wordings of one fact the earliest counts, ties to the smaller statement.
    """
    sound = said.withColumn("normalized", normal_fact(F.col("statement"))).filter(F.col("normalized") != "").filter(quote_found(F.col("quote"), F.col("text")))
    keyed = sound.withColumn("id", fact_id(F.col("principal"), F.col("normalized")))
    return keyed.groupBy("id").agg(F.min("principal").alias("principal"), F.min_by("statement", F.struct("at", "statement")).alias("statement"), F.least(F.max("confidence"), F.lit(MOST_CONFIDENCE)).alias("confidence"), F.min("at").alias("at"))


def record(known: DataFrame, proposed: DataFrame) -> DataFrame:
    """FAC-2: (id, principal, statement, state, confidence, created): what is known with its state as it is, and what is new as proposed."""
    both = known.select("id", F.struct("principal", "statement", "state", "confidence").alias("k")).join(proposed.select("id", F.struct("principal", "statement", "confidence").alias("p")), "id", "full")
    is_new = F.col("k").isNull()
    return both.select(
        "id",
        F.coalesce("k.principal", "p.principal").alias("principal"),
        F.coalesce("k.statement", "p.statement").alias("statement"),
        F.coalesce("k.state", F.lit("proposed")).alias("state"),
        F.greatest("k.confidence", "p.confidence").alias("confidence"),
        is_new.alias("created"),
    )


# Kinds of facts in the order a prompt names them, and how many it names.
KINDS, PROMPTED = ("constraint", "relationship", "preference", "routine"), 20


def fact_counts(facts: DataFrame) -> DataFrame:
    """AGG-11, FAC-5: (principal, confirmed, proposed, rejected)."""
    return facts.groupBy("principal").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("confirmed", "proposed", "rejected")))


def facts_for_prompt(facts: DataFrame, limit: int = PROMPTED) -> DataFrame:
    """FAC-4: (principal, place, line) of each principal's confirmed facts (principal, id, kind, statement, state, confidence) by the rank of their kind, then confidence."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce("kind", F.lit(""))), F.lit(0).cast("long")), F.lit(len(KINDS) + 1).cast("long"))
    order = Window.partitionBy("principal").orderBy(rank, F.desc("confidence"), "id")
    placed = facts.filter("state = 'confirmed'").withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit)
    return placed.select("principal", "place", F.concat(F.lit("("), "kind", F.lit(") "), "statement").alias("line"))


# --- queries over conversations ----------------------------------------------------


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say at the start of a turn, as statements, some with a quote of something else."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    quote = F.when(F.col("turn") % 4 == 3, "nobody said this").otherwise(F.substring("text", 3, 20))
    return turns.select((F.col("conv_id") % 7).alias("principal"), F.substring("text", 1, 24).alias("statement"), quote.alias("quote"), "text", (F.lit(0.55) + (F.col("turn") % 10) * 0.05).alias("confidence"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "conv_id")


_WORDS = f"list_sort(list_distinct(list_filter(string_split_regex(lower(statement), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) for w in STOPWORDS)}], w))))"
_SAID = f"""said AS (SELECT conv_id % 7 AS principal, substr(text, 1, 24) AS statement, CASE WHEN turn % 4 = 3 THEN 'nobody said this' ELSE substr(text, 3, 20) END AS quote, text, 0.55 + (turn % 10) * 0.05 AS confidence, conv_id * 1000 + turn AS at_, conv_id FROM conversations WHERE role = 'user'),
n AS (SELECT *, array_to_string({_WORDS}, ' ') AS normalized FROM said), fq AS (SELECT *, regexp_replace(lower(quote), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS q, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM n WHERE normalized <> ''),
sound AS (SELECT *, 'ft_' || substr(sha256(principal || '|' || normalized), 1, 16) AS id FROM fq WHERE q <> '' AND contains(t, q))"""


_RECORDED = f"""{_SAID}, known AS (SELECT id, min(principal) AS principal, arg_min(statement, (at_, statement)) AS statement, CASE WHEN min(conv_id) % 3 = 0 THEN 'rejected' ELSE 'confirmed' END AS state, 0.6::DOUBLE AS confidence FROM sound WHERE conv_id % 2 = 0 GROUP BY id),
p AS (SELECT id, min(principal) AS principal, arg_min(statement, (at_, statement)) AS statement, least(max(confidence), {MOST_CONFIDENCE})::DOUBLE AS confidence FROM sound GROUP BY id),
recorded AS (SELECT id, coalesce(k.principal, p.principal) AS principal, coalesce(k.statement, p.statement) AS statement, coalesce(state, 'proposed') AS state, round(greatest(k.confidence, p.confidence), 6)::DOUBLE AS confidence, k.id IS NULL AS created FROM p FULL JOIN known k USING (id))"""


@query(f"WITH {_RECORDED} SELECT * FROM recorded")
def facts_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAC-2, FAC-3, FAC-5: facts of all conversations filed over those decided on in half of them."""
    said = _said(spark, sf_dir)
    half = said.filter("conv_id % 2 = 0")
    decided = proposals(half)
    first = half.withColumn("id", fact_id(F.col("principal"), normal_fact(F.col("statement")))).filter(quote_found(F.col("quote"), F.col("text"))).groupBy("id").agg(F.min("conv_id").alias("conv_id"))
    known = decided.join(first, "id").select("id", "principal", "statement", F.when(F.col("conv_id") % 3 == 0, "rejected").otherwise("confirmed").alias("state"), F.lit(0.6).alias("confidence"))
    return record(known, proposals(said)).withColumn("confidence", F.round("confidence", 6))


_KIND = "CASE WHEN lower(statement) < 'e' THEN 'constraint' WHEN lower(statement) < 'm' THEN 'routine' WHEN lower(statement) < 's' THEN 'preference' ELSE 'habit' END"


@query(f"WITH {_RECORDED} SELECT principal, count(*) FILTER (state = 'confirmed') AS confirmed, count(*) FILTER (state = 'proposed') AS proposed, count(*) FILTER (state = 'rejected') AS rejected FROM recorded GROUP BY principal")
def facts_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, FAC-5: everybody's facts by state."""
    return fact_counts(facts_recorded(spark, sf_dir))


@query(f"""WITH {_RECORDED}, k AS (SELECT *, {_KIND} AS kind FROM recorded WHERE state = 'confirmed'), r AS (SELECT principal, kind, statement, row_number() OVER (PARTITION BY principal ORDER BY CASE kind WHEN 'constraint' THEN 0 WHEN 'relationship' THEN 1 WHEN 'preference' THEN 2 WHEN 'routine' THEN 3 ELSE 4 END, confidence DESC, id) AS place FROM k)
SELECT principal, place, '(' || kind || ') ' || statement AS line FROM r WHERE place <= {PROMPTED}""")
def facts_prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAC-4: everybody's confirmed facts as a prompt names them."""
    return facts_for_prompt(facts_recorded(spark, sf_dir).withColumn("kind", F.expr(_KIND)))
