"""JSON out of a model's answer: wrappers taken off, the outermost balanced object found, nothing guessed.

The object is found by a scan over the text's quotes, braces and escapes with
a state of depth, start and whether a string is open, so a brace inside a
string ends nothing and of two objects the first is taken.  What is found is a
VARIANT, read by paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.registry import query
from tidepool.sources.tables import table

# The tags of reasoning, closed or cut off.
THINKING = r"(?is)<(think|thinking|reasoning|scratchpad)>.*?</\1>"
OPEN_THINKING = r"(?is)<(?:think|thinking|reasoning|scratchpad)>.*$"
FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def _text(value: str) -> str:
    """SQL: a string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _trimmed(text: str) -> str:
    return f"regexp_replace({text}, {_text(r'^\s+|\s+$')}, '')"


def first_object(text: str) -> str:
    """SQL: the first balanced ``{...}`` of a text, or null."""
    tokens = f"regexp_extract_all({text}, {_text(r'(?s)\\.|\\\z|["{}]|[^\\"{}]+')}, 0)"

    def state(at: str = "s.at + length(k)", depth: str = "s.depth", start: str = "s.start", end: str = "s.end", quoted: str = "s.quoted") -> str:
        return f"named_struct('at', {at}, 'depth', {depth}, 'start', {start}, 'end', {end}, 'quoted', {quoted})"

    step = f"""case when s.end >= 0 then s
      when k = '"' then {state(quoted='not s.quoted')}
      when s.quoted or k not in ('{{', '}}') then {state()}
      when k = '{{' then {state(depth='s.depth + 1', start='if(s.depth = 0, s.at, s.start)')}
      else {state(depth='s.depth - 1', end='if(s.depth = 1 and s.start >= 0, s.at + 1, s.end)')} end"""
    scanned = f"aggregate({tokens}, {state('0', '0', '-1', '-1', 'false')}, (s, k) -> {step})"
    return _let("f", scanned, f"if(f.end >= 0, substr({text}, f.start + 1, f.end - f.start), null)")


def _parses(text: str) -> str:
    """SQL: whether all of a text is one JSON value; the parser alone would overlook what stands behind it."""
    return f"(try_parse_json(concat('{{\"a\":', {text}, '}}')) is not null and try_parse_json(concat('[', {text}, ']')) is not null)"


def recovered(column: str) -> Column:
    """PUR-12: of the answers in a column of strings: struct of ``value`` (variant), ``repaired`` (what had to be taken off) and ``error`` of a model's answer.

    A null or empty answer is an error, as are a trace without an answer, a
    text without an object, and an object that is malformed even without
    invalid escapes.  An object that says a key twice counts as malformed.
    """

    def out(value: str, repaired: str, error: str) -> str:
        return f"named_struct('value', {value}, 'repaired', {repaired}, 'error', {error})"

    nothing, fine = "cast(null as variant)", "cast(null as string)"
    bare = r"\\([^\"\\/bfnrtu])"
    prose = "concat(r, array('surrounding prose'))"
    found = f"""case when o is null then {out(nothing, 'r', "concat('no JSON object in the response: ', left(t, 80))")}
      when {_parses('o')} then {out('try_parse_json(o)', prose, fine)}
      when u <> o and {_parses('u')} then {out('try_parse_json(u)', f"concat({prose}, array('invalid escape'))", fine)}
      else {out(nothing, prose, "'found an object but it is malformed'")} end"""
    scanned = _let("o", first_object("t"), _let("u", f"regexp_replace(o, {_text(bare)}, '$1')", found))
    whole = f"""case when t = '' then {out(nothing, 'r', "'the model said nothing'")} when {_parses('t')} then {out('try_parse_json(t)', 'r', fine)} else {scanned} end"""
    fenced = _let("z", f"if(b rlike {_text(FENCE)}, named_struct('t', {_trimmed(f'regexp_extract(b, {_text(FENCE)}, 1)')}, 'r', concat(q, array('code fence'))), named_struct('t', b, 'r', q))", _let("t", "z.t", _let("r", "z.r", whole)))
    trace = f"""if(c rlike {_text(OPEN_THINKING)} and not contains(c, '{{'), {out(nothing, 'q', "'the model produced only a reasoning trace, with no answer'")}, {_let('b', _trimmed(f"regexp_replace(c, {_text(OPEN_THINKING)}, '')"), fenced)})"""
    thought = _let("a", f"coalesce(`{column}`, '')", _let("c", _trimmed(f"regexp_replace(a, {_text(THINKING)}, '')"), _let("q", f"if(a rlike {_text(THINKING)}, array('reasoning block'), cast(array() as array<string>))", trace)))
    return F.expr(thought)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, answer): orders as a model would have told them, in all the ways that models do."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    plain = F.format_string('{"order": %d, "merchant": "the {%s} \\"shop\\"", "cents": %d}', "o_orderkey", "o_orderpriority", "cents")
    thought, fence = F.lit("<think>is {it} 5?</think>\n"), F.lit("```")
    form = F.col("o_orderkey") % 10
    said = (
        F.when(form == 0, plain)
        .when(form == 1, F.concat(thought, plain))
        .when(form == 2, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), plain, F.lit("\n"), fence))
        .when(form == 3, F.concat(thought, fence, plain, fence, F.lit(" done")))
        .when(form == 4, F.concat(F.lit("It was "), plain, F.lit(" and not "), plain))
        .when(form == 5, F.substring(plain, 1, 30))
        .when(form == 6, F.lit("  "))
        .when(form == 7, F.replace(plain, F.lit("the {"), F.lit("\\$ {")))
        .when(form == 8, F.lit("<reasoning>hard to say"))
        .otherwise(F.concat(F.lit("["), plain, F.lit("]")))
    )
    return orders.select(F.col("o_orderkey").alias("order_id"), said.alias("answer"))


_FORM = "o_orderkey % 10"


@query(f"""SELECT o_orderkey AS order_id, CASE WHEN {_FORM} IN (5, 6, 8, 9) THEN NULL ELSE o_orderkey END AS told, CASE WHEN {_FORM} IN (5, 6, 8, 9) THEN NULL WHEN {_FORM} = 7 THEN '$ {{' || o_orderpriority || '}} "shop"' ELSE 'the {{' || o_orderpriority || '}} "shop"' END AS merchant,
CASE WHEN {_FORM} IN (5, 6, 8) THEN NULL ELSE round(o_totalprice * 100)::BIGINT END AS cents,
CASE {_FORM} WHEN 1 THEN 'reasoning block' WHEN 2 THEN 'code fence' WHEN 3 THEN 'reasoning block+code fence' WHEN 4 THEN 'surrounding prose' WHEN 7 THEN 'surrounding prose+invalid escape' ELSE '' END AS repaired,
CASE {_FORM} WHEN 5 THEN 'no JSON object in the response: ' || trim(left('{{"order": ' || o_orderkey || ', "merchant": "the {{' || o_orderpriority, 30)) WHEN 6 THEN 'the model said nothing' WHEN 8 THEN 'the model produced only a reasoning trace, with no answer' END AS error FROM orders""")
def answers_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-12: purchases read out of answers by paths, what had to be taken off, and why nothing was found."""
    found = answers(spark, sf_dir).withColumn("found", recovered("answer"))

    def read(path: str, kind: str) -> Column:
        return F.expr(f"try_variant_get(found.value, '{path}', '{kind}')")

    cents = F.coalesce(read("$.cents", "bigint"), read("$[0].cents", "bigint"))
    return found.select("order_id", read("$.order", "bigint").alias("told"), read("$.merchant", "string").alias("merchant"), cents.alias("cents"), F.array_join("found.repaired", "+").alias("repaired"), F.col("found.error").alias("error"))
