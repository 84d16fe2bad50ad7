"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Everything is one projection of built-in SQL functions over each row: no
shuffle, no Python.  A kind's candidates are the leftmost non-overlapping
matches of its pattern; a candidate that fails the kind's test is dropped
without another try.  An account number's pattern matches its head alone, and
its country's length tells where it ends.  The patterns below are equivalent to
plain greedy ones, but written with possessive quantifiers and anchored starts,
so that a long run of digits or letters neither recurses nor takes quadratic
time; spans and their contexts are read block by block, so neither does a text
of very many matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import _sql

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``test`` is SQL over ``m.text``, and with ``context`` over ``m.before`` and
    ``m.after`` (lower case) too.  ``hint`` is a regular expression that a text
    must hold to have a match.  ``prior`` is the score of a confirmed span,
    words of ``near`` beside it raise it and words of ``against`` before it
    lower it; a span counts from ``least`` on.  ``whole`` is SQL for the whole
    span of a match m, or null, where ``m.tail`` is the text from its start on.
    """

    name: str
    pattern: str
    hint: str
    test: str
    prior: float
    near: str
    against: str = ""
    least: float = 0.0
    context: str = "true"
    whole: str = ""


def _digits(text: str) -> str:
    return rf"regexp_replace({text}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    value = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = 0, {value}, {value} * 2 - if({value} > 4, 9, 0))) % 10 = 0"


def mod97(text: str) -> str:
    """SQL: whether an account number's letters and digits leave 1 modulo 97."""
    moved = f"concat(substr(replace({text}, ' ', ''), 5), substr({text}, 1, 4))"
    return f"aggregate(split({moved}, ''), 0, (s, c) -> if(c = '', s, if(c >= 'A', (s * 100 + ascii(c) - 55) % 97, (s * 10 + ascii(c) - 48) % 97))) = 1"


#: Characters of a country's account numbers.
_IBAN = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 "
    "LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 BI27 DJ27 FK18 HN28 MN20 NI28 OM23 RU33 SO23 YE30"
)


#: No account number, single blanks included, is longer.
_TAIL = 72


def _iban() -> str:
    """SQL: the account number that starts with m.tail, by its country's length and checksum; null if there is none.

    It has single blanks at most, and no letter or digit follows.
    """
    run = "regexp_extract(m.tail, '^[A-Z0-9](?: ?[A-Z0-9])*+', 0)"
    size = f"cast(regexp_extract('{_IBAN}', concat(substr(m.tail, 1, 2), '([0-9]+)'), 1) as int)"
    ends = f"filter(sequence(k, 2 * k), n -> n <= length(r) and length(replace(substr(r, 1, n), ' ', '')) = k and substr(r, n, 1) <> ' ')"
    # The run is capitals and digits; what follows the candidate may be small letters too.
    fits = f"n is not null and not substr(m.tail, n + 1, 1) rlike '[A-Za-z0-9]' and {mod97('substr(r, 1, n)')}"
    found = _sql.let("k", size, _sql.let("n", f"get({ends}, 0)", f"if({fits}, substr(r, 1, n), null)"))
    return f"if('{_IBAN}' like concat('%', substr(m.tail, 1, 2), '%'), {_sql.let('r', run, found)}, null)"


_PHONE_WORDS = "phone|tel|call|mobile|fax|contact"
#: The kinds that count whatever their score.
BASE = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"m.text rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.]0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'", 0.6, "ip|address|host|server|login", "version|release|section"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", f"length({_digits('m.text')}) between 12 and 19 and {luhn(_digits('m.text'))}", 0.7, "card|visa|credit|payment|pay", "order|isbn|serial"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", f"length({_digits('m.text')}) between 9 and 15", 0.6, _PHONE_WORDS),
)
#: What the method adds: an account number by its checksum, the others by their context.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z][A-Z][0-9][0-9](?= ?[A-Z0-9])", "[A-Z][A-Z][0-9][0-9]", "true", 0.8, "iban|account|bank|transfer", "order|serial|part|article|licence|license", least=0.6, whole=_iban()),
    Kind("us_ssn", r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++", "[0-9]-[0-9]", "m.text rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' and substr(m.text, 1, 3) not in ('000', '666') and m.text < '9'", 0.3, "ssn|social security|taxpayer", least=0.5),
    Kind("local_phone", r"(?<![0-9])(?:[(][0-9]{3}[)] ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])", "[0-9][-. ()]+[0-9]", "true", 0.3, _PHONE_WORDS, least=0.5, context="not m.before like '%+%'"),
)
#: Characters of context before and after a candidate, and what context words add or take.
BEFORE, AFTER, BONUS, MALUS = 40, 20, 0.3, 0.3


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double>>"


def _spans(kind: Kind, text: str, cut: str, rank: int) -> Column:
    """The kind's spans of a text, in order; ``cut``: the text's blocks."""
    found = _sql.matches(text, kind.pattern)
    if kind.whole:
        tails = f"transform({found}, m -> struct(m.start as start, {_sql.near(cut, 'm.start', str(_TAIL))} as tail))"
        wholes = f"filter(transform({tails}, m -> struct(m.start as start, m.start + length({kind.whole}) as end, {kind.whole} as text)), m -> m.text is not null)"
        found = _sql.first_of_overlapping(wholes)
    tested = f"filter({found}, m -> {kind.test})"
    with_context = f"""transform({tested}, m -> struct(m.start as start, m.text as text,
        lower({_sql.near(cut, f"greatest(m.start - {BEFORE}, 0)", f"least(m.start, {BEFORE})")}) as before,
        lower({_sql.near(cut, "m.start + length(m.text)", str(AFTER))}) as after))"""
    near = f"(concat(m.before, ' ', m.after) rlike '(?:^|[^a-z])(?:{kind.near})')"
    against = f"(m.before rlike '(?:^|[^a-z])(?:{kind.against})')" if kind.against else "false"
    score = f"(cast({kind.prior} as double) + if({near}, {BONUS}D, 0D) - if({against}, {MALUS}D, 0D))"
    confirmed = f"""transform(filter({with_context}, m -> {kind.context} and {score} >= {kind.least}D), m -> struct(
        m.start as start, {rank} as rank, m.start + length(m.text) as end, '{kind.name}' as kind, m.text as text, {score} as score))"""
    return F.expr(f"if({text} rlike {_sql.quote(kind.hint)}, cast({confirmed} as {_SPANS}), cast(array() as {_SPANS}))")


def find_pii(df: DataFrame, text: str = "text", *, base: tuple[Kind, ...] = BASE, added: tuple[Kind, ...] = ADDED, least: float = 0.0, output: str = "pii") -> DataFrame:
    """Add ``output``: the text's spans of personal data, ordered by start and kind.

    Each span has ``start`` and ``end`` (code points, end exclusive), ``kind``,
    ``text``, ``score`` and ``is_base``.  Spans of ``added`` kinds that overlap
    a base span are left out, as are all below ``least``.  A null or empty text
    has none; other columns, repeated rows and nulls stay as they are; a column
    named like the output is replaced.
    """
    df, other, named = _sql.shielded(df)
    text = other.get(text, text)
    hidden, blocks = "__pii_text", "__pii_blocks"
    staged = df.withColumn(hidden, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # Texts without any hint are not cut.
    any_hint = " or ".join(f"{hidden} rlike {_sql.quote(k.hint)}" for k in (*base, *added))
    staged = staged.withColumn(blocks, F.expr(f"if({any_hint}, {_sql.blocks(hidden)}, cast(array() as array<string>))"))
    for at, kind in enumerate((*base, *added)):
        staged = staged.withColumn(f"__pii_{at}", _spans(kind, hidden, blocks, at))
    staged = staged.withColumn("__pii_base", F.flatten(F.array(*(F.col(f"__pii_{i}") for i in range(len(base))))))
    staged = staged.withColumn("__pii_added", F.flatten(F.array(*(F.col(f"__pii_{len(base) + i}") for i in range(len(added))))) if added else F.expr(f"cast(array() as {_SPANS})"))
    staged = staged.withColumn("__pii_all", F.expr(_sql.apart("__pii_base", "__pii_added")))
    out = F.transform(F.filter("__pii_all", lambda s: s["score"] >= least), lambda s: F.struct(s["start"], s["end"], s["kind"], s["text"], s["score"], (s["rank"] < len(base)).alias("is_base")))
    return named(staged.withColumn(output, out).drop(hidden, blocks, "__pii_base", "__pii_added", "__pii_all", *(f"__pii_{i}" for i in range(len(base) + len(added)))))


def redact(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Replace every span by its kind in brackets; of overlapping spans the later ones go with the first, to the end of the last."""
    df, other, named = _sql.shielded(df)
    text = other.get(text, text)
    found = find_pii(df, text, output="__pii", **options)
    # A span that starts a stretch of overlapping ones ends where the stretch does.
    reach = _sql.running("transform(__pii, s -> s.end)", "0", "greatest(c, v)")
    later = f"reverse({_sql.running('transform(reverse(__pii), s -> s.start)', '2147483647', 'least(c, v)')})"
    heads = f"filter(zip_with(__pii, zip_with({reach}, {later}, (e, n) -> struct(e as e, n as n)), (s, o) -> struct(s.start as start, greatest(s.end, o.e) as end, o.n as next, s.kind as kind, s.start >= o.e as head)), x -> x.head or x.end <= x.next)"
    starts, ends = "filter(hs, x -> x.head)", "filter(hs, x -> x.end <= x.next)"
    spans = _sql.let("hs", heads, f"zip_with({starts}, {ends}, (a, b) -> struct(a.start as start, b.end as end, a.kind as kind))")
    shown = _sql.replaced("__pii_shown", spans, "concat('[', s.kind, ']')")
    staged = found.withColumn("__pii_shown", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return named(staged.withColumn(text, F.when(F.size("__pii") > 0, F.expr(shown)).otherwise(F.col(f"`{text}`"))).drop("__pii", "__pii_shown"))


def digest(found: DataFrame, *keep: str, spans: str = "pii") -> DataFrame:
    """Counts and digests of :func:`find_pii`'s spans, and the spans' scores in their order."""

    def joined(column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter(spans, lambda s: s["is_base"])
    def count(name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["is_base"] & (s["kind"] == name))).cast("long")

    return found.select(*keep, *(count(k.name).alias(f"n_{k.name}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
