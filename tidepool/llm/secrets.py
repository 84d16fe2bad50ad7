"""Secret scans: patterns propose findings, a random forest takes out the false ones.

Proposals are private-key blocks, signed tokens, credentials in addresses,
values assigned to secret-sounding names, and long runs of key characters.
Each is described by its length and alphabet, its character transitions, how
much of it dictionary words cover, whether it lies in a path, and the words
beside it.  The forest is trained on the labelled findings of
:mod:`tidepool.llm.secret_samples`, whose labels come from what each value was
made as, not from these features; it is then written out as one SQL expression,
so that scanning is a single projection over each row: no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import _sql, secret_samples
from tidepool.llm._sql import matches, quote, shielded
from tidepool.plans.lineage import cut

_NAMES = "secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
_KEY = "A-Za-z0-9_+/=-"
_BLOCK = r"-----BEGIN (?:[A-Z]{1,16} ){0,4}?PRIVATE KEY-----[^-]++-----END (?:[A-Z]{1,16} ){0,4}?PRIVATE KEY-----"
_SIGNED = rf"(?<![.{_KEY}])eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]*+"
_LOGIN = r"://[^\s/:@\"'<>]{1,64}+:[^\s/:@\"'<>]{4,}+@"
ASSIGNED = rf"(?i)(?:{_NAMES})[a-z0-9_-]{{0,30}}+[\"']?[ \t]*+[:=][ \t]*+[\"']?[^\s\"'<>]{{8,}}+"
#: What an assignment ends with, and what may follow its value.
_LAST, _TRAILING = r"""[^\s"'=:<>]+=*$""", r"[,;.)#*$%&|}\]]+$"
RUN = rf"(?<![{_KEY}])[{_KEY}]{{20,}}+"
_INNOCENT = "sha1|sha256|md5|hash|commit|uuid|checksum|digest|example|sample|placeholder|your"
#: Feature names, in the order of the forest's input; SQL over a finding c.
FEATURES = {
    "length": "cast(length(c.text) as double)",
    "digits": "length(regexp_replace(c.text, '[^0-9]', '')) / length(c.text)",
    "capitals": "length(regexp_replace(c.text, '[^A-Z]', '')) / length(c.text)",
    "transitions": "regexp_count(c.text, '(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]') / length(c.text)",
    "hexadecimal": "length(regexp_replace(c.text, '[^0-9a-fA-F]', '')) / length(c.text)",
    "variety": "size(array_distinct(split(c.text, ''))) / length(c.text)",
    "consonants": "length(regexp_replace(c.text, '[^bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]', '')) / length(c.text)",
    "covered": "{covered}",
    "in_path": "if(c.text like '%/%/%' or c.before rlike '(?:/|://[^ ]*)$', 1D, 0D)",
    "test_path": "if(c.path rlike '(?i)test|example|fixture|sample|doc', 1D, 0D)",
    "secret_words": f"if(c.before rlike '(?i){_NAMES}', 1D, 0D)",
    "innocent_words": f"if(c.before rlike '(?i){_INNOCENT}', 1D, 0D)",
    "dots": "length(c.text) - length(replace(c.text, '.', ''))",
    "block": "if(c.text like '-----BEGIN%', 1D, 0D)",
    "login": "if(c.before rlike '://[^ /]*:$' and c.after like '@%', 1D, 0D)",
    "repeats": "length(regexp_replace(c.text, '(.)\\\\1+', '')) / length(c.text)",
    "quoted": r"""if(c.before rlike '["\'`]$' and c.after rlike '^["\'`]', 1D, 0D)""",
    "assigned": r"""if(c.before rlike '[:=][ \\t]*["\'`]?$', 1D, 0D)""",
}


@dataclass(frozen=True)
class Forest:
    """``sample`` labelled findings are trained on; ``words`` are in the dictionary that is counted over all texts."""

    trees: int = 20
    depth: int = 7
    sample: int = 6000
    words: int = 300
    votes: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Detector:
    """A trained forest as SQL: ``score`` gives a finding c's share of votes."""

    score: str
    votes: float


def _values(text: str, pattern: str, value: str) -> str:
    """SQL: of each match m of a pattern its part ``value``, at the last place where it holds that; struct<start, end, text>."""
    found = f"filter(transform({matches(text, pattern)}, m -> struct(m.start as start, m.text as whole, {value} as text)), m -> length(m.text) > 0)"
    placed = f"transform({found}, m -> struct(m.start + length(m.whole) - length(m.text) - instr(reverse(m.whole), reverse(m.text)) + 1 as start, m.text as text))"
    return f"transform({placed}, m -> struct(m.start as start, m.start + length(m.text) as end, m.text as text))"


def findings(text: str, path: str = "''") -> str:
    """SQL: a text's proposals, array<struct<start, text, before, after, path>> in order.

    Where proposals overlap, the earlier one stands, and a bare run gives way to all others.
    """
    kind, none = "array<struct<start:int,end:int,text:string>>", "cast(array() as array<struct<start:int,end:int,text:string>>)"
    assigned = f"regexp_replace(regexp_extract(m.text, {quote(_LAST)}, 0), {quote(_TRAILING)}, '')"
    login = "regexp_extract(m.text, ':([^:@]+)@$', 1)"
    told = f"""flatten(array(
        if({text} like '%PRIVATE KEY-----%', {_values(text, _BLOCK, 'm.text')}, {none}), if({text} like '%eyJ%', {_values(text, _SIGNED, 'm.text')}, {none}),
        if({text} like '%://%@%', {_values(text, _LOGIN, login)}, {none}), if({text} rlike '[:=]', filter({_values(text, ASSIGNED, assigned)}, m -> length(m.text) >= 8), {none})))"""
    runs = f"if({text} rlike {quote(RUN)}, cast(transform({matches(text, RUN)}, m -> struct(m.start as start, m.start + length(m.text) as end, m.text as text)) as {kind}), {none})"
    both = _sql.let("firm", _sql.first_of_overlapping(f"cast({told} as {kind})"), _sql.let("loose", runs, f"if(size(firm) + size(loose) = 0, {none}, {_sql.apart('firm', 'loose')})"))
    shown = _sql.let("bs", _sql.blocks(text), f"""transform(ms, m -> struct(m.start as start, m.text as text,
        {_sql.near('bs', 'greatest(m.start - 40, 0)', 'least(m.start, 40)')} as before, {_sql.near('bs', 'm.start + length(m.text)', '10')} as after, {path} as path))""")
    return _sql.let("ms", both, f"if(size(ms) = 0, cast(array() as array<struct<start:int,text:string,before:string,after:string,path:string>>), {shown})")


def with_findings(df: DataFrame, text: str, path: str | None, output: str) -> DataFrame:
    df, other, named = shielded(df)
    text, path = other.get(text, text), other.get(path, path)
    staged = df.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    staged = staged.withColumn("__path", F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit(""))
    return named(staged.withColumn(output, F.expr(findings("__text", "__path"))).drop("__text", "__path"))


def dictionary(df: DataFrame, text: str, how: Forest) -> list[str]:
    """The words of 4 to 12 letters in most of the distinct texts."""
    rows = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    found = rows.select("h", F.array_distinct(F.expr("regexp_extract_all(lower(t), '(?<![a-z])[a-z]{4,12}(?![a-z])', 0)")).alias("ws"))
    # Copies of a text meet by its hash, a row of each task at most.
    words = found.groupBy("h").agg(F.first("ws").alias("ws")).select(F.explode("ws").alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(how.words).collect()]


def _expression(node, names: list[str]) -> str:
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        return f"if(f[{split.featureIndex()}] <= {split.threshold()!r}D, {_expression(node.leftChild(), names)}, {_expression(node.rightChild(), names)})"
    return f"{float(node.prediction())}D"


def train(labelled: DataFrame, words: list[str], how: Forest = Forest()) -> Detector:  # noqa: B008
    """Train on labelled findings: rows (c, label) with c as from :func:`findings`, a table of bounded size."""
    covered = f"1 - length(regexp_replace(lower(c.text), {quote('|'.join(sorted(words, key=len, reverse=True)))}, '')) / length(c.text)" if words else "0D"
    features = {k: f"cast({v.replace('{covered}', covered)} as double)" for k, v in FEATURES.items()}
    # In one partition and order, so that the forest comes out the same each time.
    table = cut(labelled.select(F.col("label").cast("double").alias("label"), *(F.expr(v).alias(k) for k, v in features.items())).repartition(1).sortWithinPartitions("label", *features))
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(table)
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=how.seed, maxBins=32).fit(data)
    votes = " + ".join(_expression(tree._java_obj.rootNode(), list(features)) for tree in forest.trees)
    inputs = ", ".join(features.values())
    return Detector(f"aggregate(array(array({inputs})), 0D, (_, f) -> ({votes}) / {how.trees})", how.votes)


def scan(df: DataFrame, detector: Detector, text: str = "text", path: str | None = "source", *, output: str = "findings") -> DataFrame:
    """Add ``output``: every finding of the text with ``start``, ``end``, ``text``, ``score`` and ``is_secret``.

    A null or empty text has none; nulls, repeated rows and other columns stay
    as they are; a column named like the output is replaced.  A tie at the
    votes it takes counts as a secret.
    """
    df, other, named = shielded(df)
    text, path = other.get(text, text), other.get(path, path)
    found = with_findings(df, text, path, "__found")
    scored = f"transform(__found, c -> struct(c.start as start, c.start + length(c.text) as end, c.text as text, {detector.score} as score))"
    out = f"transform(__scored, c -> struct(c.start as start, c.end as end, c.text as text, c.score as score, c.score >= {detector.votes} as is_secret))"
    return named(found.withColumn("__scored", F.expr(scored)).withColumn(output, F.expr(out)).drop("__found", "__scored"))


def redact(df: DataFrame, detector: Detector, text: str = "text", path: str | None = "source", *, mark: str = "[secret]") -> DataFrame:
    """Replace every secret in the text by ``mark``; all rows and columns stay."""
    df, other, named = shielded(df)
    text, path = other.get(text, text), other.get(path, path)
    found = scan(df, detector, text, path, output="__findings")
    shown = _sql.replaced("__scan_shown", "filter(__findings, c -> c.is_secret)", quote(mark))
    staged = found.withColumn("__scan_shown", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return named(staged.withColumn(text, F.when(F.exists("__findings", lambda c: c["is_secret"]), F.expr(shown)).otherwise(F.col(f"`{text}`"))).drop("__findings", "__scan_shown"))


def fit(df: DataFrame, text: str = "text", how: Forest = Forest(), kinds: list[str] | None = None) -> Detector:  # noqa: B008
    """A detector trained on the shipped labelled findings (of all kinds, or those named), with the dictionary of the table's own texts."""
    words = dictionary(df, text, how)
    return train(secret_samples.labelled(df.sparkSession, how.sample, words, kinds), words, how)


def digest(scanned: DataFrame, *keep: str, findings: str = "findings") -> DataFrame:
    """Counts of findings and secrets, and the secrets' places as start:end, comma-joined."""
    secrets = F.filter(findings, lambda c: c["is_secret"])
    places = F.array_join(F.transform(secrets, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",")
    return scanned.select(*keep, F.size(findings).cast("long").alias("n_findings"), F.size(secrets).cast("long").alias("n_secrets"), places.alias("secrets"))
