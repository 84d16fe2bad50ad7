"""Labelled findings to train secret scans on.

There is no labelled table, so a documented set is made here: values of known
kinds, secret or not, in the surroundings in which such values are met.  The
label is that of the kind; nothing is read off a value.  Everything follows
from a row's number by hashes, so the set is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm._sql import quote

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LOWER + _LOWER.upper() + "0123456789"
#: Words that code and prose put together to long names.
_PARTS = "user,session,config,default,internal,response,handler,factory,manager,background,application,component,message,builder,document,service,template,service,provider,account,settings,index,update,request,listener,global,local,context,number,element".split(",")


def _drawn(alphabet: str, length: str, seed: str) -> str:
    """SQL: ``length`` characters of an alphabet, by the row's number i."""
    return f"array_join(transform(sequence(1, {length}), k -> substr({quote(alphabet)}, cast(pmod(xxhash64(i, k, '{seed}'), {len(alphabet)}) as int) + 1, 1)), '')"


def _words(separator: str, count: str, camel: bool = False) -> str:
    """SQL: words of prose or code, joined."""
    word = "element_at(ws, cast(pmod(xxhash64(i, k, 'word'), size(ws)) as int) + 1)"
    word = f"if(k = 1, {word}, initcap({word}))" if camel else word
    return f"array_join(transform(sequence(1, {count}), k -> {word}), '{separator}')"


def _between(low: int, high: int) -> str:
    return f"{low} + cast(pmod(xxhash64(i, 'length'), {high - low + 1}) as int)"


_HEX = "0123456789abcdef"
_UUID = f"concat_ws('-', {_drawn(_HEX, '8', 'a')}, {_drawn(_HEX, '4', 'b')}, {_drawn(_HEX, '4', 'c')}, {_drawn(_HEX, '4', 'd')}, {_drawn(_HEX, '12', 'e')})"
_SIGNED = f"concat('eyJ', {_drawn(_MIXED, _between(17, 60), 'a')}, '.eyJ', {_drawn(_MIXED, _between(20, 90), 'b')}, '.', {_drawn(_MIXED + '_-', '43', 'c')})"
_PEM = f"concat('-----BEGIN PRIVATE KEY-----\\n', {_drawn(_MIXED + '+/', _between(200, 900), 'a')}, '\\n-----END PRIVATE KEY-----')"
#: Surroundings: what stands before and after a value.
_ASSIGNED = [('token = "', '"'), ("password=", " "), ("api_key: ", "\n"), ("SECRET_KEY='", "'\n"), ("export ACCESS_KEY=", "\n"), ('"auth_token": "', '",'), ("client_secret := ", "\n"), ('passwd = "', '"### ')]
_BARE = [(" ", " "), ("\n", "\n"), ("key ", ". "), ("with ", ", "), ("### ", "### "), ("use ", " "), ("Authorization: Bearer ", "\n"), ("(", ")")]
_TOLD = [("commit ", " "), ("sha256: ", "\n"), ("md5 = ", "\n"), ("checksum ", " "), ("hash=", "&"), ('integrity="sha384-', '"'), ("uuid: ", "\n"), ("digest ", " "), ("etag: ", "\n"), ("revision ", " "), ("build ", ")")]
_NAMED = [("import ", "\n"), ("see ", " "), ("class ", " {"), ("/usr/lib/", " "), ("https://example.org/", " "), ('href="/', '"'), ("the ", " of "), (" ", " "), ("function ", "("), ("- ", "\n")]
#: Kinds of values: label, SQL of the value, surroundings.
KINDS: dict[str, tuple[int, str, list[tuple[str, str]]]] = {
    "hex_assigned": (1, _drawn(_HEX, _between(16, 64), "v"), _ASSIGNED),
    "mixed_assigned": (1, _drawn(_MIXED, _between(12, 64), "v"), _ASSIGNED),
    "symbols_assigned": (1, _drawn(_MIXED + "!@#%^&*_-", _between(9, 32), "v"), _ASSIGNED),
    "base64_assigned": (1, f"concat({_drawn(_MIXED + '+/', _between(20, 86), 'v')}, '==')", _ASSIGNED),
    "mixed_bare": (1, _drawn(_MIXED, _between(30, 64), "v"), _BARE),
    "cloud_key": (1, f"concat('AKIA', {_drawn(_LOWER.upper() + '234567', '16', 'v')})", [*_BARE, *_ASSIGNED]),
    "prefixed_key": (1, f"concat(element_at(array('ghp_', 'sk_live_', 'xoxb-', 'glpat-', 'AIza'), cast(pmod(i, 5) as int) + 1), {_drawn(_MIXED, _between(20, 40), 'v')})", [*_BARE, *_ASSIGNED]),
    "signed_token": (1, _SIGNED, [*_BARE, *_ASSIGNED]),
    "private_key": (1, _PEM, [("", "\n"), ("\n", "\n"), ("key: |\n", "\n")]),
    "login": (1, _drawn(_MIXED + "!%*_-", _between(8, 24), "v"), [("postgres://admin:", "@db.local/"), ("https://bot:", "@host/x"), ("amqp://app:", "@queue:56")]),
    "hex_told": (0, _drawn(_HEX, "element_at(array(32, 40, 64), cast(pmod(i, 3) as int) + 1)", "v"), _TOLD),
    "base64_told": (0, f"concat({_drawn(_MIXED + '+/', '43', 'v')}, '=')", [('integrity="sha256-', '"'), ("checksum ", " "), ("data:image/png;base64,", '"'), ("digest: ", "\n")]),
    "uuid": (0, _UUID, [*_TOLD, *_BARE, ('id="', '"'), ("request ", " ")]),
    "snake_name": (0, _words("_", _between(3, 6)), [*_NAMED, *_ASSIGNED]),
    "camel_name": (0, _words("", _between(3, 6), camel=True), [*_NAMED, *_ASSIGNED]),
    "path": (0, f"concat('/', {_words('/', _between(3, 6))})", [*_NAMED, *_ASSIGNED]),
    "slug": (0, _words("-", _between(4, 8)), [*_NAMED, ("https://example.org/posts/", " ")]),
    "long_word": (0, _words("", _between(3, 6)), [*_NAMED, *_BARE]),
    "placeholder": (0, f"element_at(array('your_token_here', 'xxxxxxxxxxxxxxxxxxxx', 'changeme-changeme', 'INSERT_API_KEY_HERE', '****************', 'example-secret-value', 'aaaaaaaaaaaaaaaaaaaaaa', 'TODO-replace-this-value', '00000000000000000000', 'process.env.SECRET_KEY', 'placeholder_value_1234'), cast(pmod(i, 11) as int) + 1)", _ASSIGNED),
    "rule": (0, "repeat(element_at(array('-', '=', '_', '-=', '_-'), cast(pmod(i, 5) as int) + 1), 24)", [("\n", "\n"), (" ", " "), ("", "\n")]),
    "digits": (0, _drawn("0123456789", _between(20, 40), "v"), [*_NAMED, *_TOLD, *_BARE]),
    "alphabet": (0, "element_at(array('abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '0123456789abcdef0123456789', 'abcdefghijklmnopqrstuvwxyz0123456789'), cast(pmod(i, 4) as int) + 1)", [*_BARE, ('alphabet = "', '"')]),
}


def labelled(spark: SparkSession, rows: int, words: list[str], kinds: list[str] | None = None) -> DataFrame:
    """(kind, c, label): ``rows`` labelled findings, as many of each kind; ``words`` are those of the scanned texts.

    c is a finding as the scan makes it: text, what is before and after it, and a path.
    """
    chosen = kinds or list(KINDS)
    vocabulary = f"array({', '.join(quote(w) for w in dict.fromkeys([*words[:200], *_PARTS]))})"
    numbered = spark.range(rows).select(F.col("id").alias("i"), F.pmod(F.col("id"), F.lit(len(chosen))).alias("k")).withColumn("ws", F.expr(vocabulary))
    value, before, after, label, name = "cast(null as string)", "''", "''", "0", "''"
    for n, kind in enumerate(chosen):
        truth, made, around = KINDS[kind]
        sides = [f"element_at(array({', '.join(quote(pair[side]) for pair in around)}), cast(pmod(xxhash64(i, 'around'), {len(around)}) as int) + 1)" for side in (0, 1)]
        value, before, after, label, name = (f"if(k = {n}, {x}, {rest})" for x, rest in ((made, value), (sides[0], before), (sides[1], after), (str(truth), label), (quote(kind), name)))
    lead = f"concat({_words(' ', '5')}, ' ')"
    c = f"struct(0 as start, {value} as text, right(concat({lead}, {before}), 40) as before, substr(concat({after}, {_words(' ', '3')}), 1, 10) as after, '' as path)"
    return numbered.select(F.expr(name).alias("kind"), F.expr(c).alias("c"), F.expr(label).alias("label"))
