"""The short names that people are called by: generated, kept as an index of their own, and looked up.

An alias is a guess and two people may share one, so aliases widen a lookup and
never merge anybody.  Names lose their marks in Arrow batches; all else is
expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.identity import PHONE
from tidepool.registry import query
from tidepool.sources.tables import table
from tidepool.stems import changed, plain

# Short forms that no rule gives, by given name.
IRREGULAR = """robert bob bobby rob robbie
richard dick rick ricky rich
william bill billy will willy
margaret peggy maggie meg greta
john jack johnny
james jim jimmy jamie
charles chuck charlie chas
henry hank harry
edward ted teddy ned eddie
elizabeth liz beth betsy eliza libby lizzie
sarah sally
mary molly polly
anne nancy annie
ann nancy annie
katherine kate katie kitty kay
catherine kate katie kitty kay
theodore ted teddy theo
joseph joe joey
michael mike mickey mick
patrick pat paddy rick
daniel dan danny
alex tom tommy
christopher chris kit topher
nicholas nick nicky cole
alexander alex xander sasha lex
alexandra alex sasha lexi
jonathan jon johnny nate
francis frank frankie
frances fran franny
esperanza bella belle isa
isabel bella belle isa
eleanor nell ellie nora
virginia ginny ginger
barbara barb babs
deborah deb debbie
jennifer jen jenny
jessica jess jessie
rebecca becky becca bex
samantha sam sammy
stephanie steph stevie
victoria vicky tori vic
benjamin ben benny
gregory greg
matthew matt matty
andrew andy drew
anthony tony
timothy tim timmy
zachary zach zack"""
# Endings of short forms, letters that double, and how long an alias may be.
ENDINGS, DOUBLING = ("y", "ie", "i", "s"), "bcdfglmnprstz"
LEAST, MOST = 2, 40


def fold(name: Column) -> Column:
    """Small letters, digits, blanks, quotes and hyphens of a name without marks."""
    kept = F.regexp_replace(F.lower(name), r"[^a-z0-9\s'-]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def short_forms(given: Column) -> Column:
    """The first two to four letters, the last doubled or not, with an ending; those shorter than the name itself."""
    clean = F.regexp_replace(given, "[^a-z]", "")
    none = F.array().cast("array<string>")

    def ended(stem: Column) -> Column:
        return F.array(*(F.concat(stem, F.lit(e)) for e in ENDINGS))

    forms = []
    for size in (2, 3, 4):
        stem = F.substring(clean, 1, size)
        last = F.right(stem, F.lit(1))
        # Two letters alone are a fragment; doubled they are how people are called.
        whole = F.char_length(stem) > 2
        doubles, doubled = last.rlike(f"[{DOUBLING}]"), F.concat(stem, last)
        zed = F.concat(F.left(stem, F.char_length(stem) - 1), F.lit("zz"))
        forms += [F.when(whole, F.concat(F.array(stem), ended(stem))).otherwise(none), F.when(doubles, F.concat(F.array(doubled), ended(doubled))).otherwise(none), F.when(last == "s", F.concat(F.array(zed), ended(zed))).otherwise(none)]
    found = F.array_distinct(F.flatten(F.array(*forms)))
    shorter = F.filter(found, lambda f: (F.char_length(f) >= 2) & (F.char_length(f) < F.char_length(clean)))
    return F.when(F.char_length(clean) >= 3, shorter).otherwise(none)


def aliases(people: DataFrame) -> DataFrame:
    """IDN-8: (entity, alias, origin) of (entity, name, stated): every way a person may be referred to.

    Stated names come first, then the given name, its irregular and its regular
    short forms, and the family name; an alias has the origin it comes from
    first.  A null name or list gives nothing.
    """
    bare = changed(changed(people.select("entity", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("stated", F.array().cast("array<string>")).alias("stated")), "name", plain), "stated", plain)
    parts = F.filter(F.split(fold(F.col("name")), r"[\s,]+"), lambda p: p != "")
    named = bare.withColumn("parts", parts)
    given, family = F.get("parts", F.lit(0)), F.when(F.size("parts") > 1, F.element_at("parts", -1))
    known = F.create_map(*[x for line in IRREGULAR.splitlines() for x in (F.lit(line.split()[0]), F.array(*map(F.lit, line.split()[1:])))])
    none = F.array().cast("array<string>")

    def of(values: Column, origin: str) -> Column:
        return F.transform(values, lambda a: F.struct(a.alias("alias"), F.lit(origin).alias("origin")))

    single = F.when(given.isNotNull(), F.array(given)).otherwise(none)
    irregular = F.coalesce(F.try_element_at(known, given), none)
    last = F.when(family.isNotNull() & (family != given), F.array(family)).otherwise(none)
    every = F.concat(of(F.transform("stated", fold), "stated"), of(single, "given"), of(irregular, "derived"), of(F.coalesce(short_forms(given), none), "derived"), of(last, "family"))
    fits = F.filter(every, lambda a: F.char_length(a["alias"]).between(LEAST, MOST))
    staged = named.select("entity", fits.alias("every"))
    # A person has some dozens of aliases, so each is held against those before it.
    first = F.expr("filter(every, (a, i) -> not exists(slice(every, 1, i), b -> b.alias = a.alias))")
    return staged.select("entity", F.explode(first).alias("a")).select("entity", "a.alias", "a.origin")


def lookup(people: DataFrame, index: DataFrame, identifiers: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """FIL-11, ENT-8, TOOL-3: (entity, name, items) of the people a question may mean, those with most items first.

    ``people`` has (entity, name, items), ``index`` is of :func:`aliases`,
    ``identifiers`` has (entity, normalized).  People are found by their id, by
    an alias or its beginning, by a part of their name, or by an address or
    number, which are matched as typed or folded.  An index written in order of
    its aliases is read only where they begin so.
    """
    asked = question.strip()
    bare = plain(asked.lower())
    folded = asked.lower() if "@" in asked else " ".join("".join(c for c in bare if c.isascii() and (c.isalnum() or c.isspace() or c in "'-")).split())
    if not folded:
        return people.limit(0).select("entity", "name", "items")
    by_alias = index.filter(F.startswith("alias", F.lit(folded))).select("entity")
    spark = people.sparkSession
    phone = spark.range(1).select(F.when(F.lit(asked).rlike(PHONE), T.phone(F.lit(asked))).alias("p")).first()["p"]
    by_number = identifiers.filter(F.contains(F.lower("normalized"), F.lit(folded)) | (F.col("normalized") == F.lit(phone))).select("entity")
    by_name = people.filter((F.col("entity") == F.lit(asked)) | F.contains(F.lower("name"), F.lit(folded))).select("entity")
    found = by_alias.union(by_number).union(by_name).distinct()
    return people.join(found, "entity", "left_semi").orderBy(F.desc("items"), "entity").limit(limit).select("entity", "name", "items")


# --- queries over customers as people ---------------------------------------------

_GIVEN = ("Robert", "Esperanza", "Óscar", "Łucja", "Zoë", "Jessica", "Al", "Margaret", "Anne-Marie", "Sébastien", "William", "Bo")


def named_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, name, stated, items): customers under a given name and their nation's, some with a stated name, and their orders."""
    names = F.array(*map(F.lit, _GIVEN))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.get(names, (F.col("c_custkey") % len(_GIVEN)).cast("int")), F.lit(" "), F.initcap("n_name"))
    stated = F.when(F.col("c_custkey") % 5 == 0, F.array(F.concat(F.lit("Ché"), F.col("c_custkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("items"))
    return people.join(orders, "c_custkey", "left").select(F.concat(F.lit("e_"), F.col("c_custkey").cast("string")).alias("entity"), name.alias("name"), stated.alias("stated"), F.coalesce("items", F.lit(0)).alias("items"))


_FORMS = ", ".join(f"('{line.split()[0]}', [{', '.join(repr(w) for w in line.split()[1:])}])" for line in IRREGULAR.splitlines())
_STEMS = "list_distinct([clean[1:2], clean[1:3], clean[1:4]])"
_ENDED = "list_concat([{0}], list_transform(['y', 'ie', 'i', 's'], lambda e: {0} || e))"
_ALIASES_SQL = f"""who AS (SELECT 'e_' || c_custkey AS entity, [{', '.join(repr(g) for g in _GIVEN)}][c_custkey % {len(_GIVEN)} + 1] || ' ' || list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name, CASE WHEN c_custkey % 5 = 0 THEN 'che' || c_custkey END AS stated,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS items FROM customer JOIN nation ON c_nationkey = n_nationkey),
parts AS (SELECT *, string_split(regexp_replace(lower(strip_accents(name)), '[^a-z0-9 ''-]', '', 'g'), ' ') AS p FROM who), g AS (SELECT *, regexp_replace(p[1], '[^a-z]', '', 'g') AS clean FROM parts),
s AS (SELECT entity, clean, unnest({_STEMS}) AS stem FROM g WHERE length(clean) >= 3),
forms AS (SELECT entity, clean, unnest(list_concat(list_concat(CASE WHEN length(stem) > 2 THEN {_ENDED.format('stem')} ELSE [] END, CASE WHEN contains('{DOUBLING}', stem[-1]) THEN {_ENDED.format('(stem || stem[-1])')} ELSE [] END), CASE WHEN stem[-1] = 's' THEN {_ENDED.format("(stem[1:length(stem) - 1] || 'zz')")} ELSE [] END)) AS alias FROM s),
irregular(given, short) AS (VALUES {_FORMS}),
every AS (SELECT entity, stated AS alias, 0 AS rank, 'stated' AS origin FROM g WHERE stated IS NOT NULL UNION ALL SELECT entity, p[1], 1, 'given' FROM g UNION ALL SELECT entity, unnest(short), 2, 'derived' FROM g JOIN irregular ON given = p[1]
  UNION ALL SELECT entity, alias, 3, 'derived' FROM forms WHERE length(alias) < length(clean) UNION ALL SELECT entity, p[-1], 4, 'family' FROM g WHERE len(p) > 1),
aliases AS (SELECT entity, alias, arg_min(origin, rank) AS origin FROM every WHERE length(alias) BETWEEN {LEAST} AND {MOST} GROUP BY entity, alias)"""


@query(f"WITH {_ALIASES_SQL} SELECT entity, alias, origin FROM aliases")
def people_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-8: every way people may be referred to, and where it comes from."""
    return aliases(named_people(spark, sf_dir))


@query(f"""WITH {_ALIASES_SQL} SELECT entity, name, items FROM who WHERE contains(lower(name), 'essy') OR entity IN (SELECT entity FROM aliases WHERE starts_with(alias, 'essy')) ORDER BY items DESC, entity LIMIT 50""")
def people_by_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-11, ENT-8, TOOL-3: the people that a short name may mean, those one writes with most first."""
    people = named_people(spark, sf_dir)
    addresses = people.select("entity", F.concat("entity", F.lit("@example.com")).alias("normalized"))
    return lookup(people, aliases(people), addresses, " Essy ", limit=50)
