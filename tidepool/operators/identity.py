"""Who is who: addresses parsed, names normalised, people resolved to one id each.

All rules are expressions over a column; an entity's id follows from its
strongest anchor (address, then phone, then name), so nothing is looked up in
order and any number of rows resolve in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.components import components
from tidepool.registry import query
from tidepool.sources.tables import table
from tidepool.stems import folded_names

BARE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE = r"^\+?[0-9 ().-]{7,20}$"
# Names and local parts that belong to no person.
NO_NAME = r"(?i)^(no-?reply|do-?not-?reply|postmaster|mailer-daemon|notifications?|info|support|admin|team)$"
AUTOMATED = r"(?i)^(no-?reply|do-?not-?reply|donotreply|bounce|mailer|postmaster|notifications?|alerts?|updates?|news|newsletter|noreply)"
_BLANKS = r"[ \t\n\r\f\x0b]+"


def normal_name(name: Column) -> Column:
    """IDN-2: unquoted, single blanks, "Last, First" turned, small letters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "^[\"']|[\"']$", ""), _BLANKS, " "))
    parts = F.split(clean, ",")
    turned = F.trim(F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0)))))
    swap = (F.instr(clean, ",") > 1) & (F.instr(clean, "@") == 0) & (F.size(parts) == 2)
    return F.lower(F.when(swap, turned).otherwise(clean))


def split_addresses(value: Column) -> Column:
    """IDN-4: a header's addresses: cut at commas that are in no quotes and no angle brackets."""
    outside = r',(?=(?:[^"]*"[^"]*")*[^"]*$)(?![^<>]*>)'
    return F.filter(F.split(value, outside), lambda x: F.trim(x) != "")


def parse_address(value: Column) -> Column:
    """IDN-3: struct of email, phone and name of ``Name <address>``, a bare address or a phone number."""
    raw = F.trim(value)
    inner = F.regexp_extract(raw, r"<([^>]+)>\s*$", 1)
    outer = F.regexp_replace(F.trim(F.regexp_replace(raw, r"<[^>]+>\s*$", "")), "^[\"']|[\"']$", "")
    angled, bare_mail, is_phone = inner != "", raw.rlike(BARE), raw.rlike(PHONE)
    email = F.when(is_phone, F.lit(None)).when(angled & F.trim(inner).rlike(BARE), T.email(inner)).when(~angled & bare_mail, T.email(raw))
    phone = F.when(is_phone, T.phone(raw)).when(angled & inner.rlike(PHONE), T.phone(inner))
    name = F.when(is_phone | (raw == ""), F.lit(None)).when(angled, F.nullif(outer, F.lit(""))).when(~bare_mail, raw)
    return F.struct(email.alias("email"), phone.alias("phone"), name.alias("name"))


def address_list(values: Column) -> Column:
    """IDN-9: all addresses of an array of headers that have an email or a name; bare phones are left out."""
    pieces = F.flatten(F.transform(values, split_addresses))
    return F.filter(F.transform(pieces, parse_address), lambda a: a["email"].isNotNull() | a["name"].isNotNull())


def useful_name(name: Column) -> Column:
    """IDN-5: whether a name is one to show."""
    clean = F.trim(name)
    return ~name.rlike(PHONE) & F.char_length(clean).between(2, 80) & ~clean.rlike(BARE) & ~clean.rlike(NO_NAME)


def automated(email: Column) -> Column:
    """IDN-5: whether an address belongs to a system."""
    return F.regexp_replace(email, "@[^@]*$", "").rlike(AUTOMATED)


def entity_id(email: Column, phone: Column, name: Column) -> Column:
    """ENT-2, KEY-1: the id that follows from the strongest anchor; null without any."""
    anchor = F.coalesce(F.concat(F.lit("email|"), email), F.concat(F.lit("phone|"), phone), F.concat(F.lit("name|"), normal_name(name)))
    return F.concat(F.lit("e_"), F.substring(F.sha2(anchor, 256), 1, 20))


def confidence(email: Column, phone: Column) -> Column:
    """ENT-4: a name alone is a weak identifier."""
    return F.when(email.isNotNull() | phone.isNotNull(), 1.0).otherwise(0.6)


def identifier_stats(seen: DataFrame) -> DataFrame:
    """ENT-6: of (entity, identifier, t): how often, first and last, with the best confidence."""
    return seen.groupBy("entity", "identifier").agg(F.count(F.lit(1)).alias("occurrences"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.max("confidence").alias("confidence"))


def welded(cards: DataFrame) -> DataFrame:
    """ENT-3, ENT-5: anchors that stand on one card are one person: (anchor, entity), through any number of cards.

    ``cards``: (card, anchor) with numbered anchors; a card's anchors are tied
    to its smallest one, so a card of n anchors makes n links.
    """
    first = cards.groupBy("card").agg(F.min("anchor").alias("a"))
    links = cards.join(first, "card").filter("anchor <> a").select("a", F.col("anchor").alias("b"))
    found = components(links)
    return cards.select("anchor").distinct().join(found.withColumnRenamed("node", "anchor"), "anchor", "left").select("anchor", F.coalesce("component", "anchor").alias("entity"))


def speaker_labels(names: Column) -> Column:
    """ENT-7: a title of the first three names and how many others there are."""
    more = F.size(names) - 3
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.when(more == 1, F.lit(" other")).otherwise(F.lit(" others")))).otherwise(F.lit("")))


def is_handle(value: Column) -> Column:
    """FIL-12: whether a text is a phone-like handle."""
    return F.trim(value).rlike(r"^\+?[0-9][0-9 ().-]{5,}$")


def is_handle_title(value: Column) -> Column:
    """FIL-12: whether a title is a list of handles alone."""
    return F.coalesce(F.forall(F.split(value, ","), is_handle), F.lit(False))


# --- queries over customers and suppliers as people and their headers ------------

_HEADER = "c_name || ' <' || lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 3 = 0 THEN '+tag' ELSE '' END || '@' || CASE c_custkey % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'mail.example.com' ELSE 'shop' || c_nationkey || '.org' END || '>'"
_PEOPLE_SQL = f"""headers AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+1 555 ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ' 0199' WHEN 1 THEN '"' || c_mktsegment || ', ' || c_name || '"' ELSE {_HEADER} END AS header FROM customer)"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as header values: phones, quoted names, names with addresses."""
    key = F.col("c_custkey")
    host = F.when(key % 4 == 0, "gmail.com").when(key % 4 == 1, "mail.example.com").otherwise(F.concat(F.lit("shop"), F.col("c_nationkey").cast("string"), F.lit(".org")))
    local = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.when(key % 3 == 0, "+tag").otherwise(""))
    full = F.concat(F.col("c_name"), F.lit(" <"), local, F.lit("@"), host, F.lit(">"))
    phone = F.concat(F.lit("+1 555 "), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" 0199"))
    quoted = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit(", "), F.col("c_name"), F.lit('"'))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 5 == 0, phone).when(key % 5 == 1, quoted).otherwise(full).alias("header"))


_PARSED_SQL = f"""{_PEOPLE_SQL}, a AS (SELECT c_custkey, header, regexp_matches(header, '^\\+?[0-9 ().-]{{7,20}}$') AS is_phone, regexp_extract(header, '<([^>]+)>$', 1) AS inner_, regexp_replace(regexp_replace(header, ' ?<[^>]+>$', ''), '^["'']|["'']$', '', 'g') AS outer_ FROM headers),
s AS (SELECT *, regexp_extract(inner_, '^([^+@]*)', 1) AS local, regexp_extract(inner_, '@(.*)$', 1) AS host FROM a),
parsed AS (SELECT c_custkey, CASE WHEN inner_ <> '' THEN CASE WHEN host = 'gmail.com' THEN replace(local, '.', '') ELSE local END || '@' || host END AS email,
  CASE WHEN is_phone THEN '+' || regexp_replace(header, '[^0-9]', '', 'g') END AS phone, CASE WHEN NOT is_phone THEN CASE WHEN inner_ <> '' THEN outer_ ELSE header END END AS name, CASE WHEN NOT is_phone THEN outer_ END AS plain FROM s),
named AS (SELECT *, lower(CASE WHEN strpos(plain, ',') > 1 AND len(string_split(plain, ',')) = 2 THEN trim(trim(string_split(plain, ',')[2]) || ' ' || trim(string_split(plain, ',')[1])) ELSE plain END) AS normal FROM parsed)"""


@query(f"WITH {_PARSED_SQL} SELECT c_custkey, email, phone, name, normal FROM named")
def addresses_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-2, IDN-3, IDN-9: headers as address, phone and name."""
    parsed = _headers(spark, sf_dir).select("c_custkey", parse_address(F.col("header")).alias("p"))
    return parsed.select("c_custkey", "p.email", "p.phone", "p.name", normal_name(F.col("p.name")).alias("normal"))


@query(f"WITH {_PARSED_SQL} SELECT 'e_' || substr(sha256(coalesce('email|' || email, 'phone|' || phone, 'name|' || normal)), 1, 20) AS entity, count(*) AS rows, max(CASE WHEN email IS NOT NULL OR phone IS NOT NULL THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS confidence, min(c_custkey) AS first_seen, max(c_custkey) AS last_seen FROM named GROUP BY 1")
def entities_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-2, ENT-4, ENT-6, ENT-9: people by their strongest anchor, with statistics of their identifiers."""
    p = _headers(spark, sf_dir).select("c_custkey", parse_address(F.col("header")).alias("p")).select("c_custkey", "p.*")
    keyed = p.select("c_custkey", entity_id(F.col("email"), F.col("phone"), F.col("name")).alias("entity"), confidence(F.col("email"), F.col("phone")).alias("confidence"))
    return keyed.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.max("confidence").alias("confidence"), F.min("c_custkey").alias("first_seen"), F.max("c_custkey").alias("last_seen"))


@query("""WITH RECURSIVE cards AS (SELECT DISTINCT p_brand || '/' || p_size AS card, p_partkey AS anchor FROM part), f AS (SELECT card, min(anchor) AS a FROM cards GROUP BY card),
l AS (SELECT a AS u, anchor AS v FROM cards JOIN f USING (card) WHERE anchor <> a UNION SELECT anchor, a FROM cards JOIN f USING (card) WHERE anchor <> a),
r(anchor, low) AS (SELECT anchor, anchor FROM cards UNION SELECT l.v, r.low FROM r JOIN l ON l.u = r.anchor WHERE l.v > r.low)
SELECT anchor, min(low) AS entity FROM r GROUP BY anchor""")
def cards_welded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-3, ENT-5: parts as anchors, those of one brand and size on one card, welded into entities."""
    cards = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("card"), F.col("p_partkey").alias("anchor")).distinct()
    return welded(cards)


@query(f"WITH {_PARSED_SQL} SELECT name IS NOT NULL AND NOT regexp_matches(coalesce(name, ''), '^\\+?[0-9 ().-]{{7,20}}$') AND length(trim(name)) BETWEEN 2 AND 80 AS useful, coalesce(regexp_matches(email, '{AUTOMATED}'), false) AS automated, phone IS NOT NULL AS handle, count(*) AS people FROM named GROUP BY ALL")
def names_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-5, FIL-12: how many headers have a name to show, an automated sender, or are a handle."""
    p = _headers(spark, sf_dir).select("header", parse_address(F.col("header")).alias("p"))
    judged = p.select(F.coalesce(useful_name(F.col("p.name")), F.lit(False)).alias("useful"), F.coalesce(automated(F.col("p.email")), F.lit(False)).alias("automated"), is_handle(F.col("header")).alias("handle"))
    return judged.groupBy("useful", "automated", "handle").agg(F.count(F.lit(1)).alias("people"))


@query("""WITH n AS (SELECT c_nationkey, list(c_name ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' and ' || (len(names) - 3) || CASE WHEN len(names) = 4 THEN ' other' ELSE ' others' END ELSE '' END AS title FROM n""")
def group_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-7: a group's title from its first three names."""
    # The first three of a group and its size are enough; no group is collected whole.
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name").withColumn("at", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).filter("at <= 3")
    first = ranked.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c_name"))), lambda x: x["c_name"]).alias("names"))
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") - 3
    others = F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.when(more == 1, " other").otherwise(" others"))).otherwise("")
    return first.join(sizes, "c_nationkey").select("c_nationkey", F.concat(F.array_join("names", ", "), others).alias("title"))


@query("SELECT p_partkey, trim(regexp_replace(strip_accents(lower(CASE p_partkey % 3 WHEN 0 THEN 'Žofie Łódź ' WHEN 1 THEN 'Ñandú Çelik ' ELSE '' END || p_name)), '[^a-z0-9 ''-]', '', 'g')) AS folded FROM part")
def names_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-7: names without marks."""
    marked = F.when(F.col("p_partkey") % 3 == 0, "Žofie Łódź ").when(F.col("p_partkey") % 3 == 1, "Ñandú Çelik ").otherwise("")
    return folded_names(table(spark, sf_dir, "part").select("p_partkey", F.concat(marked, "p_name").alias("folded")), "folded")
