"""Who oneself is: the anchors that are the owner's, and the people who turn out to be the owner under another name.

Anchors are the addresses of connected accounts, the handles that a source says
are one's own, and the authors of what was sent.  Whoever holds one of them is
the owner, and so is whoever shares an identifier with such a person, through
any number of people: one label spreads over the components of the graph of
people and identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators.components import components
from tidepool.operators.identity import _PARSED_SQL, _headers, entity_id, parse_address
from tidepool.plans.lineage import cut
from tidepool.registry import query
from tidepool.sources.tables import micros, table

#: How many authors of sent items count, and the owner's id.
MOST_AUTHORS, SELF = 200, "self:default"


def owner_anchors(accounts: DataFrame, handles: DataFrame, sent: DataFrame) -> DataFrame:
    """ENT-1: (kind, normalized, origin) of what is the owner's.

    ``accounts`` has (label): a label is an address only if it looks like one.
    ``handles`` has (kind, value), of phones and addresses; ``sent`` has
    (author, t) of live items sent, of whose authors the earliest MOST_AUTHORS
    count.  An anchor from several origins has the strongest: an account, then
    a handle, then an author.
    """
    labels = accounts.filter(F.contains("label", F.lit("@"))).select(F.lit("email").alias("kind"), T.email(F.col("label")).alias("normalized"), F.lit(0).alias("rank"))
    phones = handles.filter("kind = 'phone'").select(F.lit("phone").alias("kind"), T.phone(F.col("value")).alias("normalized"), F.lit(1).alias("rank"))
    mails = handles.filter("kind <> 'phone'").filter(F.contains("value", F.lit("@"))).select(F.lit("email").alias("kind"), T.email(F.col("value")).alias("normalized"), F.lit(1).alias("rank"))
    first = sent.filter("author IS NOT NULL").groupBy("author").agg(F.min("t").alias("t")).orderBy("t", "author").limit(MOST_AUTHORS)
    authors = first.select(F.lit("email").alias("kind"), parse_address(F.col("author"))["email"].alias("normalized"), F.lit(2).alias("rank"))
    every = labels.unionByName(phones).unionByName(mails).unionByName(authors).filter("normalized IS NOT NULL")
    origin = F.element_at(F.array(*map(F.lit, ("account", "handle", "author"))), F.min("rank") + 1)
    return every.groupBy("kind", "normalized").agg(origin.alias("origin"))


def find_by_identifier(identifiers: DataFrame, kind: str, normalized: str) -> DataFrame:
    """ENT-10: the people who hold an identifier."""
    return identifiers.filter((F.col("kind") == kind) & (F.col("normalized") == normalized)).select("entity").distinct()


def owners(identifiers: DataFrame, anchors: DataFrame) -> DataFrame:
    """(entity, is_self): of all who hold an identifier (entity, kind, normalized), who the owner is.

    People who share an address or a phone are one component; a component that
    holds an anchor is the owner.  Names are too weak to join anybody.
    """
    strong = identifiers.filter("kind IN ('email', 'phone') AND normalized IS NOT NULL").select("entity", "kind", "normalized").distinct()
    # Nodes are numbered by hash: the people, and the identifiers that tie them.
    person = F.xxhash64(F.lit("entity"), F.col("entity"))
    key = F.xxhash64(F.lit("identifier"), F.col("kind"), F.col("normalized"))
    links = strong.select(person.alias("a"), key.alias("b"))
    parts = cut(components(links))
    held = anchors.select(key.alias("node")).distinct()
    mine = parts.join(held, "node", "left_semi").select("component").distinct()
    marked = parts.join(mine.withColumn("mine", F.lit(True)), "component", "left").select("node", "mine")
    people = identifiers.select("entity").distinct().withColumn("node", person)
    return people.join(marked, "node", "left").select("entity", F.coalesce("mine", F.lit(False)).alias("is_self"))


def merged_people(people: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """UPS-4, ENT-10: (entity, merged_into, name) of (entity, name, pinned): the owner's other selves point to SELF.

    A pinned name is never overwritten; the owner bears the pinned name among
    those merged, the smallest id's if there are several, else ``label``.
    """
    joined = people.join(found, "entity", "left").withColumn("is_self", F.coalesce("is_self", F.lit(False)))
    pinned = joined.filter("is_self AND pinned").agg(F.min_by("name", "entity").alias("kept"))
    selves = F.when(F.col("is_self"), F.lit(SELF))
    others = joined.select("entity", selves.alias("merged_into"), "name")
    own = pinned.select(F.lit(SELF).alias("entity"), F.lit(None).cast("string").alias("merged_into"), F.coalesce("kept", F.lit(label)).alias("name"))
    return others.unionByName(own)


def identifiers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, kind, normalized, name): customers' headers as people, some of whom share another's address or phone."""
    # Parsed once: the expressions are long, and each column below would repeat them.
    parsed = cut(_headers(spark, sf_dir).select("c_custkey", parse_address(F.col("header")).alias("p"))).select("c_custkey", "p.*")
    own = parsed.withColumn("entity", entity_id(F.col("email"), F.col("phone"), F.col("name"))).filter("entity IS NOT NULL")
    anchor = F.when(F.col("email").isNotNull(), "email").when(F.col("phone").isNotNull(), "phone").otherwise("name")
    held = own.select("c_custkey", "entity", anchor.alias("kind"), F.coalesce("email", "phone", F.lower("name")).alias("normalized"))
    # Every seventh also writes from the address or phone of the one ten numbers before.
    earlier = held.filter("kind <> 'name'").select((F.col("c_custkey") + 10).alias("c_custkey"), "kind", "normalized")
    shared = held.filter("c_custkey % 7 = 0").select("c_custkey", "entity").join(earlier, "c_custkey").select("entity", "kind", "normalized")
    return held.select("entity", "kind", "normalized").union(shared).distinct()


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accounts, handles and sent items: suppliers as accounts, a few customers' phones, and authors of urgent orders of one day in a hundred."""
    key = F.col("s_suppkey")
    accounts = table(spark, sf_dir, "supplier").select(F.when(key % 9 == 0, F.concat(F.lit("Customer."), F.lpad((key * 4).cast("string"), 9, "0"), F.lit("+news@GMAIL.com"))).otherwise(F.col("s_name")).alias("label"))
    handles = table(spark, sf_dir, "customer").filter("c_custkey % 365 = 0").select(F.lit("phone").alias("kind"), F.concat(F.lit("+1 (555) "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("-0199")).alias("value"))
    sent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderkey % 100 = 7").join(_headers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(F.col("header").alias("author"), micros("o_orderdate").alias("t"))
    return accounts, handles, sent


_ANCHORS_SQL = f"""{_PARSED_SQL}, held AS (SELECT c_custkey, 'e_' || substr(sha256(coalesce('email|' || email, 'phone|' || phone, 'name|' || normal)), 1, 20) AS entity, CASE WHEN email IS NOT NULL THEN 'email' WHEN phone IS NOT NULL THEN 'phone' ELSE 'name' END AS kind, coalesce(email, phone, lower(name)) AS normalized FROM named),
ids AS (SELECT entity, kind, normalized FROM held UNION SELECT h.entity, e.kind, e.normalized FROM held h JOIN held e ON e.c_custkey + 10 = h.c_custkey WHERE h.c_custkey % 7 = 0 AND e.kind <> 'name'),
authors AS (SELECT header, min(epoch_us(o_orderdate)) AS t FROM orders JOIN headers ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 100 = 7 GROUP BY header ORDER BY t, header LIMIT {MOST_AUTHORS}),
claims AS (SELECT 'email' AS kind, 'customer' || lpad((s_suppkey * 4)::VARCHAR, 9, '0') || '@gmail.com' AS normalized, 0 AS rank FROM supplier WHERE s_suppkey % 9 = 0
  UNION ALL SELECT 'phone', '+1555' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '0199', 1 FROM customer WHERE c_custkey % 365 = 0
  UNION ALL SELECT 'email', email, 2 FROM named JOIN headers USING (c_custkey) JOIN authors USING (header) WHERE email IS NOT NULL),
anchors AS (SELECT kind, normalized, ['account', 'handle', 'author'][min(rank) + 1] AS origin FROM claims GROUP BY ALL)"""


@query(f"WITH {_ANCHORS_SQL} SELECT kind, normalized, origin FROM anchors")
def self_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-1: addresses and phones that are the owner's own, and how that is known."""
    return owner_anchors(*_given(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ANCHORS_SQL}, strong AS (SELECT * FROM ids WHERE kind IN ('email', 'phone')), reached(entity) AS (SELECT entity FROM strong JOIN anchors USING (kind, normalized)
  UNION SELECT o.entity FROM reached r JOIN strong s ON s.entity = r.entity JOIN strong o ON o.kind = s.kind AND o.normalized = s.normalized)
SELECT DISTINCT entity, entity IN (SELECT entity FROM reached) AS is_self FROM ids""")
def self_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-1: which people are the owner under another name."""
    return owners(identifiers_of(spark, sf_dir), owner_anchors(*_given(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_ANCHORS_SQL}, strong AS (SELECT * FROM ids WHERE kind IN ('email', 'phone')), reached(entity) AS (SELECT entity FROM strong JOIN anchors USING (kind, normalized)
  UNION SELECT o.entity FROM reached r JOIN strong s ON s.entity = r.entity JOIN strong o ON o.kind = s.kind AND o.normalized = s.normalized),
who AS (SELECT entity, min(normalized) AS name, substr(entity, 3, 1) IN ('a', 'b') AS pinned FROM ids GROUP BY entity)
SELECT entity, CASE WHEN entity IN (SELECT entity FROM reached) THEN '{SELF}' END AS merged_into, name FROM who
UNION ALL SELECT '{SELF}', NULL, coalesce((SELECT arg_min(name, entity) FROM who WHERE pinned AND entity IN (SELECT entity FROM reached)), 'me')""")
def people_merged_into_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-4, ENT-10: people with the owner's other selves merged, a pinned name kept."""
    ids = cut(identifiers_of(spark, sf_dir))
    people = ids.groupBy("entity").agg(F.min("normalized").alias("name")).withColumn("pinned", F.substring("entity", 3, 1).isin("a", "b"))
    return merged_people(people, owners(ids, owner_anchors(*_given(spark, sf_dir))), "me")


def identities_in(participants: Column) -> Column:
    """ENT-11: struct of the distinct emails and phones among a card's participants, in their order."""
    parsed = F.transform(participants, parse_address)
    mails = F.array_distinct(F.filter(F.transform(parsed, lambda p: p["email"]), lambda e: e.isNotNull()))
    phones = F.array_distinct(F.filter(F.transform(parsed, lambda p: p["phone"]), lambda p: p.isNotNull()))
    return F.struct(mails.alias("emails"), phones.alias("phones"))


@query(f"""WITH {_PARSED_SQL}, c AS (SELECT c_mktsegment || '/' || c_nationkey AS card, c_custkey, email, phone FROM named JOIN customer USING (c_custkey))
SELECT card, count(email) AS emails, count(DISTINCT phone) AS phones, coalesce(min(email), '') AS first_email, coalesce(min(phone), '') AS first_phone FROM c GROUP BY card""")
def cards_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-11: the addresses and phones on each card; customers of one segment and nation stand on one."""
    cards = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("card")).join(_headers(spark, sf_dir), "c_custkey")
    # A card is what somebody typed by hand; here its entries are joined before they are read.
    listed = cards.groupBy("card").agg(F.collect_list("header").alias("participants"))
    found = listed.select("card", identities_in(F.col("participants")).alias("i"))
    return found.select("card", F.size("i.emails").cast("long").alias("emails"), F.size("i.phones").cast("long").alias("phones"), F.coalesce(F.array_min("i.emails"), F.lit("")).alias("first_email"), F.coalesce(F.array_min("i.phones"), F.lit("")).alias("first_phone"))


def newest(rows: DataFrame, by: str, most: int, *partition: str) -> DataFrame:
    """TOP-9: the newest rows, overall or of each group, in order of time."""
    if not partition:
        return rows.orderBy(F.desc(by)).limit(most)
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(by)))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


@query("""SELECT o_custkey AS principal, o_orderkey AS digest, epoch_us(o_orderdate) AS made, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 7""")
def digests_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-9: everybody's seven newest digests."""
    digests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("principal"), F.col("o_orderkey").alias("digest"), micros("o_orderdate").alias("made"))
    return newest(digests.withColumn("order", F.struct("made", "digest")), "order", 7, "principal").select("principal", "digest", "made", "rank")


def entity_counts(people: DataFrame, identifiers: DataFrame, links: DataFrame) -> DataFrame:
    """AGG-10: one row (entities, merged, pinned, identifiers, links) of (entity, merged_into, pinned) and of two tables' sizes."""
    live = F.col("merged_into").isNull()
    counted = people.agg(F.count_if(live).alias("entities"), F.count_if(~live).alias("merged"), F.count_if(live & F.coalesce("pinned", F.lit(False))).alias("pinned"))
    return counted.crossJoin(identifiers.agg(F.count(F.lit(1)).alias("identifiers"))).crossJoin(links.agg(F.count(F.lit(1)).alias("links")))


@query(f"""WITH RECURSIVE {_ANCHORS_SQL}, strong AS (SELECT * FROM ids WHERE kind IN ('email', 'phone')), reached(entity) AS (SELECT entity FROM strong JOIN anchors USING (kind, normalized)
  UNION SELECT o.entity FROM reached r JOIN strong s ON s.entity = r.entity JOIN strong o ON o.kind = s.kind AND o.normalized = s.normalized), who AS (SELECT DISTINCT entity, substr(entity, 3, 1) IN ('a', 'b') AS pinned, entity IN (SELECT entity FROM reached) AS merged FROM ids)
SELECT count(*) FILTER (NOT merged) AS entities, count(*) FILTER (merged) AS merged, count(*) FILTER (NOT merged AND pinned) AS pinned, (SELECT count(*) FROM ids) AS identifiers, (SELECT count(*) FROM orders) AS links FROM who""")
def entities_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: how many people there are, how many are merged or pinned, and how many identifiers and links."""
    ids = cut(identifiers_of(spark, sf_dir))
    found = owners(ids, owner_anchors(*_given(spark, sf_dir)))
    people = found.select("entity", F.when(F.col("is_self"), F.lit(SELF)).alias("merged_into"), F.substring("entity", 3, 1).isin("a", "b").alias("pinned"))
    return entity_counts(people, ids, table(spark, sf_dir, "orders"))
