"""The query tools: search within a scope, items, situations and conversations, and why nothing was found.

Who may see an item is decided inside each query, before anything is ranked.
Keyword search reads the store's positional index (:mod:`index`), vector search
the vectors of the items in scope.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.index import index_sql, indexed_bm25, match_terms, store_index
from tidepool.operators.retrieval import DEPTH, FORMS, RRF, fuse, nearest, ranked
from tidepool.registry import query
from tidepool.sources.tables import DOCUMENTS_SQL, TURNS_SQL, document_items, table, turns

#: How many hits a tool gives, and at most.
ITEMS, MOST_ITEMS, EPISODES, MOST_EPISODES = 20, 100, 10, 50
MOST_CHARACTERS = 12_000


@dataclass(frozen=True)
class Scope:
    """Who asks, and what narrows the question; what is not given does not filter."""

    principal: str | None = None
    kinds: tuple[str, ...] = ()
    since: int | None = None
    until: int | None = None
    person: str | None = None
    oldest: bool = False
    limit: int = ITEMS
    extra: tuple[Column, ...] = field(default=())

    def reasons(self) -> list[str]:
        """RET-10: what holds of every hit because it was asked for."""
        out = ["within the requested time range"] if self.since is not None or self.until is not None else []
        return [*out, "involves the requested person"] if self.person else out

    def predicates(self) -> list[Column]:
        out = [F.col("deleted").isNull()] if self.principal is None else [F.col("deleted").isNull(), (F.col("custodian") == self.principal) | (F.col("visibility") == "household")]
        out += [F.col("kind").isin(*self.kinds)] if self.kinds else []
        out += [F.col("item_id") >= self.since] if self.since is not None else []
        out += [F.col("item_id") <= self.until] if self.until is not None else []
        out += [F.contains(F.lower("body"), F.lit(self.person.lower()))] if self.person else []
        return [*out, *self.extra]

    def within(self, items: DataFrame) -> DataFrame:
        """FIL-1, FIL-2, FIL-4: the items in scope."""
        return items.filter(reduce(lambda a, b: a & b, self.predicates()))


def owned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items with their owner, visibility and tombstone."""
    items = document_items(spark, sf_dir)
    accounts = items.select("account_id").distinct()
    # An account's last digit tells whose it is.
    last = F.coalesce(F.expr("try_cast(right(account_id, 1) as int)"), F.lit(0))
    owners = accounts.select("account_id", F.when(last % 3 == 0, "ann").otherwise("ben").alias("custodian"), F.when(last % 2 == 0, "household").otherwise("own").alias("visibility"))
    return items.join(owners, "account_id", "left").withColumn("deleted", F.when(F.col("item_id") % 17 == 0, F.col("item_id")))


_LAST = "coalesce(try_cast(right(account_id, 1) AS INTEGER), 0)"
_OWNED = f"{DOCUMENTS_SQL}, owned AS (SELECT *, CASE WHEN item_id % 17 = 0 THEN item_id END AS deleted, CASE WHEN {_LAST} % 3 = 0 THEN 'ann' ELSE 'ben' END AS custodian, CASE WHEN {_LAST} % 2 = 0 THEN 'household' ELSE 'own' END AS visibility FROM items)"


def search(spark: SparkSession, items: DataFrame, index: str, question: str, scope: Scope, *, vectors: DataFrame | None = None, asked: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """TOOL-1, RET-9, RET-10: (item_id, kind, score, why) of the best items in scope.

    ``mode`` is lexical, semantic or hybrid; hybrid where there are ``vectors``
    (item_id, embedding) and one ``asked`` for, else lexical.  Without a
    question the newest items, or the oldest.
    """
    allowed = scope.within(items).select("item_id", "kind")
    limit, base = min(scope.limit, MOST_ITEMS), scope.reasons()
    if not question.strip():
        order = F.asc("item_id") if scope.oldest else F.desc("item_id")
        first = allowed.orderBy(order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(order)))
        number = F.concat(F.lit(" (#"), F.col("rank").cast("string"), F.lit(")"))
        why = F.concat(F.lit("chronological"), number) if scope.oldest else F.when(F.col("rank") == 1, "most recent").otherwise(F.concat(F.lit("recent"), number))
        return first.select("item_id", "kind", F.round(1.0 / F.col("rank"), 8).alias("score"), F.concat_ws("; ", *map(F.lit, base), why).alias("why"))
    mode = mode or ("lexical" if vectors is None or asked is None else "hybrid")
    lists = {}
    if mode != "semantic" and match_terms(question):
        lists["keyword"] = ranked(indexed_bm25(spark, index, question, allowed), DEPTH)
    if mode != "lexical" and vectors is not None and asked is not None:
        lists["meaning"] = ranked(nearest(vectors.join(allowed, "item_id", "left_semi"), asked, id="item_id"), DEPTH)
    if not lists:
        return allowed.limit(0).select("item_id", "kind", F.lit(0.0).alias("score"), F.lit("").alias("why"))
    said = F.when(F.col("why") == "keyword+meaning", F.lit("matched on keyword and meaning")).when(F.col("why") == "meaning", F.lit(f'similar in meaning to "{question}"')).otherwise(F.lit(f'matches "{question}"'))
    best = fuse(lists).orderBy(F.desc("score"), "item_id").limit(limit)
    return best.join(allowed, "item_id").select("item_id", "kind", "score", F.concat_ws("; ", *map(F.lit, base), said).alias("why"))


_QUESTION, _KINDS = "licensed version thing worthless", ("en", "fr")


def _scored(scope: str) -> str:
    """SQL: ``kw``, the keyword ranks within a scope, and ``mn``, those of the vectors."""
    return f"""{_OWNED}, {index_sql({stem: [words] for stem, words in FORMS.items()})}, scope AS (SELECT item_id, kind FROM owned WHERE deleted IS NULL AND {scope}),
kw AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM lx JOIN scope USING (item_id) QUALIFY rank <= {DEPTH}),
mn AS (SELECT e.vec_id AS item_id, row_number() OVER (ORDER BY round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) DESC, e.vec_id) AS rank
  FROM embeddings e JOIN scope ON scope.item_id = e.vec_id, embeddings q WHERE q.vec_id = 0 QUALIFY rank <= {DEPTH})"""


@query(f"""WITH {_scored(f'kind IN {_KINDS} AND item_id >= 20')} SELECT item_id, kind, round(1.0::DOUBLE / ({RRF} + rank), 8) AS score, 'within the requested time range; matches "{_QUESTION}"' AS why FROM kw JOIN scope USING (item_id) ORDER BY score DESC, item_id LIMIT 50""")
def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-1, FIL-1, FIL-4, FIL-5, RET-1 to RET-3: live items of two kinds since a bound, by keyword."""
    return search(spark, owned_items(spark, sf_dir), store_index(spark, sf_dir), _QUESTION, Scope(kinds=_KINDS, since=20, limit=50))


@query(f"""WITH {_scored("(custodian = 'ann' OR visibility = 'household') AND contains(lower(body), 'the')")}, u AS (SELECT item_id, rank, 'keyword' AS label FROM kw UNION ALL SELECT item_id, rank, 'meaning' FROM mn),
z AS (SELECT item_id, round(sum(1.0::DOUBLE / ({RRF} + rank)), 8) AS score, string_agg(label, '+' ORDER BY label) AS found FROM u GROUP BY item_id)
SELECT item_id, kind, score, 'involves the requested person; ' || CASE found WHEN 'keyword+meaning' THEN 'matched on keyword and meaning' WHEN 'meaning' THEN 'similar in meaning to "{_QUESTION}"' ELSE 'matches "{_QUESTION}"' END AS why
FROM z JOIN scope USING (item_id) ORDER BY score DESC, item_id LIMIT 30""")
def search_hybrid_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-1, FIL-2, RET-8 to RET-10: keyword and meaning fused within what a principal may see, with a reason for each hit."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    scope = Scope(principal="ann", person="the", limit=30)
    return search(spark, owned_items(spark, sf_dir), store_index(spark, sf_dir), _QUESTION, scope, vectors=vectors, asked=vectors.filter("item_id = 0"))


@query(f"""WITH {_OWNED} SELECT item_id, kind, round(1.0::DOUBLE / rank, 8) AS score, 'involves the requested person; ' || CASE rank WHEN 1 THEN 'most recent' ELSE 'recent (#' || rank || ')' END AS why
FROM (SELECT item_id, kind, row_number() OVER (ORDER BY item_id DESC) AS rank FROM owned WHERE deleted IS NULL AND contains(lower(body), '@mail1')) WHERE rank <= 100""")
def search_without_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-1, TOP-2, RET-9: without a question the newest items with a person, the limit capped."""
    return search(spark, owned_items(spark, sf_dir), "", "", Scope(person="@mail1", limit=1000))


@query(f"""WITH {_OWNED}, seen AS (SELECT principal, visibility FROM owned, (VALUES ('ann'), ('ben')) AS who(principal) WHERE deleted IS NULL AND (custodian = principal OR visibility = 'household')) SELECT principal, visibility, count(*) AS items FROM seen GROUP BY ALL""")
def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-2: how many items each principal sees."""
    items = owned_items(spark, sf_dir)
    parts = [Scope(principal=p).within(items).groupBy(F.lit(p).alias("principal"), "visibility").agg(F.count(F.lit(1)).alias("items")) for p in ("ann", "ben")]
    return parts[0].unionByName(parts[1])


def gated(text: Column, level: Column) -> Column:
    """POL-5, POL-6: what the gate shows of a text: all, a note for restricted ones; an unlabelled one counts as sensitive."""
    known = F.coalesce(level, F.lit(1))
    return F.when(known == 2, F.lit("[withheld]")).when(known == 1, F.concat(F.lit("[sensitive] "), F.substring(text, 1, 200))).otherwise(F.substring(text, 1, MOST_CHARACTERS))


@query(f"WITH {_OWNED} SELECT item_id, account_id, kind, title, length(substr(body, 1, {MOST_CHARACTERS})) AS characters, md5(substr(body, 1, {MOST_CHARACTERS})) AS digest FROM owned WHERE deleted IS NULL AND item_id IN (1, 2, 3, 17, 34, 55, 144)")
def items_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-9, FIL-10, JOI-15: items asked for by id, live ones only, bounded in length."""
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 17, 34, 55, 144)], "item_id long")
    found = owned_items(spark, sf_dir).filter("deleted IS NULL").join(F.broadcast(asked), "item_id", "left_semi")
    text = F.substring("body", 1, MOST_CHARACTERS)
    return found.select("item_id", "account_id", "kind", "title", F.char_length(text).cast("long").alias("characters"), F.md5(text).alias("digest"))


@query(f"""WITH {TURNS_SQL}, c AS (SELECT conv_id, count(*) AS turns, count(DISTINCT speaker) AS speakers, min(turn) AS first, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) FILTER (speaker = 'Me') AS mine FROM turns GROUP BY conv_id)
SELECT conv_id, turns, speakers, mine, length(transcript) AS characters, md5(transcript) AS digest FROM c ORDER BY conv_id DESC LIMIT {MOST_EPISODES}""")
def conversations_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-9, TOOL-10, RET-11: the newest conversations with their transcripts."""
    newest = table(spark, sf_dir, "conversations").select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(MOST_EPISODES)
    said = turns(spark, sf_dir).join(F.broadcast(newest), "conv_id", "left_semi")
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n")
    grouped = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("speaker").alias("speakers"), F.count_if(F.col("speaker") == "Me").alias("mine"), told.alias("transcript"))
    return grouped.select("conv_id", "turns", "speakers", "mine", F.char_length("transcript").cast("long").alias("characters"), F.md5("transcript").alias("digest"))


@query(f"""WITH {TURNS_SQL}, h AS (SELECT conv_id, count(*) AS quotes, min(turn) AS first_turn FROM turns WHERE speaker = 'Me' AND contains(lower(text), 'the') GROUP BY conv_id), s AS (SELECT conv_id, count(DISTINCT speaker) AS speakers FROM turns GROUP BY conv_id)
SELECT conv_id, quotes, first_turn, speakers FROM h JOIN s USING (conv_id) ORDER BY quotes DESC, conv_id LIMIT {EPISODES}""")
def conversations_said_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-9, TOOL-14: conversations in which one speaker says something, by how often."""
    said = turns(spark, sf_dir)
    hits = said.filter((F.col("speaker") == "Me") & F.contains(F.lower("text"), F.lit("the"))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("quotes"), F.min("turn").alias("first_turn"))
    speakers = said.groupBy("conv_id").agg(F.countDistinct("speaker").alias("speakers"))
    return hits.join(speakers, "conv_id").orderBy(F.desc("quotes"), "conv_id").limit(EPISODES).select("conv_id", "quotes", "first_turn", "speakers")


@query(f"""WITH {_OWNED}, m AS (SELECT *, contains(lower(body), '@mail1') AS person, contains(lower(body), 'licensed') AS asked FROM owned)
SELECT count(*) FILTER (deleted IS NULL) AS live, count(*) FILTER (deleted IS NULL AND person) AS with_person, count(*) FILTER (deleted IS NULL AND asked) AS with_question, count(*) FILTER (deleted IS NULL AND person AND asked) AS with_both,
CASE WHEN count(*) FILTER (deleted IS NULL AND person AND asked) > 0 THEN 'found' WHEN count(*) FILTER (deleted IS NULL AND person) = 0 THEN 'person unknown' WHEN count(*) FILTER (deleted IS NULL AND asked) = 0 THEN 'words unknown' ELSE 'never together' END AS diagnosis FROM m""")
def empty_result_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-15: why a search for a person and a word finds nothing, by counts."""
    items = owned_items(spark, sf_dir).filter("deleted IS NULL")
    person, asked = F.contains(F.lower("body"), F.lit("@mail1")), F.contains(F.lower("body"), F.lit("licensed"))
    counted = items.agg(F.count(F.lit(1)).alias("live"), F.count_if(person).alias("with_person"), F.count_if(asked).alias("with_question"), F.count_if(person & asked).alias("with_both"))
    diagnosis = F.when(F.col("with_both") > 0, "found").when(F.col("with_person") == 0, "person unknown").when(F.col("with_question") == 0, "words unknown").otherwise("never together")
    return counted.withColumn("diagnosis", diagnosis)


@query("""WITH p AS (SELECT p_brand AS account, split_part(p_type, ' ', 1) AS mime, p_size * 1000 AS bytes FROM part), m AS (SELECT mime, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM p GROUP BY mime)
SELECT mime, files, bytes FROM m ORDER BY files DESC, mime LIMIT 8""")
def attachments_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, SRC-25: the eight most frequent types of attachments."""
    kinds = table(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("mime")).agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("p_size") * 1000).cast("long")).alias("bytes"))
    return kinds.orderBy(F.desc("files"), "mime").limit(8)


@query("SELECT count(*) AS entities, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS people, count(DISTINCT c_nationkey) AS groups, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS known FROM customer")
def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: how many customers of which kind."""
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("c_mktsegment") == "HOUSEHOLD").alias("people"), F.countDistinct("c_nationkey").alias("groups"), F.round(F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)), 6).alias("known"))


@query("SELECT o_orderstatus AS state, count(*) AS facts, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY o_orderstatus")
def counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of each state."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.countDistinct("o_custkey").alias("owners"))


@query("""SELECT o_orderkey AS task, o_orderpriority AS kind, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'
ORDER BY place LIMIT 50""")
def open_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-4: open ones by the rank of their kind, then by time."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    first = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("kind"), rank.alias("r"), "o_orderdate").orderBy("r", "o_orderdate", "task").limit(50)
    return first.select("task", "kind", F.row_number().over(Window.orderBy("r", "o_orderdate", "task")).cast("long").alias("place"))


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), l AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM n)
SELECT label, arg_min(vec_id, vec_id) AS first_chunk, count(*) AS chunks, round(max(abs(norm - 1)), 4) AS most_off FROM l GROUP BY label""")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vectors of each label are from unit length, and the first of them."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_chunk"), F.count(F.lit(1)).alias("chunks"), F.round(F.max(F.abs(norm - 1)), 4).alias("most_off"))


@query("SELECT event_id, k FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events) WHERE k > 90")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-17: what stands in an item's JSON, unnested."""
    members = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m")).select("event_id", F.explode("m").alias("key", "k"))
    return members.filter("key = 'k' AND k > 90").select("event_id", "k")


@query("""WITH l AS (SELECT l_partkey AS p, p_name AS own, max(l_returnflag) AS fallback FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT p, coalesce(CASE WHEN p % 3 = 0 THEN NULL ELSE own END, fallback, 'unknown') AS name FROM l""")
def names_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of its own, or what others call it."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("own"))
    called = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.max("l_returnflag").alias("fallback"))
    return own.join(called, "p").select("p", F.coalesce("own", "fallback", F.lit("unknown")).alias("name"))


@query("SELECT conv_id AS a, conv_id + 1 AS b FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0 UNION SELECT conv_id + 1, conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0")
def conflicts_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations, both ways."""
    one = table(spark, sf_dir, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("a"), (F.col("conv_id") + 1).alias("b")).distinct()
    return one.union(one.select("b", "a")).distinct()


@query("""WITH e AS (SELECT l_orderkey AS brief, list_sort(list_distinct(list(l_suppkey))) AS evidence FROM lineitem GROUP BY l_orderkey)
SELECT x.brief AS a, x.brief + 1 AS b, len(list_filter(x.evidence, lambda v: NOT list_contains(y.evidence, v))) = 0 AS subsumed, len(list_intersect(x.evidence, y.evidence)) AS shared FROM e x JOIN e y ON y.brief = x.brief + 1""")
def evidence_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3: whether a brief's evidence is all in the next one's."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.collect_set("l_suppkey").alias("x"))
    other = seen.select((F.col("a") - 1).alias("a"), F.col("x").alias("y"))
    return seen.join(other, "a").select("a", (F.col("a") + 1).alias("b"), (F.size(F.array_except("x", "y")) == 0).alias("subsumed"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))
