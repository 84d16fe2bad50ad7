"""Hybrid retrieval: keyword and vector ranking, fused by reciprocal rank.

Keyword scores come from the store's positional index (:mod:`index`), which an
application writes once; vectors are scanned exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.index import index_sql, indexed_bm25, store_index
from tidepool.registry import query
from tidepool.sources.tables import CHAT_SQL, DOCUMENTS_SQL, chat_items, table

RRF, DEPTH = 60, 60
TERMS = ("licensed", "version", "thing", "worthless")


def ranked(hits: DataFrame, depth: int, id: str = "item_id") -> DataFrame:  # noqa: A002
    """The best hits with their rank; the window sees no more than ``depth`` rows."""
    best = hits.orderBy(F.desc("score"), id).limit(depth)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id)).cast("long"))


def nearest(vectors: DataFrame, question: DataFrame, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:  # noqa: A002
    """(id, score): cosine of unit vectors with the one vector asked for."""
    dot = F.aggregate(F.zip_with(vector, "asked", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return vectors.crossJoin(F.broadcast(question.select(F.col(vector).alias("asked")))).select(id, F.round(dot, 6).alias("score"))


def fuse(lists: dict[str, DataFrame], id: str = "item_id") -> DataFrame:  # noqa: A002
    """Reciprocal rank fusion of ranked lists; ``why`` names the lists that hold the item."""
    parts = [df.select(id, "rank", F.lit(label).alias("label")) for label, df in lists.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(id).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("label")), "+").alias("why"))


def _lexical(spark: SparkSession, sf_dir: str, question: str = " ".join(TERMS)) -> DataFrame:
    return ranked(indexed_bm25(spark, store_index(spark, sf_dir), question), DEPTH)


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    hits = nearest(vectors, vectors.filter("vec_id = 0")).select(F.col("vec_id").alias("item_id"), "score")
    return ranked(hits, DEPTH)


#: The words whose stems the questions of the queries have.
FORMS = {"licens": ["license", "licensed", "licenses", "licensing"], "version": ["version", "versions"], "thing": ["thing", "things", "thinged", "thinges", "thinging"], "worthless": ["worthless"]}
_RANKED = f"lexical AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM lx QUALIFY rank <= {DEPTH})"
_LEXICAL = f"{DOCUMENTS_SQL}, {index_sql({stem: [words] for stem, words in FORMS.items()})}, {_RANKED}"
_SEMANTIC = f"""sx AS (SELECT e.vec_id AS item_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0),
semantic AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM sx QUALIFY rank <= {DEPTH})"""


@query(f"WITH {_LEXICAL} SELECT item_id, score, rank FROM lexical")
def search_lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-2, RET-3: the best documents by keyword."""
    return _lexical(spark, sf_dir)


_PHRASES = {"licens version": [FORMS["licens"], FORMS["version"]], "mail1 exampl com": [["mail1"], ["example", "examples", "exampled"], ["com", "coms"]], "worthless": [["worthless"]]}


@query(f"WITH {DOCUMENTS_SQL}, {index_sql(_PHRASES)}, {_RANKED} SELECT item_id, score, rank FROM lexical")
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-1, RET-4: terms of several words are phrases; words are asked for by their stems and without marks."""
    return _lexical(spark, sf_dir, "Licenses_version mail1.example.com wörthless")


@query(f"WITH {_SEMANTIC} SELECT item_id, score, rank FROM semantic")
def search_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-5, RET-6: the best vectors by cosine, exactly."""
    return _semantic(spark, sf_dir)


@query(f"""WITH {_LEXICAL}, {_SEMANTIC}, u AS (SELECT item_id, rank, 'keyword' AS label FROM lexical UNION ALL SELECT item_id, rank, 'meaning' FROM semantic)
SELECT item_id, round(sum(1.0::DOUBLE / ({RRF} + rank)), 8) AS score, string_agg(label, '+' ORDER BY label) AS why FROM u GROUP BY item_id ORDER BY score DESC, item_id LIMIT 20""")
def search_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-8 to RET-10, TOOL-1: keyword and meaning fused by rank."""
    return fuse({"keyword": _lexical(spark, sf_dir), "meaning": _semantic(spark, sf_dir)}).orderBy(F.desc("score"), "item_id").limit(20)


@query(f"WITH {_SEMANTIC} SELECT label, max(score) AS score, count(*) AS chunks FROM semantic JOIN embeddings ON vec_id = item_id GROUP BY label")
def collapse_chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-7: chunk hits collapsed to their parents by best score."""
    parents = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return _semantic(spark, sf_dir).join(parents, "item_id").groupBy("label").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("chunks"))


def browse(items: DataFrame, *, newest: bool = True, limit: int = 20) -> DataFrame:
    """Items by time with the score 1 / rank and the reason."""
    order = [F.desc("t") if newest else F.asc("t"), F.asc("item_id")]
    rank = F.row_number().over(Window.orderBy(*order))
    return items.orderBy(*order).limit(limit).select("item_id", "t", F.round(1.0 / rank, 6).alias("score"), F.lit("most recent" if newest else "earliest").alias("why"))


@query(f"WITH {CHAT_SQL} SELECT item_id, t, round(1.0::DOUBLE / row_number() OVER (ORDER BY t DESC, item_id), 6) AS score, 'most recent' AS why FROM chat ORDER BY t DESC, item_id LIMIT 20")
def browse_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-1, TOOL-17: the newest items."""
    return browse(chat_items(spark, sf_dir))


@query(f"WITH {CHAT_SQL} SELECT item_id, t, round(1.0::DOUBLE / row_number() OVER (ORDER BY t, item_id), 6) AS score, 'earliest' AS why FROM chat ORDER BY t, item_id LIMIT 20")
def browse_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-1: the oldest items."""
    return browse(chat_items(spark, sf_dir), newest=False)


def overlapping(items: DataFrame, since: int | None, until: int | None, *, starts: str = "t", ends: str = "ends") -> DataFrame:
    """Items whose span meets the window; a bound that is not given does not filter."""
    out = items
    if since is not None:
        out = out.filter(F.coalesce(ends, starts) >= since)
    if until is not None:
        out = out.filter(F.col(starts) <= until)
    return out


_DAY = 86_400_000_000
_SINCE, _UNTIL = 880_000_000_000_000, 890_000_000_000_000


@query(f"SELECT o_orderkey AS item_id, epoch_us(o_orderdate) AS t, epoch_us(o_orderdate) + 30 * {_DAY} AS ends FROM orders WHERE coalesce(epoch_us(o_orderdate) + 30 * {_DAY}, epoch_us(o_orderdate)) >= {_SINCE} AND epoch_us(o_orderdate) <= {_UNTIL}")
def filter_overlap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-4 to FIL-6: orders whose span from order to due date meets a window."""
    from tidepool.sources.tables import micros

    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), micros("o_orderdate").alias("t")).withColumn("ends", F.col("t") + 30 * _DAY)
    return overlapping(items, _SINCE, _UNTIL)
