"""A positional inverted index of a store, and what a question finds in it.

A posting is (term, item, frequency, the item's length, positions); terms are
stems without marks.  Postings are made where the texts are, batch by batch,
and shuffled once, by ranges of (bucket, term, item), so a frequent term is cut
into as many pieces as it needs.  A question reads the folders of its own
buckets, and of their files the row groups that hold its terms.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.plans.lineage import scratch
from tidepool.sources.tables import document_items
from tidepool.stems import indexed

#: BM25 as full-text indexes have it.
K1, B = 1.2, 0.75
#: Items per bucket of terms, and how many buckets there are at least and at most.
ITEMS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 16, 4096
#: Words handled in one go.
SLICE_WORDS = 500_000


def index_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), "")


def match_terms(question: str) -> list[str]:
    """The distinct terms of a question: letters, digits and _ @ . together, longer than one character."""
    composed = unicodedata.normalize("NFC", question.lower())
    kept = "".join(c if c.isalnum() or c in "_@." else " " for c in composed).split()
    return list(dict.fromkeys(t for t in kept if len(t) > 1))


def phrase(term: str) -> tuple[str, ...]:
    """The stems of a term: more than one, next to each other, where it has a mark inside, as addresses have."""
    words = "".join(c if c.isalnum() else " " for c in term.lower()).split()
    return tuple(indexed(w) for w in words)


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (item_id, words): a row for each item and term."""
    stem = lru_cache(maxsize=1 << 16)(indexed)
    for batch in batches:
        words = batch.column("words")
        ends = words.offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            last = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_WORDS, "right")) - 1)
            coded = words.values.slice(ends[at], ends[last] - ends[at]).dictionary_encode()
            stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            code = stems.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            sizes = np.diff(ends[at : last + 1])
            row, place = np.repeat(np.arange(at, last), sizes), np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((place, code, row))
            row, code, place = row[order], code[order], place[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(code, prepend=-1).astype(bool))
            bounds = np.append(starts, len(row)).astype(np.int32)
            parts = [batch.column("item_id").take(pa.array(row[starts])), stems.dictionary.take(pa.array(code[starts])), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sizes[row[starts] - at].astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(parts, names=["item_id", "term", "f", "length", "positions"])
            at = last


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(items: DataFrame, path: str, *, text: str = "body") -> None:
    """RET-1: the index of (item_id, text), under ``path``: ``terms``, a folder per bucket, and ``size``, one row."""
    n = items.count()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-n // ITEMS_A_BUCKET)))
    kind = items.select("item_id").schema[0].dataType.simpleString()
    words = items.select("item_id", F.coalesce(index_words(F.col(text)), F.array().cast("array<string>")).alias("words"))
    made = words.mapInArrow(_postings, f"item_id {kind}, term string, f long, length long, positions array<int>").withColumn("bucket", _bucket(F.col("term"), buckets))
    made.repartitionByRange("bucket", "term", "item_id").sortWithinPartitions("bucket", "term", "item_id").write.partitionBy("bucket").parquet(f"{path}/terms")
    total = items.sparkSession.read.schema("f long, bucket int").parquet(f"{path}/terms").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("words")) if n else items.sparkSession.range(1).select(F.lit(0).alias("words"))
    total.select(F.lit(n).cast("long").alias("n"), (F.col("words") / F.lit(max(n, 1))).alias("mean"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/size")


def _shifted(places: Column, ahead: int) -> Column:
    return F.transform(places, lambda x: x - ahead)


def matched(spark: SparkSession, path: str, question: str) -> DataFrame:
    """(item_id, phrase, weight, f, length): how often each of the question's phrases stands in each item; weight is how often it is asked for."""
    asked = Counter(p for p in map(phrase, match_terms(question)) if p)
    stems = sorted({s for p in asked for s in p})
    size = spark.read.parquet(f"{path}/size").first()
    nothing = spark.range(0).select(F.lit(0).cast("long").alias("item_id"), F.lit("").alias("phrase"), F.lit(0).alias("weight"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("length"))
    if not stems or not size["n"]:
        return nothing
    held = spark.read.parquet(f"{path}/terms").filter(F.col("bucket").isin(*[_bucket(F.lit(s), size["buckets"]) for s in stems]) & F.col("term").isin(*stems))
    weights = F.create_map(*[F.lit(x) for p, n in asked.items() for x in (" ".join(p), n)])
    single = [p[0] for p in asked if len(p) == 1]
    parts = [held.filter(F.col("term").isin(*single)).select("item_id", F.col("term").alias("phrase"), "f", "length")] if single else []
    for p in (p for p in asked if len(p) > 1):
        # RET-4: places of the first word behind which all others stand in order.
        met = held.filter(F.col("term").isin(*p)).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("length").alias("length")).filter(F.size("at") == len(set(p)))
        starts = F.col("at")[p[0]]
        for ahead, word in enumerate(p[1:], 1):
            starts = F.array_intersect(starts, _shifted(F.col("at")[word], ahead))
        parts.append(met.select("item_id", F.lit(" ".join(p)).alias("phrase"), F.size(starts).cast("long").alias("f"), "length").filter("f > 0"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.select("item_id", "phrase", weights[F.col("phrase")].alias("weight"), "f", "length")


def indexed_bm25(spark: SparkSession, path: str, question: str, within: DataFrame | None = None) -> DataFrame:
    """RET-2, RET-3: (item_id, score) of the items that hold a phrase of the question; ``within`` are the items that may be found.

    Frequencies of phrases are those of the whole store, whoever asks.
    """
    hits = matched(spark, path, question)
    # One row per asked phrase, one row of totals.
    counts = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("d"))
    found = hits if within is None else hits.join(within.select("item_id"), "item_id", "left_semi")
    joined = found.join(F.broadcast(counts), "phrase").crossJoin(F.broadcast(spark.read.parquet(f"{path}/size")))
    idf = F.greatest(F.log((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(1e-6))
    part = F.col("weight") * idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy("item_id").agg(F.round(F.sum(part), 6).alias("score"))


_MADE: dict[tuple[str, str], str] = {}


def store_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of the documents' index, written once by an application and read by all of its questions."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        path = scratch(spark, "index")
        write_index(document_items(spark, sf_dir).select("item_id", "body"), path)
        _MADE[key] = path
    return _MADE[key]


# --- the same in SQL ------------------------------------------------------------


def index_sql(phrases: dict[str, list[list[str]]], items: str = "items") -> str:
    """Common tables of DuckDB SQL that score ``items`` (item_id, body): ``lx`` has item_id and score.

    ``phrases``: for each, the lists of word forms that may stand at its places.
    """
    forms = ", ".join(f"('{name}', {place}, '{form}')" for name, places in phrases.items() for place, words in enumerate(places) for form in words)
    sizes = ", ".join(f"('{name}', {len(places)})" for name, places in phrases.items())
    return f"""tok AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(body, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') AS w FROM {items}), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
forms(phrase, place, form) AS (VALUES {forms}), places(phrase, many) AS (VALUES {sizes}),
said AS (SELECT item_id, len(w) AS length, strip_accents(unnest(w)) AS word, generate_subscripts(w, 1) AS spot FROM tok),
starts AS (SELECT item_id, length, phrase, spot - place AS first, count(*) AS met FROM said JOIN forms ON form = word GROUP BY ALL),
f AS (SELECT item_id, length, phrase, count(*) AS f FROM starts JOIN places USING (phrase) WHERE met = many GROUP BY ALL), d AS (SELECT phrase, count(*) AS d FROM f GROUP BY phrase),
lx AS (SELECT item_id, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * length / mean))), 6) AS score FROM f JOIN d USING (phrase), st GROUP BY item_id)"""
