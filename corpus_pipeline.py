"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import line_dedup, near_dedup, packing, quality_classifier, secrets
from tidepool.plans.lineage import cut
from tidepool.llm.queries import trusted_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity is above their language's threshold.

    Rows that share an id share the verdict; rows without an id are judged by a
    hash of their text.
    """
    key = F.coalesce("doc_id", F.xxhash64("text"))
    keyed = docs.withColumn("__key", key)
    judged = quality_classifier.score_documents(keyed, trusted_ids(spark, sf_dir), doc="__key")
    rejected = judged.filter("NOT kept").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(rejected, "__key", "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents share."""
    return _columns(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS), how=near_dedup.Sketching(words=5)).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return _columns(secrets.redact(docs, secrets.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096, a row per piece."""
    return packing.pack_texts(docs, "text", keep=["doc_id"])


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("secret_scan", secret_scan), ("packing", pack)]
#: Models, sketches and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
