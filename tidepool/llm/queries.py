"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import chat, hard_negatives, knn, line_dedup, merkle, near_dedup, packing, pieces, pii, quality_classifier, quality_rules, secrets, suffix_tree


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    return packing.pack_texts(_read(spark, sf_dir, "documents"), "text", keep=["doc_id"])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and whether decoding gives their texts again."""
    return pieces.encode(_read(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False, check=True)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a suffix tree learnt from nine tenths of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    scored = suffix_tree.score_texts(_read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents held against the robust estimates of their language and source."""
    judged = quality_rules.reject_outliers(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "distance")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    deduped = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return line_dedup.digest(deduped, "doc_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, grouped by similarity of their word shingles."""
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good."""
    return _read(spark, sf_dir, "labels").filter("quality = 1 AND NOT toxic <=> 1").select("doc_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of all documents under a model of the trusted ones."""
    return quality_classifier.score_documents(_read(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of largest inner product for every vector whose id is divisible by 50."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by a forest trained on their labelled findings."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.digest(secrets.scan(documents, secrets.fit(documents)), "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in the chat template, and one that says the template's own marks, read back from the formatted texts."""
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.FORGED).alias("text"))
    messages = given.unionByName(forged).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digest(chat.format_conversations(messages))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100, and each of its five positives, the five hardest negatives."""
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=hard_negatives.label_of())


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document in a manifest of all, held against documents some of which have been tampered with."""
    changed, where = merkle.tampering()
    return merkle.prove_rows(_read(spark, sf_dir, "documents"), merkle.COLUMNS, changed=changed, where=where)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_sentencepiece": op2_sentencepiece, "op3_lm_score": op3_lm_score, "op4_quality_rules": op4_quality_rules, "op5_line_dedup": op5_line_dedup, "op6_near_dedup": op6_near_dedup, "op7_quality_classifier": op7_quality_classifier, "op8_top_k": op8_top_k, "op9_secret_scan": op9_secret_scan, "op10_pii": op10_pii, "op11_chat_format": op11_chat_format, "op12_hard_negatives": op12_hard_negatives, "op13_merkle": op13_merkle}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.oracle_sql(), "op8_top_k": knn.oracle_sql(), "op11_chat_format": chat.oracle_sql(), "op12_hard_negatives": hard_negatives.oracle_sql(), "op13_merkle": merkle.oracle_sql()}
