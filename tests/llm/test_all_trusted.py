"""The quality classifier learns from all trusted documents, whatever the size of its model."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.llm import quality_classifier


def test_all_trusted_documents_are_learnt_from(spark):
    documents = spark.range(12_000).select(F.col("id").alias("doc"), F.lit("en").alias("lang"), F.lit(9).alias("size"))
    trusted = documents.filter("doc < 11000").select("doc")
    chosen = {r["doc"] for r in quality_classifier.training_sample(documents, trusted, quality_classifier.Model()).collect()}
    held = {r["doc"] for r in trusted.filter("pmod(xxhash64(doc, 'held out'), 4) = 0").collect()}
    assert chosen == set(range(11_000)) - held and len(chosen) > 8000


def test_a_model_too_large_to_send_gives_the_same(spark):
    random.seed(7)
    rows = [(i % 90, "".join(random.choices(["ta", "ri", "mo", "é", " ", "\n"], k=random.randint(1, 60))), random.choice(["en", None])) for i in range(100)] + [(200, "zzz xq", "en"), (201, "", "en"), (202, None, "en"), (None, "ta ri", "en"), (5, "ta", "en"), (5, "ta", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = frame.filter("doc_id < 60").select("doc_id")
    dense, joined = (sorted((tuple(r) for r in quality_classifier.score_documents(frame, trusted, how=how).collect()), key=lambda r: (str(r[0]), str(r[1]), r[2], str(r[3]))) for how in (quality_classifier.Model(), quality_classifier.Model(most_cells=0)))
    assert len(dense) == len(rows)
    for one, other in zip(dense, joined):
        assert one[:3] == other[:3] and one[5] == other[5]
        assert one[3:5] == (pytest.approx(other[3], rel=1e-4) if other[3] is not None else None, pytest.approx(other[4], rel=1e-4))
