"""Edge cases of every training-data operator: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import knn, line_dedup, near_dedup, packing, pieces, pii, quality_classifier, quality_rules, secrets, suffix_tree

ROWS = [
    (1, "a plain text of some words that goes on for a while and then ends", "en", "s", 1),
    (1, "a plain text of some words that goes on for a while and then ends", "en", "s", 1),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (None, "no id here but words enough to be told apart from others", "fr", "t", 2),
    (4, "word " * 30_000, "en", "s", 3),
    (5, "\n\n", "en", "s", 4),
    (6, "x" * 70_000, "de", "s", 5),
    (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and mail a@b.org', "en", "s", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators add.
CLASH = ("n_lines", "n_dropped", "kept", "pii", "findings", "distance", "n_words", "start", "length", "component_id", "h", "salt", "lang_key", "source_key", "width", "own", "m_0", "v_0_0", "half", "drops", "lines", "row", "doc", "rep")
#: And like those that operators work with inside, or that need quoting.
HIDDEN = ("__r", "__q", "__keys", "__lines", "__drops", "__doc", "__least", "__text", "__path", "__found", "__scored", "__findings", "__scan_shown", "__pii", "__pii_text", "__pii_0", "__pii_all", "__pii_shown", "n_ids", "ids", "exact", "a.b", "kept_0", "k0", "given")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.withColumns({c: F.lit("own") for c in (*CLASH, *HIDDEN)})


OPERATORS = {
    "packing": lambda d: packing.pack_texts(d, "text", keep=["doc_id"]),
    "packing_clash": lambda d: packing.pack_texts(d, "text", keep=["doc_id", "start", "length"], with_ids=True),
    "packing_names": lambda d: packing.pack_texts(d, "text", keep=["a.b", "given", "k0", "ids", "__text"]),
    "packing_examples": lambda d: packing.pack_examples(d.withColumn("a.b", F.expr("transform(split(text, ' '), w -> length(w))")), "a.b", keep=["doc_id", "given", "text"], loss="a.b"),
    "pieces": lambda d: pieces.encode(d, keep=["doc_id"], check=True),
    "pieces_names": lambda d: pieces.encode(d, keep=["n_ids", "ids", "a.b", "text", "text", "k0"], check=True),
    "pieces_back": lambda d: pieces.decode(pieces.encode(d, keep=["doc_id", "a.b"]).withColumn("text", F.lit("own")), keep=["text", "a.b", "ids", "doc_id"]),
    "suffix_tree": lambda d: suffix_tree.score_texts(d, F.col("doc_id") > 2),
    "quality_rules": lambda d: quality_rules.reject_outliers(d),
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "near_dedup": lambda d: near_dedup.near_duplicates(d),
    "drop_near": lambda d: near_dedup.drop_near_duplicates(d),
    "quality_classifier": lambda d: quality_classifier.score_documents(d, d.select("doc_id").limit(2)),
    "secrets": lambda d: secrets.redact(d, secrets.fit(d)),
    "pii": lambda d: pii.find_pii(d),
    "pii_redact": lambda d: pii.redact(d),
}
#: Operators that give a row for each row.
SAME = ("pieces", "pieces_names", "pieces_back", "suffix_tree", "quality_rules", "line_dedup", "near_dedup", "quality_classifier", "secrets", "pii", "pii_redact")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges_and_empty_tables(spark, docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    if name in SAME:
        assert len(rows) == len(ROWS)
    assert len(set(out.columns)) == len(out.columns)
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["line_dedup", "drop_near", "secrets", "pii", "pii_redact"])
def test_columns_of_any_name_stay_as_they_are(docs, name):
    out = OPERATORS[name](docs)
    assert set(HIDDEN) <= set(out.columns) and set(docs.columns) <= set(out.columns)
    assert all(r[c] == "own" for r in out.collect() for c in HIDDEN)
    # The text may have such a name itself.
    odd = docs.drop("__text").withColumnRenamed("text", "__text")
    assert "__text" in {"line_dedup": lambda: line_dedup.dedup_lines(odd, "__text"), "drop_near": lambda: near_dedup.drop_near_duplicates(odd, "__text"), "secrets": lambda: secrets.redact(odd, secrets.Detector("0D", 1.0), "__text"), "pii": lambda: pii.find_pii(odd, "__text"), "pii_redact": lambda: pii.redact(odd, "__text")}[name]().columns


def test_kept_columns_of_pieces(docs):
    rows = OPERATORS["pieces_names"](docs).collect()
    assert rows[0].asDict().keys() == {"n_ids", "ids_crc32", "n_byte_ids", "exact", "ids", "a.b", "text", "k0"} and all(r["a.b"] == r["k0"] == "own" for r in rows)
    back = {r["doc_id"]: r for r in OPERATORS["pieces_back"](docs).collect()}
    assert back[7]["text"].startswith("token =") and back[2]["text"] == "" and len(back[4]["ids"]) > 20_000 and back[1]["a.b"] == "own"


def test_values_of_the_edges(docs):
    scored = {r["doc_id"]: r for r in suffix_tree.score_texts(docs, F.col("doc_id") > 2).collect()}
    assert scored[2]["n_tokens"] == scored[3]["n_tokens"] == 1 and scored[4]["n_tokens"] == 30_001
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, least_documents=2).collect()}
    assert lines[1]["text"] == "" and lines[1]["n_dropped"] == 1 and lines[5]["n_lines"] == 3 and lines[5]["n_dropped"] == 0 and lines[2]["text"] == ""
    near = near_dedup.near_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in near}
    assert by[2]["n_shingles"] == by[5]["n_shingles"] == 0 and by[4]["n_shingles"] == 1 and by[None]["component_id"] is None and all(r["kept"] for r in near)
    judged = {r["doc_id"]: r for r in quality_rules.reject_outliers(docs).collect()}
    assert judged[4]["base_failed"] and judged[2]["base_failed"] and not judged[1]["base_failed"]
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[7].endswith("mail [email]") and red[2] is None


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [300000.0, 0.0]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (9, [-0.001, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = knn.top_k(frame, frame.filter("vec_id % 50 = 0"))
    got = [tuple(r) for r in out.orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, 1, 6, 300000 * 256 * 256), (0, 2, 1, 128 * 256), (0, 3, 2, 128 * 256), (0, 4, 50, 0), (0, 5, 9, -256)] and len(got) == 10
    assert knn.top_k(frame.limit(0), frame.limit(0)).collect() == []
    # A query that is there twice is one query, and its copies are no candidates of it.
    twice = frame.union(frame.filter("vec_id = 0"))
    assert [tuple(r) for r in knn.top_k(twice, twice.filter("vec_id % 50 = 0")).filter("query_id = 0").orderBy("rank").collect()] == got[:5]
    # Outliers are multiplied out exactly and shown as the nearest long; what is not finite once scaled takes no part.
    far = frame.select("vec_id", "embedding").union(spark.createDataFrame([(60, [1e30, -1e30]), (61, [-1e18, 3.0]), (62, [1e307, 0.0])], "vec_id long, embedding array<double>"))
    rows = {r["vec_id"]: [int(np.floor(x * 256)) for x in r["embedding"]] for r in far.filter("vec_id IN (0, 50, 1, 2, 6, 9, 60, 61)").collect()}
    made = knn.top_k(far, far.filter("vec_id IN (0, 50, 60, 61, 62)"), search=knn.Search(shard_rows=2)).orderBy("query_id", "rank").collect()
    for q in (0, 50, 60, 61):
        scores = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)[:5]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in made if r["query_id"] == q] == [(n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    assert {r["query_id"] for r in made} == {0, 50, 60, 61}
