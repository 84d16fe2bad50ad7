"""The pipeline's stages after the classifier against brute force, from what the classifier kept."""

import collections
import re

import pytest

import corpus_pipeline
from tidepool.plans.lineage import cut

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        out.append(docs)
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_classifier_keeps_clean_documents(spark, stages):
    kept = set(texts(stages[0]))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) < 0.5 * len(bad)


def test_later_stages_by_brute_force(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before = texts(stages[0])
    keys = {d: [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in t.split("\n")] for d, t in before.items()}
    found = collections.Counter(k for own in keys.values() for k in set(own) if k)
    lines = {d: "\n".join(x for x, k in zip(t.split("\n"), keys[d]) if not k or found[k] < 10) for d, t in before.items()}
    assert texts(stages[1]) == lines

    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(t.translate(LOWER))) else frozenset() for d, t in lines.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    apart = {d: lines[d] for d in ids if root(d) == d}
    assert texts(stages[2]) == apart

    clean = texts(stages[3])
    assert clean.keys() == apart.keys()
    for d, t in apart.items():
        expected = re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[secret]\2", t)
        assert clean[d] == expected

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sums = collections.Counter()
    for r in stages[4].collect():
        sums[r["doc_id"]] += r["length"]
    assert sums == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}


ROWS = [
    (0, "a plain text of some words that goes on for a while and then ends", "en", "s", 1),
    (0, "a plain text of some words that goes on for a while and then ends", "en", "s", 1),
    (1, None, "en", None, None),
    (2, "", None, "s", 0),
    (None, "no id here but words enough to be told apart from others", "fr", "t", 2),
    (3, "word " * 20_000, "en", "s", 3),
    (4, "\n\n", "en", "s", 4),
    (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and mail a@b.org in a line of words', "en", "s", 6),
]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_stand_nulls_repeats_and_other_columns(spark, at):
    from pyspark.sql import functions as F

    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("own") for c in ("kept", "start", "n_lines", "__doc", "findings", "salt")})
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    if name == corpus_pipeline.STAGES[-1][0]:
        assert {r["doc_id"] for r in rows} == {0, 1, 2, None, 3, 4, 5}
        return
    assert out.columns == corpus_pipeline.COLUMNS
    # Copies of one document are all that goes, and only where near copies are looked for.
    expected = [0, 1, 2, 3, 4, 5] if name == "near_dedup" else [0, 0, 1, 2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == expected and sum(r["doc_id"] is None for r in rows) == 1
    if name == "secret_scan":
        assert {r["doc_id"]: r["text"] for r in rows}[5].startswith('token = "[secret]" and mail')
