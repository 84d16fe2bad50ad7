"""The positional index: stems, marks, phrases and frequent terms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepool.operators import index
from tidepool.stems import changed, folded_names, plain, porter

# Examples of the algorithm's steps, from its description.
STEMS = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "effective": "effect", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "at": "at", "": "", "x" * 70 + "ing": "x" * 70 + "ing"}


def test_stems():
    assert {w: porter(w) for w in STEMS} == STEMS
    assert plain("Żółć İstanbul čeština é") == "Zołc Istanbul cestina e"


def test_words_change_once_per_batch_and_nulls_stay(spark):
    frame = spark.createDataFrame([(1, ["Łódź", None, "é"], "a.b"), (2, None, None), (3, [], "é")], "`a.b` int, words array<string>, text string")
    out = changed(changed(frame, "words", plain), "text", str.upper).collect()
    assert [tuple(r) for r in out] == [(1, ["Łodz", None, "e"], "A.B"), (2, None, None), (3, [], "É")]
    names = spark.createDataFrame([("Škoda-Novák!",), (None,), ("D'Ámato 2",)], "n string")
    assert [r[0] for r in folded_names(names, "n").collect()] == ["skoda-novak", None, "d'amato 2"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    random.seed(9)
    words = ["jump", "jumps", "jumped", "over", "café", "cafe", "fox", "a", "is", "mail", "example", "org"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 40))) for _ in range(300)]
    texts += ["write to Pat@Example.org, or pat example", "Example pat org", None, "", "the the the the", "JUMPING, over!"]
    path = str(tmp_path_factory.mktemp("index"))
    frame = spark.createDataFrame(list(enumerate(texts)), "item_id long, body string").withColumn("extra", F.lit(1))
    index.write_index(frame, path)
    return path, texts


def by_definition(texts, question):
    """{item: {phrase: frequency}}."""
    out = {}
    for i, text in enumerate(texts):
        said = [porter(plain(w)) for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        for p in {index.phrase(t) for t in index.match_terms(question)}:
            n = sum(tuple(said[k : k + len(p)]) == p for k in range(len(said)))
            if n:
                out.setdefault(i, {})[" ".join(p)] = n
    return out


@pytest.mark.parametrize("question", ["jumping", "cafés over", "jumps_over", "pat@example.org", "the_the", "jump jumped fox", "org.mail café_fox", "nothing"])
def test_phrases_by_definition(spark, store, question):
    path, texts = store
    got = {}
    for r in index.matched(spark, path, question).collect():
        got.setdefault(r["item_id"], {})[r["phrase"]] = r["f"]
        assert r["weight"] == Counter(index.phrase(t) for t in index.match_terms(question))[tuple(r["phrase"].split())]
    assert got == by_definition(texts, question)


def test_scope_narrows_hits_and_keeps_scores(spark, store):
    path, _ = store
    every = {r["item_id"]: r["score"] for r in index.indexed_bm25(spark, path, "jumping fox").collect()}
    some = {r["item_id"]: r["score"] for r in index.indexed_bm25(spark, path, "jumping fox", spark.range(50).withColumnRenamed("id", "item_id")).collect()}
    assert some == {i: s for i, s in every.items() if i < 50} and len(some) > 10
    assert index.indexed_bm25(spark, path, "?!").collect() == []


def test_an_empty_store(spark, tmp_path):
    index.write_index(spark.createDataFrame([], "item_id long, body string"), str(tmp_path))
    assert index.indexed_bm25(spark, str(tmp_path), "jump").collect() == []
