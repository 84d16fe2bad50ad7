"""Tools with the gate inside, names of handles, merchants alike, nodes of items: on small tables."""

import random

from pyspark.sql import functions as F

from tidepool.operators import facts, merchants, search, tools


def test_items_pass_scope_and_gate(spark):
    rows = [(1, "plain words", "ben", "own", None), (2, "my password: hunter2hunter2", "ben", "own", None), (3, "theirs", "ann", "own", None), (4, "shared", "ann", "household", None), (5, None, "ben", "own", None), (6, "gone", "ben", "own", 6), (7, "not asked for", "ben", "own", None)]
    items = spark.createDataFrame(rows, "item_id long, body string, custodian string, visibility string, deleted long").withColumn("kind", F.lit("message"))
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "item_id long")
    got = {r["item_id"]: r["text"] for r in tools.show_items(items, asked, search.Scope(principal="ben")).collect()}
    assert got.keys() == {1, 2, 4, 5} and got[1] == "plain words" and got[2] != rows[1][1] and got[5] is None


def test_episodes_belong_to_who_has_the_account(spark):
    episodes = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s9"), (4, None)], "episode long, stream string")
    streams = spark.createDataFrame([("s1", 1), ("s2", 2)], "stream string, account_id long")
    accounts = spark.createDataFrame([(1, "ann"), (2, "ben")], "account_id long, custodian string")
    assert [r["episode"] for r in tools.visible_episodes(episodes, streams, accounts, "ann").collect()] == [1]


def test_handles_have_the_best_name_there_is(spark):
    identifiers = spark.createDataFrame([("a", "email", "a@x.org", 1.0, 1), ("a", "name", "annie", 0.6, 9), ("b", "phone", "+15550100", 1.0, 1), ("b", "name", "rare", 0.9, 1), ("b", "name", "often", 0.6, 99), ("c", "email", "c@x.org", 1.0, 1), ("d", "email", "a@x.org", 1.0, 1)], "entity string, kind string, normalized string, confidence double, occurrences long")
    people = spark.createDataFrame([("a", "Ann"), ("b", "+1 555 0100"), ("c", None)], "entity string, name string")
    handles = spark.createDataFrame([("a@x.org",), ("+15550100",), ("c@x.org",), ("who@x.org",), ("a@x.org",)], "handle string")
    assert {tuple(r) for r in tools.handle_names(handles, identifiers, people).collect()} == {("a@x.org", "Ann"), ("+15550100", "rare"), ("c@x.org", "c@x.org"), ("who@x.org", "who@x.org")}


def test_subjects_are_episodes_or_items(spark):
    items = spark.createDataFrame([(1, "message"), (2, "message"), (3, "contact"), (4, "message")], "item long, kind string")
    episodes, out = spark.createDataFrame([(2, 7), (4, 7)], "item long, episode long"), spark.createDataFrame([(4,)], "item long")
    assert {tuple(r) for r in tools.lifted(items, episodes, out).collect()} == {(1, "item:1"), (2, "episode:7")}
    assert {tuple(r) for r in tools.considered(items, episodes, out).collect()} == {(2, "in an episode"), (3, "contact"), (4, "template")}
    members = spark.createDataFrame([("s", "item:1"), ("s", "episode:7"), ("t", "item:9")], "situation string, node string")
    nodes = spark.createDataFrame([("item:1", 1), ("episode:7", 2), ("episode:7", 1)], "node string, item long")
    assert {tuple(r) for r in tools.situation_items(members, nodes).collect()} == {("s", 1), ("s", 2)}
    assert {tuple(r) for r in tools.threads_for(members, nodes.select("node")).collect()} == {("item:1", "s"), ("episode:7", "s")}


def test_vectors_of_unit_length(spark):
    chunks = spark.createDataFrame([(1, 1, [9.0, 9.0]), (1, 0, [3.0, 4.0]), (2, 0, [0.0, 0.0]), (3, 0, None)], "item long, ordinal int, vector array<double>")
    assert {r["item"]: r["vector"] for r in tools.first_vectors(chunks).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}


def test_keys_that_are_one_merchant_s(spark):
    random.seed(8)
    keys = {"".join(random.choices("ab", k=random.randint(8, 16))) for _ in range(300)} | {"supplier00000000" + "x" * k for k in range(7)}
    got = {(r["a"], r["b"]) for r in merchants.alike(spark.createDataFrame([(k,) for k in [*keys, *list(keys)[:20]]], "key string")).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and b.startswith(a) and len(a) >= 12 and len(b) - len(a) <= 3}


def test_facts_for_a_prompt(spark):
    rows = [(1, "a", "routine", "runs", "confirmed", 0.9), (1, "b", "constraint", "no nuts", "confirmed", 0.5), (1, "c", "other", "x", "confirmed", 1.0), (1, "d", "constraint", "no eggs", "confirmed", 0.8), (1, "e", "constraint", "old", "rejected", 1.0), (2, "f", None, "y", "proposed", 1.0)]
    frame = spark.createDataFrame(rows, "principal long, id string, kind string, statement string, state string, confidence double")
    assert [r["line"] for r in facts.facts_for_prompt(frame).orderBy("place").collect()] == ["(constraint) no eggs", "(constraint) no nuts", "(routine) runs", "(other) x"]
    assert {tuple(r) for r in facts.fact_counts(frame).collect()} == {(1, 4, 0, 1), (2, 0, 1, 0)}
