"""What a page changes, and what becomes of commitments and loops: on small tables and by brute force."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from tidepool.operators import items, promises

DAY, HOUR = promises.DAY, promises.HOUR


def rows(spark, given):
    """Items of (external_id, title, seen); the other columns are null."""
    frame = spark.createDataFrame(given, "external_id string, title string, seen int")
    kinds = {"body": "string", "author": "string", "participants": "array<string>", "starts": "long", "ends": "long", "state": "string", "due": "long", "recurrence": "string"}
    return frame.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}).withColumn("account_id", F.lit("a"))


def test_what_changes_is_derived_again(spark):
    empty = rows(spark, []).select(items.item_id(F.col("account_id"), F.col("external_id")).alias("item_id"), *items.CONTENT, F.lit("").alias("content_hash"), F.lit(1).cast("long").alias("deleted")).withColumns({c: F.lit(1).cast("long") for c in items.VERSIONS})
    first = items.upsert_items(empty, rows(spark, [("x", "one", 1), ("y", "two", 1), ("x", "one!", 2), ("z", None, 1), ("w", "w", 1)]))
    ids = {k: sha256(f"a\0{k}".encode()).hexdigest()[:24] for k in "xyzwv"}
    got = {r["item_id"]: r for r in first.collect()}
    assert got.keys() == {ids[k] for k in "xyzw"} and got[ids["x"]]["title"] == "one!" and all(r["change"] == "insert" and r["derived_version"] is None for r in got.values())
    derived = first.drop("change").withColumns({c: F.lit(4).cast("long") for c in items.VERSIONS}).withColumn("deleted", F.when(F.col("item_id") == ids["w"], F.lit(7).cast("long")))
    page = rows(spark, [("x", "one!", 3), ("y", "two, changed", 3), ("v", "new", 3), ("w", "w", 3)])
    second = items.upsert_items(derived, page)
    got = {r["item_id"]: (r["change"], r["title"], r["deleted"], r["derived_version"], r["episode_version"]) for r in second.collect()}
    assert got == {ids["x"]: ("unchanged", "one!", None, 4, 4), ids["y"]: ("update", "two, changed", None, None, None), ids["z"]: ("absent", None, None, 4, 4), ids["w"]: ("update", "w", None, None, None), ids["v"]: ("insert", "new", None, None, None)}
    # The same page again changes nothing.
    assert {r["change"] for r in items.upsert_items(second.drop("change"), page).collect()} == {"unchanged", "absent"}


def test_what_is_there_stays(spark):
    old = spark.createDataFrame([(1, 1, "kept")], "a long, b long, role string")
    new = spark.createDataFrame([(1, 1, "x", 0), (1, 2, "late", 5), (1, 2, "first", 2)], "a long, b long, role string, n int")
    assert {tuple(r) for r in items.insert_new(old, new, ["a", "b"], F.col("n")).collect()} == {(1, 1, "kept"), (1, 2, "first")}


def test_titles_alike_by_brute_force(spark):
    random.seed(6)
    made = [(i, random.randint(0, 2), random.choices(["common", "a", "b", "c", "d", "e", "f", "g"], weights=[9, 1, 1, 1, 1, 1, 1, 1], k=random.randint(0, 5))) for i in range(240)]
    left, right = made[:120], made[120:]
    frames = [spark.createDataFrame(x, "id long, part long, words array<string>") for x in (left, right)]
    got = {(r["part"], r["a"], r["b"], round(r["similarity"], 9)) for r in promises.alike_titles(*frames).collect()}
    want = set()
    for i, p, u in left:
        for j, q, v in right:
            if p == q and u and v and len(set(u) & set(v)) / len(set(u) | set(v)) >= 0.6:
                want.add((p, i, j, round(len(set(u) & set(v)) / len(set(u) | set(v)), 9)))
    assert got == want and len(want) > 50


def test_commitments_are_matched_scheduled_and_closed(spark):
    store = spark.createDataFrame([(1, "me", ["buy", "fish", "friday"], "stated", 10 * DAY, None, 0), (2, "me", ["buy", "fish"], "stated", None, 12 * DAY, 0), (3, "you", ["buy", "fish"], "stated", None, None, 10 * DAY), (4, "me", ["buy", "fish"], "done", None, None, 10 * DAY), (5, "me", ["buy", "fish"], "stated", 99 * DAY, None, 0)], "id long, owner string, words array<string>, state string, due long, occurs long, first_seen long")
    new = spark.createDataFrame([(7, "me", ["buy", "fish"], 11 * DAY), (8, "me", ["sell", "fish", "now"], 11 * DAY), (9, "me", [], 11 * DAY)], "id long, owner string, words array<string>, anchor long")
    assert [tuple(r) for r in promises.matched(new, store).collect()] == [(7, 2, 1.0)]
    events = spark.createDataFrame([(20, ["buy", "fish"], 9 * DAY), (21, ["buy", "fish"], 5 * DAY), (22, ["buy", "fish"], -30 * DAY), (23, ["fish", "market"], 6 * DAY)], "id long, words array<string>, t long")
    assert {tuple(r) for r in promises.scheduled(store.select("id", "words", "state", "due", "first_seen"), events).collect()} == {(1, 21, 5 * DAY), (2, 22, -30 * DAY), (3, 21, 5 * DAY)}
    evidence = spark.createDataFrame([(1, 50), (2, 51), (4, 50)], "id long, item long")
    tasks = spark.createDataFrame([(50, "task", "completed"), (51, "task", "open")], "item long, kind string, state string")
    assert [r["id"] for r in promises.closed(store, evidence, tasks).collect()] == [1]


def test_open_loops(spark):
    now = 100 * DAY
    said = [(1, 1, now - 3 * DAY, "inbound", 1), (2, 1, now - 9 * DAY, "outbound", 1), (3, 2, now - 3 * DAY, "inbound", 2), (4, 2, now - DAY, "outbound", 2), (5, 3, now - HOUR, "inbound", 3), (6, 4, now - 60 * DAY, "inbound", 4), (7, 5, now - 4 * DAY, "inbound", 5), (8, 6, now - 20 * DAY, "inbound", 6), (9, 7, now - 3 * DAY, "inbound", 7), (10, 7, now - 3 * DAY, "inbound", 7)]
    messages = spark.createDataFrame(said, "item long, thread long, t long, direction string, author long")
    people = spark.createDataFrame([(i, f"P{i}") for i in (1, 2, 3, 4, 5, 6)], "author long, name string")
    interests = spark.createDataFrame([(8, 0.6)], "item long, score double")
    found = promises.open_loops(messages, people, interests, now)
    assert {(r["dedup"], r["title"], r["salience"], tuple(r["evidence"])) for r in found.collect()} == {("unclosed:1", "P1 is waiting on a reply", round(0.35 + 3 / 14 * 0.15 + 0.2, 6), (1,)), ("unclosed:6", "P6 is waiting on a reply", 0.65, (8,))}
    store = promises.write_observations(spark.createDataFrame([], "id string, dedup string, title string, salience double, state string"), found, "unclosed_loop", "me")
    dismissed = store.withColumn("state", F.lit("dismissed")).withColumn("salience", F.lit(0.1))
    bare = found.withColumn("evidence", F.array().cast("array<long>")).withColumn("dedup", F.lit("nothing to show"))
    again = {r["dedup"]: (r["state"], r["created"], r["salience"]) for r in promises.write_observations(dismissed, found.unionByName(bare), "unclosed_loop", "me").collect()}
    assert again == {"unclosed:1": ("dismissed", False, round(0.35 + 3 / 14 * 0.15 + 0.2, 6)), "unclosed:6": ("dismissed", False, 0.65)}
