"""Streaming sessions: out of order, repeated, late and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators.sessions import GAP
from tidepool.sources import dav
from tidepool.streaming import derived, passes, sessions


def batch(rows, gap=GAP):
    out = []
    for thread in sorted({r[1] for r in rows}):
        times = sorted(r[2] for r in {r for r in rows if r[1] == thread})
        runs = [[times[0]]]
        for t in times[1:]:
            runs.append([t]) if t - runs[-1][-1] > gap else runs[-1].append(t)
        out += [(thread, r[0], r[-1], len(r)) for r in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_repeats_and_restarts_give_the_batch_s_sessions(spark, tmp_path, seed):
    random.seed(seed)
    rows = [(i, random.randint(1, 3), 1_700_000_000_000_000 + random.randint(0, 200) * GAP // 3) for i in range(120)]
    delivered = rows + random.sample(rows, 30)
    random.shuffle(delivered)
    schema = "item_id long, thread_id long, t long"
    for n, part in enumerate((delivered[:60], delivered[60:100], delivered[100:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        # Each round starts a new query from the checkpoint of the one before.
        sessions.stream_into(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source"), str(tmp_path))
    got = sorted(tuple(r) for r in sessions.current(spark, str(tmp_path)).collect())
    assert got == batch(rows)


def test_an_item_between_two_sessions_joins_them():
    made = []
    for t in (0, 2 * GAP, GAP):
        made = sessions.place(made, t)
    assert made == [(0, 2 * GAP, 3)]


def deliveries(seed):
    """(item_id, thread_id, stream, t, version, deleted) in a random order, some twice; of items with several versions the last counts."""
    random.seed(seed)
    rows = []
    for i in range(150):
        thread = random.randint(1, 4) if i < 140 else 9
        for version in range(random.choice([1, 1, 2, 3])):
            rows.append((i, thread, f"s{thread % 2}", 1_700_000_000_000_000 + random.randint(0, 300) * GAP // 3, version, (version > 0 and random.random() < 0.3) or (thread == 9 and version == 2)))
    rows += [(i, 9, "s1", 1_700_000_000_000_000, 7, True) for i in range(140, 150)]
    rows += random.sample(rows, 40)
    random.shuffle(rows)
    return rows


def by_definition(rows):
    last = {}
    for r in rows:
        if r[0] not in last or r[4] >= last[r[0]][4]:
            last[r[0]] = r
    return batch([(r[0], r[1], r[3]) for r in last.values() if not r[5]])


@pytest.mark.parametrize("seed", [3, 4])
def test_deriving_dirty_threads_equals_deriving_all(spark, tmp_path, seed):
    rows, store = deliveries(seed), str(tmp_path)
    source = spark.readStream.schema(derived.ITEM).option("maxFilesPerTrigger", 1)

    def arrive(part):
        spark.createDataFrame(part, derived.ITEM).coalesce(1).write.mode("append").parquet(f"{store}/source")

    def fail(items):
        raise RuntimeError("stopped while a batch is derived")

    arrive(rows[:80])
    derived.advance(source.parquet(f"{store}/source"), store)
    arrive(rows[80:150])
    # The items of this batch are written when it stops, and written again by the run that goes on.
    with pytest.raises(Exception, match="stopped while"):
        derived.advance(source.parquet(f"{store}/source"), store, derive=fail)
    for part in (rows[150:151], rows[151:]):
        arrive(part)
        derived.advance(source.parquet(f"{store}/source"), store)
    now, again = ({tuple(r) for r in df.select("thread_id", "episode", "starts", "ends", "items").collect()} for df in (derived.current(spark, store), derived.rebuilt(spark, store)))
    assert now == again and derived.current(spark, store).count() == len(now)
    assert sorted((r[0], *r[2:]) for r in now) == by_definition(rows)
    found = {r["stream"]: (r["newest"], r["oldest"]) for r in derived.cursors(spark, store).collect()}
    assert found == {s: (max(r[3] for r in rows if r[2] == s), min(r[3] for r in rows if r[2] == s)) for s in ("s0", "s1")}


def test_phases(spark):
    day, now = derived.DAY, 1000 * derived.DAY
    found = spark.createDataFrame([("new", now, now - day), ("recent", now, now - 90 * day), ("done", now, now - 200 * day)], "stream string, newest long, oldest long")
    assert {r["stream"]: tuple(r)[1:] for r in derived.phases(found, now).collect()} == {"new": (False, False, False), "recent": (True, False, True), "done": (True, True, False)}
    assert {r["stream"]: r["needs_history"] for r in derived.phases(found, now, floor=0).collect()} == {"new": False, "recent": True, "done": True}


def test_attempts_are_counted_once_and_given_up_after_three(spark, tmp_path):
    schema = "attempt long, item long, tier int, ok boolean"
    log = [(1, 1, 1, False), (2, 1, 2, True), (3, 2, 1, False), (4, 2, 2, False), (5, 2, 3, False), (6, 3, 1, False), (7, 4, 3, False), (8, 5, 0, True), (3, 2, 1, False), (6, 3, 1, False)]
    want = {1: (1, 2, "done"), 2: (3, 3, "given_up"), 3: (1, 2, "retry"), 4: (1, 3, "retry"), 5: (0, 0, "done")}
    assert {r["item"]: tuple(r)[1:] for r in passes.outcomes(spark.createDataFrame(log, schema)).collect()} == want
    random.seed(1)
    random.shuffle(log)
    for part in (log[:4], log[4:7], log[7:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        passes.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source"), str(tmp_path))
    assert {r["item"]: tuple(r)[1:] for r in passes.states(spark, str(tmp_path)).collect()} == want


def test_a_pass_has_a_budget(spark):
    items = spark.createDataFrame([(i, i // 2, i % 3 == 0) for i in range(20)] + [(99, 99, None)], "item long, t long, good boolean")
    got = {r["item"]: r["verdict"] for r in passes.candidates(items, F.col("good"), 2, pool=12).collect()}
    assert got == {99: "uninteresting", 18: "candidate", 19: "uninteresting", 16: "uninteresting", 17: "uninteresting", 14: "uninteresting", 15: "candidate", 13: "uninteresting", 10: "uninteresting", 11: "uninteresting", 8: "uninteresting"}


def test_answers_of_servers(spark):
    head = '<?xml version="1.0"?><multistatus xmlns="DAV:">'
    found = "<response><href>/a</href><propstat><prop><getetag>W/\"1\"</getetag></prop><status>HTTP/1.1 200 OK</status></propstat></response>"
    bare = "<X:multistatus xmlns:X='DAV:' xmlns:k='urn:ietf:params:xml:ns:carddav'><X:response><X:href>/b</X:href><X:propstat><X:prop><k:address-data>BEGIN:VCARD&#10;FN:A &amp; B</k:address-data></X:prop><X:status>HTTP/1.1 200 OK</X:status></X:propstat></X:response><X:response><X:href>/c</X:href><X:status>HTTP/1.1 404 Not Found</X:status></X:response></X:multistatus>"
    frame = spark.createDataFrame([(1, f"{head}{found}</multistatus>"), (2, bare), (3, f"{head}</multistatus>"), (4, "no <xml"), (5, None)], "n int, `a.x` string")
    got = {(r["n"], r["href"], r["etag"], r["card"], r["gone"]) for r in dav.resources(frame, "a.x").collect()}
    assert got == {(1, "/a", 'W/"1', None, False), (2, "/b", None, "BEGIN:VCARD\nFN:A & B", False), (2, "/c", None, None, True)}
