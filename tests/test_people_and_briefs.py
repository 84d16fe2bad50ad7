"""Aliases, the owner, briefs, facts, detectors and situations: what has to hold, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import aliases, briefs, detectors, facts, owner, situations

DAY, HOUR = 86_400_000_000, 3_600_000_000


@pytest.fixture(scope="module")
def names(spark):
    people = spark.createDataFrame([("e1", "Esperanza Duprée", ["Izzy B."]), ("e2", "Robert Smith", None), ("e3", "Óscar", []), ("e4", "Bo Li", []), ("e5", None, None), ("e6", "Ubisoft Account Support", []), ("e7", "Jess Jess", ["Bob"])], "entity string, name string, stated array<string>")
    out = {}
    for r in aliases.aliases(people).collect():
        assert r["alias"] not in out.setdefault(r["entity"], {})
        out[r["entity"]][r["alias"]] = r["origin"]
    return people, out


def test_aliases(names):
    _, out = names
    essy = out["e1"]
    assert essy["izzy b"] == "stated" and essy["esperanza"] == "given" and essy["dupree"] == "family" and essy["bella"] == "derived"
    assert {"essy", "ess", "ezzy", "ezz", "esp", "espy", "esppie", "espe", "espei"} <= set(essy) and "es" not in essy and "esy" not in essy
    assert {"bob", "rob", "robby", "robert", "smith", "robe"} <= set(out["e2"]) and "smithy" not in out["e2"] and "roberty" not in out["e2"]
    assert out["e3"]["oscar"] == "given" and {"ozzy", "ossy", "osca"} <= set(out["e3"])
    # Names shorter than three letters have no short forms, and only full words count.
    assert set(out["e4"]) == {"bo", "li"} and "e5" not in out
    assert out["e7"]["bob"] == "stated" and out["e7"]["jess"] == "given" and "family" not in out["e7"].values()
    assert all(2 <= len(a) <= 40 for own in out.values() for a in own)


@pytest.mark.parametrize("question, found", [("essy", ["e2", "e1"]), ("  ESSY ", ["e2", "e1"]), ("Dupree", ["e1"]), ("bo", ["e7", "e2", "e4"]), ("e3", ["e3"]), ("essy@example.com", ["e2"]), ("(610) 555-0134", ["e4"]), ("nobody", []), ("!!", [])])
def test_people_by_short_names(spark, names, question, found):
    people, _ = names
    items = spark.createDataFrame([("e1", 5), ("e2", 7), ("e3", 1), ("e4", 2), ("e6", 99), ("e7", 9)], "entity string, items long")
    identifiers = spark.createDataFrame([("e2", "essy@example.com"), ("e4", "+16105550134"), ("e6", None)], "entity string, normalized string")
    hits = aliases.lookup(people.join(items, "entity").drop("stated"), aliases.aliases(people), identifiers, question)
    assert [r["entity"] for r in hits.collect()] == found


def test_the_owner_is_found_through_any_number_of_people(spark):
    accounts = spark.createDataFrame([("Me+x@Gmail.com",), ("iMessage",)], "label string")
    handles = spark.createDataFrame([("phone", "(610) 555-0134"), ("email", "own@x.org"), ("email", "no address")], "kind string, value string")
    sent = spark.createDataFrame([("Me <sent@y.org>", 1), ("Me <sent@y.org>", 9), (None, 2), ("+1 610 555 0199", 3)], "author string, t long")
    anchors = owner.owner_anchors(accounts, handles, sent)
    assert {(r["kind"], r["normalized"], r["origin"]) for r in anchors.collect()} == {("email", "me@gmail.com", "account"), ("phone", "+16105550134", "handle"), ("email", "own@x.org", "handle"), ("email", "sent@y.org", "author")}
    held = [("a", "email", "me@gmail.com"), ("b", "phone", "+16105550134"), ("b", "email", "b@x.org"), ("c", "email", "b@x.org"), ("c", "email", "c@x.org"), ("d", "email", "c@x.org"), ("e", "name", "me"), ("a", "name", "me"), ("f", "email", "f@x.org"), ("g", "email", None)]
    found = owner.owners(spark.createDataFrame(held, "entity string, kind string, normalized string"), anchors)
    assert {r["entity"]: r["is_self"] for r in found.collect()} == {"a": True, "b": True, "c": True, "d": True, "e": False, "f": False, "g": False}
    people = spark.createDataFrame([("a", "A", False), ("c", "Chosen", True), ("d", "Later", True), ("f", "F", True)], "entity string, name string, pinned boolean")
    merged = {r["entity"]: (r["merged_into"], r["name"]) for r in owner.merged_people(people, found, "me").collect()}
    assert merged == {"a": (owner.SELF, "A"), "c": (owner.SELF, "Chosen"), "d": (owner.SELF, "Later"), "f": (None, "F"), owner.SELF: (None, "Chosen")}
    assert owner.find_by_identifier(found.withColumn("kind", F.lit("email")).withColumn("normalized", F.col("entity")), "email", "a").count() == 1


def greedy(rows):
    """The observations one by one, as they are read."""
    kept = []
    for r in sorted(rows, key=lambda r: (-len(set(r[3])), -r[2], r[1])):
        if not r[3] or not any(set(r[3]) <= set(k[3]) for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def test_covered_observations_go_as_by_greedy_reading(spark):
    random.seed(4)
    rows = [(p, i, round(random.choice([0.1, 0.5, random.random()]), 2), random.choices(range(6), k=random.randint(0, 4))) for p in range(12) for i in range(20)]
    frame = spark.createDataFrame(rows, "principal long, id long, salience double, evidence array<long>").withColumn("size", F.lit("own"))
    want = set().union(*(greedy([r for r in rows if r[0] == p]) for p in range(12)))
    assert {(r["principal"], r["id"]) for r in briefs.without_covered(frame).collect()} == want and len(want) < 200


def test_a_brief_keeps_its_budget_for_different_matters(spark):
    rows = [(1, "all", "d", "pending", 0.7, 0, 10, [1, 2, 3]), (1, "part", "d", "pending", 0.9, 0, 10, [2, 1]), (1, "alone", "d", "pending", 0.6, None, None, [4]), (1, "cheap", "d", "pending", 0.8, 0, 10, [5]), (1, "gone", "d", "pending", 0.5, 0, 10, [9]), (1, "early", "d", "pending", 1.0, 6, 10, [6]), (1, "late", "d", "pending", 1.0, 0, 4, [6]), (1, "done", "d", "dismissed", 1.0, 0, 10, [6]), (1, "mute", "loud", "pending", 1.0, 0, 10, [6])]
    seen = spark.createDataFrame(rows, "principal long, id string, detector string, state string, salience double, earliest long, expires long, evidence array<long>")
    items = spark.createDataFrame([(1, None), (2, 1.0), (3, 0.5), (4, 1.0), (5, 0.1), (6, 1.0)], "item long, weight double")
    silenced = spark.createDataFrame([("loud",)], "detector string")
    brief = briefs.compose(seen, items, silenced, 5, budget=3)
    assert [(r["id"], r["rank"], r["salience"], r["evidence"], r["withheld"]) for r in brief.orderBy("rank").collect()] == [("all", 1, 0.7, [1, 2, 3], 1), ("alone", 2, 0.6, [4], 1), ("gone", 3, 0.5, [], 1)]
    states = {r["id"]: r["state"] for r in briefs.surfaced(seen, brief).collect()}
    assert [states[x] for x in ("all", "part", "alone", "cheap", "done")] == ["surfaced", "pending", "surfaced", "pending", "dismissed"]
    assert briefs.open_observations(seen, "loud").count() == 1 and briefs.open_observations(seen).count() == 8


def test_a_rejected_fact_is_not_proposed_again(spark):
    schema = "principal long, statement string, quote string, text string, confidence double, at long"
    said = spark.createDataFrame([(1, "He eats pork", "EATS, pork", "he eats pork!", 0.95, 5), (1, "eats the pork he", "eats pork", "he eats pork", 0.5, 3), (1, "likes tea", "never said", "he likes tea", 0.9, 1), (1, "the of", "the", "the of", 0.9, 1), (2, "He eats pork", "pork", "pork", 0.6, 1)], schema)
    found = {r["principal"]: r for r in facts.proposals(said).collect()}
    assert found[1]["statement"] == "eats the pork he" and found[1]["confidence"] == 0.8 and found[1]["id"] != found[2]["id"] and len(found) == 2
    known = spark.createDataFrame([(found[1]["id"], 1, "eats pork", "rejected", 0.6), ("ft_old", 1, "old", "confirmed", 0.9)], "id string, principal long, statement string, state string, confidence double")
    made = {r["id"]: (r["state"], r["confidence"], r["created"], r["statement"]) for r in facts.record(known, facts.proposals(said)).collect()}
    assert made == {found[1]["id"]: ("rejected", 0.8, False, "eats pork"), "ft_old": ("confirmed", 0.9, False, "old"), found[2]["id"]: ("proposed", 0.6, True, "He eats pork")}


def test_due_commitments(spark):
    now = 100 * DAY
    rows = [(1, "me", "rent", "stated", now - 2 * DAY, None, 0.9, False), (2, "me", "call", "scheduled", None, now + DAY, 0.7, False), (3, "you", "x", "stated", now, None, 0.9, False), (4, "me", "weak", "stated", now, None, 0.5, False), (5, "me", "again", "stated", now - 9 * DAY, None, 0.9, True), (6, "me", "bare", "stated", now, None, 0.9, False), (7, "me", "done", "done", now, None, 0.9, False), (8, "me", "far", "stated", now + 9 * DAY, None, 0.9, False)]
    commitments = spark.createDataFrame(rows, "commitment long, owner string, title string, state string, due long, occurs long, confidence double, recurring boolean")
    evidence = spark.createDataFrame([(c, 100 + k, -k) for c in (1, 2, 3, 4, 5, 7, 8) for k in range(1 if c == 2 else 8)], "commitment long, item long, t long")
    made = {r["dedup"]: r for r in detectors.due_commitments(commitments, evidence, now).collect()}
    assert set(made) == {"commitment_due:1:98", "commitment_due:2:101"}
    assert made["commitment_due:1:98"]["title"] == "rent was due 2 days ago" and made["commitment_due:1:98"]["salience"] == 0.93 and made["commitment_due:1:98"]["evidence"] == [107, 106, 105, 104, 103, 102]
    assert made["commitment_due:2:101"]["title"] == "call is due in 1 days" and made["commitment_due:2:101"]["earliest"] == now - 2 * DAY


def test_recurring_subjects_are_said_once_a_mail(spark):
    now = 100 * DAY
    subjects = spark.createDataFrame([("vermont", 6, 1), ("stowe", 4, 2), ("points", 5, 3), ("cabin", 9, 4)], "term string, conversations long, first long")
    items = spark.createDataFrame([(1, now - DAY, "Trip", "Vermont, near STOWE"), (2, now - 2 * DAY, "old stowe", "x"), (3, now - HOUR, "100,000 points", "x"), (4, now - 3 * DAY, None, "points again"), (5, now - 40 * DAY, "cabin", "long ago")], "item long, t long, title string, body string")
    made = detectors.recurring_subjects(subjects, items, spark.createDataFrame([(3,)], "item long"), now).collect()
    assert {(r["dedup"], r["salience"]) for r in made} == {("recurring:vermont:1", 0.75), ("recurring:points:4", 0.7)}
    assert {r["title"] for r in made} == {'"Trip" arrived, and vermont has come up in 6 conversations recently', '"an email" arrived, and points has come up in 5 conversations recently'}


def test_loose_ends(spark):
    now = 100 * DAY
    quiet, fresh = now - 3 * DAY, now - HOUR

    def situation(s, last_from, last_at, event_at=now + DAY, streams=("mail", "calendar")):
        return [(s, s * 10, "message", "outbound", streams[0], now - 9 * DAY, "hi"), (s, s * 10 + 1, "message", last_from, streams[0], last_at, "re"), (s, s * 10 + 2, "event", None, streams[1], event_at, f"meet {s}")]

    rows = situation(1, "inbound", quiet) + situation(2, "outbound", quiet) + situation(3, "inbound", fresh) + situation(4, "inbound", quiet, now + 9 * DAY) + situation(5, "inbound", quiet, streams=("mail", "mail")) + situation(6, "inbound", quiet)
    held = spark.createDataFrame(rows, "situation long, item long, kind string, direction string, stream string, t long, title string")
    made = detectors.loose_ends(held.select("situation", "item"), held.drop("situation"), spark.createDataFrame([(6,)], "situation long"), now).collect()
    assert [(r["dedup"], r["title"], r["evidence"], r["quiet_days"], r["expires"]) for r in made] == [("loose:1", "meet 1 is coming up and the thread about it went quiet", [10, 11, 12], 3, now + 2 * DAY)]


NODE = "node long, kind string, stream string, t long, title string, one_way boolean, level int"


def test_what_counts_as_a_situation_and_what_it_is_called(spark):
    groups = {
        1: [("message", "a", "subject", False), ("event", "b", "Dinner", False), ("task", "c", "Buy fish", False)],
        2: [("message", "a", "+1 555 010 0123", False), ("message", "b", "crabbing", False), ("task", "b", "", False)],
        3: [("message", "a", "x1", False), ("event", "a", "one stream", False)],
        4: [("message", "a", "no spine", False), ("message", "b", "no spine", False)],
        5: [("message", "a", "shipped", True), ("message", "a", "delivered", True), ("task", "b", "parcel", False)],
        6: [("message", "a", "shipped", True), ("task", "b", "pick up", False), ("event", "c", None, False)],
        7: [("conversation", "a", "+1 555 010 0123", False), ("message", "b", None, False)],
        8: [("event", f"s{i % 2}", "crowd", False) for i in range(41)],
    }
    nodes = [(g * 100 + i, kind, stream, i * DAY, title, one_way, 0) for g, own in groups.items() for i, (kind, stream, title, one_way) in enumerate(own)]
    members = [(n[0] // 100, n[0]) for n in nodes]
    made = situations.proposals(spark.createDataFrame(members, "situation long, node long"), spark.createDataFrame(nodes, NODE), 10 * DAY).collect()
    assert {r["situation"]: (r["title"], r["kind"], r["members"]) for r in made} == {1: ("Dinner", "event+message+task", 3), 2: ("crabbing", "message+task", 3), 6: ("pick up", "event+message+task", 3), 7: ("+1 555 010 0123", "conversation+message", 2)}


def test_decisions_outlast_a_run(spark):
    proposed = [(10, "grown", "d-new"), (11, "same", "d1"), (12, "brand new", "d2")]
    members = [(10, n) for n in (1, 2, 3)] + [(11, n) for n in (4, 5)] + [(12, n) for n in (6, 7, 40)]
    existing = [("st_a", "my trip", "user", "open", "d-old", 1, 2), ("st_b", "same", "derived", "dismissed", "d1", 1, 2), ("st_c", "absorbed", "derived", "open", "d", 1, 2), ("st_d", "gone", "derived", "open", "d", 1, 2), ("st_e", "gone but dismissed", "derived", "dismissed", "d", 1, 2), ("st_f", "mine", "user", "open", "d", 1, 2)]
    before = [("st_a", 1), ("st_a", 2), ("st_b", 4), ("st_b", 5), ("st_c", 40), ("st_c", 41), ("st_d", 50), ("st_d", 51), ("st_e", 52), ("st_e", 53), ("st_f", 54), ("st_f", 55)]
    made = situations.reconcile(spark.createDataFrame(proposed, "situation long, title string, digest string"), spark.createDataFrame(members, "situation long, node long"), spark.createDataFrame(existing, "id string, title string, title_source string, state string, digest string, first_seen long, last_changed long"), spark.createDataFrame(before, "id string, node long"), 9)
    got = {r["id"]: (r["situation"], r["title"], r["title_source"], r["state"], r["first_seen"], r["last_changed"], r["fate"]) for r in made.collect()}
    new = next(i for i, r in got.items() if r[0] == 12)
    assert got == {
        "st_a": (10, "my trip", "user", "open", 1, 9, "changed"),
        "st_b": (11, "same", "derived", "dismissed", 1, 2, "carried"),
        new: (12, "brand new", "derived", "open", 9, 9, "created"),
        "st_c": (None, "absorbed", "derived", None, 1, 2, "merged"),
        "st_d": (None, "gone", "derived", None, 1, 2, "retired"),
        "st_e": (None, "gone but dismissed", "derived", "dismissed", 1, 2, "kept"),
        "st_f": (None, "mine", "user", "open", 1, 2, "kept"),
    }


def test_situations_pass_the_gate(spark):
    nodes = spark.createDataFrame([(1, "event", "a", 0, "Dinner", False, 0), (2, "message", "b", 1, "the code is 1234", False, 2), (3, "message", "b", 2, "unlabelled", False, None)], NODE)
    members = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "situation long, node long")
    seen = situations.shown(situations.proposals(members, nodes, 0), members, nodes).collect()
    assert {(r["node"], r["text"], r["withheld"]) for r in seen} == {(1, "Dinner", 1), (3, "[sensitive] unlabelled", 1)}
    assert situations.shown(situations.proposals(members, nodes, 0), members, nodes, since=5).collect() == []
