"""The linkers' rules on small sets of nodes: what has to be linked, what must not be, and why not."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import identity, linkers, merchants, times
from tidepool.operators.nodes import DAY, HOUR

NOW = 1_786_622_400_000_000
SCHEMA = "node string, kind string, stream string, t long, ends long, title string, text string"


def node(name, kind, stream, days, title, text, lasts=None):
    t = NOW + int(days * DAY)
    return (name, kind, stream, t, None if lasts is None else t + lasts, title, text)


NODES = [
    node("chat", "episode", "chat", -6, None, "shall we have the kowalczyk dinner soon", HOUR),
    node("dinner", "event", "calendar", -2, "Kowalczyk dinner", "Kowalczyk dinner", HOUR),
    node("late", "message", "mail", -1, "after it", "the kowalczyk dinner was fine"),
    node("early", "message", "mail", -40, "long before", "kowalczyk dinner some day"),
    node("dentist", "task", "tasks", -4, "Collect crown from dentist reception", "Collect crown from dentist reception"),
    node("mail", "message", "mail", -5, "Your visit", "the crown is ready, please collect it at the reception of the dentist"),
    node("haircut", "task", "tasks", -30, "Haircut tomorrow downtown", "Haircut tomorrow downtown"),
    node("other", "message", "mail", -12, "Style", "a haircut tomorrow or downtown"),
    node("a", "message", "mail", -9, "x", "reply from pat about the zanzibar ferry"),
    node("b", "message", "chat2", -9 + 1 / 24, "y", "the zanzibar ferry leaves at noon"),
]
PEOPLE = [("a", "pat"), ("b", "pat"), ("late", "sam")]


@pytest.fixture(scope="module")
def pairs(spark):
    found = spark.createDataFrame(NODES, SCHEMA)
    who = spark.createDataFrame(PEOPLE, "node string, person string")
    rare, _ = linkers.rare_terms(found)
    candidates = linkers.merged([linkers.content_candidates(found, rare), linkers.person_candidates(found, who), linkers.task_candidates(found)])
    return linkers.paired(candidates, found, rare, who).cache()


def by_pair(frame):
    return {(r["a"], r["b"]): r for r in frame.collect()}


def test_what_was_said_before_arranges_and_what_was_said_after_does_not(pairs):
    got = by_pair(linkers.arranges(pairs))
    assert got["chat", "dinner"]["kind"] == "arranges" and got["chat", "dinner"]["confidence"] == 0.85
    assert got["late", "dinner"]["rejected"] == "after the event" and got["early", "dinner"]["rejected"] == "past the window"


def test_a_task_tracks_the_nearest_occasion_that_shares_its_words(pairs):
    got = by_pair(linkers.tracks(pairs))
    assert got["dentist", "mail"]["confidence"] == 0.7 and got["dentist", "mail"]["rejected"] is None
    assert got["haircut", "other"]["rejected"] == "not the nearest occasion" and got["dentist", "chat"]["rejected"] == "too few words"


def test_rare_words_link_across_streams_only(pairs):
    got = by_pair(linkers.about_same(pairs))
    assert got["a", "b"]["rejected"] is None and got["a", "b"]["confidence"] > 0.4 and "zanzibar" in got["a", "b"]["words"]
    assert ("late", "early") not in got


def test_the_same_person_close_in_time_is_adjacent(pairs):
    got = by_pair(linkers.adjacent(pairs))
    assert got["a", "b"]["confidence"] == 0.35


def test_bulk_people_make_no_candidates(spark):
    found = spark.createDataFrame([node(f"n{i}", "message", "mail", -i / 100, "t", "x") for i in range(260)], SCHEMA)
    bulk = found.select("node", F.lit("list").alias("person"))
    assert linkers.person_candidates(found, bulk).count() == 0
    few = bulk.filter("node < 'n12'")
    assert linkers.person_candidates(found, few).count() > 0


def test_senders_merchants_and_amounts(spark):
    rows = [(1, '"PayPal" <help@secure-pay.ru>'), (2, "PayPal <x@mail.paypal.com>"), (3, "Ann <ann@gmail.com>"), (4, None), (5, "no address"), (6, "Shop <a@t.shopifyemail.com>"), (7, "Geek Squad <x@geeksquad.com>")]
    frame = spark.createDataFrame(rows, "i long, author string")
    told = {r["i"]: (r["d"], r["s"]) for r in frame.select("i", merchants.trust_sender(F.col("author")).alias("d"), merchants.shared_sender(F.col("author")).alias("s")).collect()}
    assert told == {1: ("claims a brand", False), 2: (None, False), 3: ("consumer domain", False), 4: ("no sender", False), 5: ("no sending domain", False), 6: (None, True), 7: (None, False)}
    names = spark.createDataFrame([("fairwaysupply@mail.pgatour", "fairwaysupply"), ("ParkMobile, LLC All Rights Reserved", "ParkMobile, LLC"), ("Microsoft Corporatio...", "Microsoft Corporatio"), ("$5 off", None), ("x", None)], "name string, clean string")
    assert names.filter(~merchants.clean_merchant(F.col("name")).eqNullSafe(F.col("clean"))).count() == 0
    alike = spark.createDataFrame([("Microsoft Corporation", "microsoft corporatio", False), ("Universal Electric Supply", "universal electric suppl", True), ("Uber", "Uber Eats", False), ("The Corner Shop", "corner shop, inc.", True)], "a string, b string, same boolean")
    assert alike.filter(merchants.same_merchant(F.col("a"), F.col("b")) != F.col("same")).count() == 0


def test_addresses_names_and_handles(spark):
    rows = [('"Whitfield, Dana" <D.Whitfield+x@Gmail.com>', "dwhitfield@gmail.com", None, "Whitfield, Dana", "dana whitfield"), ("+1 (555) 010-0199", None, "+15550100199", None, None), ("bob@y.com", "bob@y.com", None, None, None), ("Just A Name", None, None, "Just A Name", "just a name"), ("", None, None, None, None)]
    frame = spark.createDataFrame(rows, "raw string, email string, phone string, name string, normal string")
    got = frame.select("*", identity.parse_address(F.col("raw")).alias("p"))
    assert got.filter(~F.col("p.email").eqNullSafe(F.col("email")) | ~F.col("p.phone").eqNullSafe(F.col("phone")) | ~F.col("p.name").eqNullSafe(F.col("name"))).count() == 0
    assert got.filter(~identity.normal_name(F.col("p.name")).eqNullSafe(F.col("normal"))).count() == 0
    listed = spark.createDataFrame([(['"Whitfield, Dana" <d@x.com>, bob@y.com', "+15550100199"],)], "v array<string>").select(identity.address_list(F.col("v")).alias("l")).first()["l"]
    assert [(a["email"], a["name"]) for a in listed] == [("d@x.com", "Whitfield, Dana"), ("bob@y.com", None)]
    handles = spark.createDataFrame([("+15550100199, +15550100198", True), ("Dinner", False)], "t string, h boolean")
    assert handles.filter(identity.is_handle_title(F.col("t")) != F.col("h")).count() == 0


def test_cards_weld_people_through_any_number_of_cards(spark):
    cards = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 30), (4, 31), (4, 30)], "card long, anchor long")
    assert {r["anchor"]: r["entity"] for r in identity.welded(cards).collect()} == {10: 10, 11: 10, 12: 10, 30: 30, 31: 30}


def test_wall_clocks_follow_summer_time(spark):
    frame = spark.createDataFrame([("2024-03-10",), ("2024-07-01",), ("2024-11-03",)], "d string")
    got = [r[0] for r in frame.select(times.local_iso(times.at_local(F.col("d"), 9, 30, "America/New_York"), "America/New_York")).collect()]
    assert got == ["2024-03-10T09:30:00-04:00", "2024-07-01T09:30:00-04:00", "2024-11-03T09:30:00-05:00"]
