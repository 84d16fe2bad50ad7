"""Spending, the receipt funnel and correspondents on small tables."""

from pyspark.sql import functions as F

from tidepool.operators import spending


def test_spending_is_shown_under_the_best_name_and_can_be_narrowed(spark):
    rows = [("amazon", "Amazon", 10, 100), ("amazon", "AMAZON.com", 20, 50), ("corner", "Corner Shop", 15, 120), ("corner", "Corner Shop", 40, 1)]
    bought = spark.createDataFrame(rows, "key string, merchant string, t long, cents long")
    got = {r["key"]: (r["merchant"], r["purchases"], r["cents"]) for r in spending.spend(bought).collect()}
    assert got == {"amazon": ("AMAZON.com", 2, 150), "corner": ("Corner Shop", 2, 121)}
    assert [r["key"] for r in spending.spend(bought, limit=1).collect()] == ["amazon"]
    assert [(r["key"], r["cents"]) for r in spending.spend(bought, merchant="The Corner", since=20, until=50).collect()] == [("corner", 1)]


def test_the_first_reason_counts(spark):
    rows = [(1, None, "Shop <a@shop.org>"), (2, "  ", "Shop <a@shop.org>"), (3, "Your order total: $5.00", None), (4, "Your order total: $5.00", "Me <me@gmail.com>"), (5, "hello there", "Shop <a@shop.org>")]
    frame = spark.createDataFrame(rows, "n int, body string, author string")
    got = {r["n"]: r["reason"] for r in frame.select("n", spending.receipt_reason(F.col("body"), F.col("author")).alias("reason")).collect()}
    assert got[1] == got[2] == "empty" and got[3] == got[4] == "untrusted_sender" and got[5] == "no_receipt_words"


def test_correspondents_are_people_one_wrote_to_twice(spark):
    rows = [("a", "outbound", 1, "a@x", False), ("a", "outbound", 2, "b@x", None), ("a", "inbound", 3, "b@x", False), ("b", "outbound", 1, "c@x", False), ("b", "inbound", 9, None, False), ("c", "outbound", 1, "n@x", True), ("c", "outbound", 1, "n@x", True)]
    frame = spark.createDataFrame(rows, "entity string, direction string, t long, address string, automated boolean")
    assert [tuple(r) for r in spending.correspondents(frame).collect()] == [("a", 3, 1, 2, 3, ["b@x", "a@x"])]
