"""Operators on small fixtures, for what the given tables do not show."""

from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.operators import components, graph, index, policy, purchases, sessions, texts, upserts

HOUR = 3_600_000_000


def chat(spark, rows):
    return spark.createDataFrame(rows, "item_id long, thread_id long, t long, direction string")


def test_gap_is_strict(spark):
    items = chat(spark, [(1, 1, 0, "inbound"), (2, 1, 4 * HOUR, "inbound"), (3, 1, 8 * HOUR + 1, "inbound")])
    assert [r["run"] for r in sessions.by_gap(items).orderBy("item_id").collect()] == [0, 0, 1]


def test_episode_limits_depend_on_the_cut_before(spark):
    items = chat(spark, [(i, 1, i * HOUR, "inbound") for i in range(10)])
    made = sessions.episodes(items, most_items=4, most_span=6 * HOUR).orderBy("part")
    assert [[m["item_id"] for m in r["members"]] for r in made.collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    spans = sessions.episodes(items, most_items=80, most_span=3 * HOUR).orderBy("part")
    assert [len(r["members"]) for r in spans.collect()] == [4, 4, 2]


def test_transcript_is_cut_and_marked(spark):
    lines = spark.createDataFrame([(1, i, "Me" if i % 2 else "Ann", "x" * 900) for i in range(20)], "conv_id long, turn int, speaker string, text string")
    row = sessions.transcripts(lines).first()
    told = row["transcript"].split("\n")
    assert told[-1] == "..." and len(told) == row["n_lines"] and row["speakers"] == "Ann"
    assert all(len(x) <= sessions.LINE + 5 for x in told)


def test_components_and_carry_over(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert {found[i] for i in range(51)} == {0} and found[101] == 100
    assert components.components(edges.limit(0)).count() == 0
    old = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 8), (2, 9)], "id long, node long")
    new = spark.createDataFrame([(5, 1), (5, 2), (5, 3), (5, 4), (6, 8), (7, 20)], "id long, node long")
    assert [tuple(r) for r in graph.carry_over(new, old).collect()] == [(5, 1)]


def test_shared_values_of_many_holders_link_nothing(spark):
    held = spark.createDataFrame([("many", i) for i in range(9)] + [("few", 1), ("few", 2), ("few", 2)], "value string, node long")
    assert [(r["a"], r["b"]) for r in graph.shared_value_edges(held, "k", 0.9).collect()] == [(1, 2)]


def test_redaction_and_classes(spark):
    texts_ = ["password: hunter22 here", "card 4111 1111 1111 1111 visa", "ssn 123-45-6789", "call (212) 555-0100", "see ?token=abc&x=1", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    out = [r["t"] for r in policy.redact(df, "t").collect()]
    assert out[0] == "password: [password] here" and "[card-or-account]" in out[1] and "[national-id]" in out[2] and "[phone]" in out[3] and out[4] == "see ?token=[redacted]&x=1" and out[5] == "nothing"
    told = policy.classify(F.col("t"))
    assert [r["l"] for r in df.filter("t IS NOT NULL").select(told["level"].alias("l")).collect()] == [2, 2, 1, 0, 0, 0]


def test_first_rule_wins_and_none_denies(spark):
    items = spark.createDataFrame([(1, "fr", 2), (2, "fr", 0), (3, "en", 0)], "item_id long, kind string, level int")
    rules = spark.createDataFrame(policy.RULES, "rule string, priority int, kind string, least int, effect string")
    assert [r["rule"] for r in policy.decide(items, rules).orderBy("item_id").collect()] == ["restricted_local", "fr_local", "default_allowed"]
    assert {r["effect"] for r in policy.decide(items, rules.filter("priority < 90")).collect()} == {"local_only"}


def test_purchases_newest_stands_for_its_doubles():
    import pandas as pd

    day = 24 * HOUR
    rows = pd.DataFrame({"owner_id": [1] * 4, "purchase_id": list("abcd"), "head": ["k"] * 4, "key": ["k"] * 4, "t": [20 * day, 19 * day, 10 * day, 0], "cents": [1000, 1100, 1005, 1000]})
    kept = pd.concat(purchases._keep_newest(iter([rows.iloc[:2], rows.iloc[2:]])))
    assert list(kept["purchase_id"]) == ["a", "d"]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("<A.B+x@GMail.com>", "(212) 555-0100", "The Acme Store, Inc."), ("p@q.org", "+44 20 7946 0958", "Acme"), ("bare", "12", "acme-")], "e string, p string, m string")
    rows = df.select(T.email(F.col("e")), T.phone(F.col("p")), T.merchant_key(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [("ab@gmail.com", "+12125550100", "acme"), ("p@q.org", "+442079460958", "acme"), ("bare", None, "acme")]


def test_references_need_a_digit(spark):
    df = spark.createDataFrame([(1, "Confirmation ABC7788XY and booking number RESERVATION, flight AA 4608, tracking # 1234567890")], "item_id long, body string")
    assert {(r["kind"], r["value"]) for r in texts.references(df).collect()} == {("confirmation", "ABC7788XY"), ("flight", "AA4608"), ("tracking", "1234567890")}


def test_windows_overlap_and_prefer_sentences():
    assert texts.cut_window("short") == ["short"]
    long = "one two three. " * 400
    pieces = texts.cut_window(long)
    assert len(pieces) == 4 and all(p.endswith("three.") for p in pieces) and all(len(p) <= 1200 for p in pieces)


def test_html_and_questions(spark):
    df = spark.createDataFrame([("<style>x</style><p>A &amp; B<br/>C</p><script>no</script>",)], "h string")
    assert df.select(T.strip_html(F.col("h"))).first()[0] == "A & B\nC"
    assert index.match_terms("Who is a.b@c.de? is it") == ["who", "is", "a.b@c.de", "it"]


def test_merge_rules_and_repeated_pages(spark):
    old = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, None)], "k long, r string, m long, f string")
    new = spark.createDataFrame([(2, None, 4, "y"), (3, "c", 1, "z")], "k long, r string, m long, f string")
    rules = {"r": "replace", "m": "max", "f": "keep"}
    once = upserts.merge(old, new, "k", rules)
    assert {tuple(r) for r in once.collect()} == {(1, "a", 5, "x"), (2, "b", 6, "y"), (3, "c", 1, "z")}
    assert {tuple(r) for r in upserts.merge(once, new, "k", rules).collect()} == {tuple(r) for r in once.collect()}
    assert {r["change"] for r in upserts.changes(once, once, "k", ["r", "m", "f"]).collect()} == {"unchanged"}
