"""Queries against their DuckDB form on small tables made for what the given ones do not hold."""

import contextlib
import datetime
import threading

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidepool.operators import promises
from tidepool.queries import oracle_sql, queries
from tidepool.sources import dav
from tidepool.streaming import passes

MONTH = datetime.datetime(1999, 5, 1)


@pytest.fixture
def both(spark, tmp_path):
    """A query's rows by Spark and by DuckDB over tables of one's own."""

    def run(name, **tables):
        connection = duckdb.connect()
        for table, rows in tables.items():
            pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), tmp_path / f"{table}.parquet")
            connection.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        ours = queries()[name](spark, str(tmp_path))
        theirs = connection.execute(f"SELECT {', '.join(ours.columns)} FROM ({oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, ours.collect()), key=repr), sorted(theirs, key=repr)

    return run


def test_quotes_of_letters_without_a_capital(both):
    texts = {0: "beeinß und heitßkeit", 4: "ﬁne ŉ ǰ, ᾳ ῶ", 8: "ΟΔΟΣ ΟΔΟΣ", 12: "İstanbul ısı", 16: "ſtraße µ"}
    rows = [{"conv_id": c, "turn": 0, "role": "user", "text": t} for c, t in texts.items()]
    # Turns told twice, turns without a number or without a text, and nothing said at all.
    rows += [{"conv_id": 20, "turn": 1, "role": r, "text": t} for r, t in (("user", "said here"), ("assistant", None))]
    rows += [{"conv_id": 22, "turn": 0, "role": "user", "text": None}, {"conv_id": 25, "turn": 3, "role": "user", "text": None}, {"conv_id": 26, "turn": None, "role": "user", "text": "b and what more"}, {"conv_id": 27, "turn": 1, "role": "user", "text": "a split quote"}, {"conv_id": 27, "turn": None, "role": "system", "text": "late"}]
    ours, theirs = both("quotes_verified", conversations=rows)
    assert ours == theirs
    found = dict(ours)
    assert found[0] and found[4] and found[8] and found[25] is None and sum(c == 20 for c, _ in ours) == 2


def test_the_smaller_of_two_equal_situations_goes_on(both):
    # Orders 9, 19 and 10, 20 were a situation each; order 30 of a later year joins them.
    days = {9: 1, 19: 1, 10: 2, 20: 2, 30: 3}
    orders = [{"o_orderkey": k, "o_custkey": 1, "o_orderstatus": "P", "o_orderpriority": str(k), "o_orderdate": MONTH.replace(year=2001 if k == 30 else 1999, day=d), "o_totalprice": 1.0} for k, d in days.items()]
    held = {9: (1,), 19: (1, 3), 10: (2,), 20: (2, 4), 30: (3, 4)}
    lines = [{"l_orderkey": k, "l_partkey": p, "l_suppkey": k, "l_shipdate": MONTH} for k, parts in held.items() for p in parts]
    ours, theirs = both("situations_reconciled", orders=orders, lineitem=lines)
    assert ours == theirs
    assert {(r[0], r[-1]) for r in ours} == {("st_9", "changed"), ("st_10", "kept")}


@contextlib.contextmanager
def within(spark, seconds):
    """Spark's jobs are cancelled, and so fail, when they take longer."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def one_title_a_day(spark, days):
    """Rows of one title, on a day each."""
    return spark.range(days).select("id", F.array(F.lit("buy"), F.lit("fish")).alias("words"), (F.col("id") * promises.DAY).alias("t"))


def test_events_of_one_title_make_no_pairs(spark):
    days = one_title_a_day(spark, 30_000)
    stated = days.select("id", "words", F.lit("stated").alias("state"), F.col("t").alias("due"), F.lit(None).cast("long").alias("first_seen"))
    with within(spark, 60):
        found = promises.scheduled(stated, days).select("id", "event", "occurs").collect()
    assert {tuple(r) for r in found} == {(i, max(0, i - 30), max(0, i - 30) * promises.DAY) for i in range(30_000)}


def test_commitments_of_one_title_make_no_pairs(spark):
    days = one_title_a_day(spark, 30_000).withColumn("owner", F.lit("me"))
    none = F.lit(None).cast("long")
    store = days.select("id", "owner", "words", F.lit("stated").alias("state"), F.col("t").alias("due"), none.alias("occurs"), none.alias("first_seen"))
    with within(spark, 60):
        found = promises.matched(days.withColumnRenamed("t", "anchor"), store).select("id", "commitment", "similarity").collect()
    assert {tuple(r) for r in found} == {(i, max(0, i - 60), 1.0) for i in range(30_000)}


def test_answers_do_not_grow_with_the_orders(spark, both, tmp_path):
    def orders(n):
        keys = pa.array(range(n))
        return pa.table({"o_orderkey": keys, "o_custkey": keys, "o_orderstatus": ["O"] * n, "o_orderpriority": ["5 <&>"] * n, "o_orderdate": pa.array([MONTH] * n, pa.timestamp("us"))})

    longest = []
    for n in (6000, 18_000):
        for name in ("dav_events", "dav_resources"):
            ours, theirs = both(name, orders=orders(n))
            assert ours == theirs
        longest.append(dav._answers(spark, str(tmp_path)).agg(F.max(F.length("xml"))).first()[0])
    assert longest[1] < 1.1 * longest[0]


def test_merchants_are_read_once_and_not_with_every_purchase(spark, both):
    n = 1_500_000
    at = np.arange(n)
    stamps = lambda days: pa.array(np.datetime64("1999-05-01", "us") + days.astype("timedelta64[D]"))
    lines = pa.table({"l_orderkey": at // 2, "l_suppkey": at % 40, "l_extendedprice": (at % 5000) / 10.0, "l_shipdate": stamps(at % 90)})
    keys = np.append(np.arange(n // 2), 7)  # an order told twice counts as in the SQL
    orders = pa.table({"o_orderkey": keys, "o_orderdate": stamps(keys % 60)})
    supplier = pa.table({"s_suppkey": np.arange(40), "s_name": [f"Supplier {i}" for i in range(40)]})
    with within(spark, 60):
        ours, theirs = both("purchase_types", lineitem=lines, orders=orders, supplier=supplier)
    assert ours == theirs and len(ours) > 2


def test_attempts_at_very_many_items(spark, tmp_path):
    n = 400_000
    made = spark.range(2 * n).select(F.col("id").alias("attempt"), (F.col("id") % n).alias("item"), F.lit(1).alias("tier"), (F.col("id") >= 2 * n - 5).alias("ok"))
    made.unionByName(made.filter("attempt % 7 = 0")).repartition(2).write.parquet(f"{tmp_path}/source")
    with within(spark, 60):
        passes.follow(spark.readStream.schema("attempt long, item long, tier int, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source"), str(tmp_path))
        found = passes.states(spark, str(tmp_path)).groupBy("failures", "tier", "outcome").count().collect()
    assert {tuple(r) for r in found} == {(2, 2, "retry", n - 5), (1, 1, "done", 5)}
