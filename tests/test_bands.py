"""The nearest rows in time against brute force, at block borders, among ties, and for one key of a million rows."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tidepool.operators.bands import nearest_in_band


def by_definition(left, right, width, most, bulk):
    out = set()
    for i, key, t in left:
        met = [(abs(t - u), j) for j, other, u in right if other == key and abs(t - u) <= width]
        if bulk is not None and len(met) > bulk:
            continue
        near = sorted(x for x in met if x[1] != i)[:most]
        out |= {(i, key, j, away, n + 1) for n, (away, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("width, most, bulk, block_rows", [(30, 5, None, 4096), (30, 5, 12, 4096), (1000, 3, None, 1), (50, 2, 8, 1), (0, 4, None, 1), (10**9, 7, None, 1)])
def test_nearest_by_brute_force(spark, width, most, bulk, block_rows):
    random.seed(width + most)
    rows = [(f"n{i}", random.choice(["hot", "hot", "hot", "a", "b", "c"]), random.choice([random.randrange(2000), random.randrange(20) * 100])) for i in range(1200)]
    # Texts and times of equal rows, ids that sort as text, keys of one row.
    rows += [("n5", "d", 7), ("zz", "hot", 100), ("", "hot", 100)] + [(f"m{i}", f"k{i}", 5) for i in range(50)]
    left, right = rows[::2], rows
    schema = "id string, key string, t long"
    made = nearest_in_band(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), width=width, most=most, bulk=bulk, block_rows=block_rows)
    got = [tuple(r) for r in made.repartition(1).collect()]
    assert len(set(got)) == len(got) and set(got) == by_definition(left, right, width, most, bulk)


def test_nulls_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, 1, 10), (2, 1, 12), (None, 1, 11), (3, None, 11), (4, 1, None)], "id long, key int, t long")
    assert sorted(tuple(r) for r in nearest_in_band(rows, rows, width=5, most=3).collect()) == [(1, 1, 2, 2, 1), (2, 1, 1, 2, 1)]
    assert nearest_in_band(rows, rows.limit(0), width=5, most=3).collect() == []
    assert nearest_in_band(rows.limit(0), rows, width=5, most=3).collect() == []


def test_a_person_of_a_million_nodes(spark):
    n = 1_000_000
    right = spark.range(n).select("id", F.lit("owner").alias("key"), (F.col("id") * 7919 % n * 10 + F.col("id") % 3).alias("t"))
    left = right.filter("id % 1000 = 3")
    made = nearest_in_band(left, right, width=200, most=4, bulk=60)
    assert made.count() == 4000
    times = sorted(((i * 7919 % n * 10 + i % 3), i) for i in range(n))
    instants = [t for t, _ in times]
    for r in made.filter("rank = 1 AND left_id < 50000").collect():
        t = r["left_id"] * 7919 % n * 10 + r["left_id"] % 3
        near = [(abs(u - t), j) for u, j in times[bisect_left(instants, t - 200) : bisect_right(instants, t + 200)] if j != r["left_id"]]
        assert (r["away"], r["right_id"]) == min(near)
    # In a wider window all of it is bulk, and no pair is made.
    assert nearest_in_band(left, right, width=2000, most=4, bulk=60).count() == 0
