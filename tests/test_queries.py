"""Every registered query of the library against its DuckDB form."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidepool.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if not hasattr(value, "__len__") and pd.isna(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def bag(frame: pd.DataFrame) -> Counter:
    return Counter(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours, theirs = queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    frame = queries()[name](spark, SF)
    assert frame.columns
    assert frame.count() >= 0
