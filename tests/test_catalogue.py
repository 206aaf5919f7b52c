"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from dittograph.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_greedy_equals_a_plain_pass(spark):
    edges = [(1, 2, 3, 0.9), (3, 4, 4, 0.8), (2, 3, 5, 0.7), (4, 5, 6, 0.6), (9, 7, 1, 0.5)]
    from dittograph.operators.similar import greedy_groups, similar_components

    e = spark.createDataFrame(edges, "i long, j long, hd int, ssim double")
    got = {r.id: (r.group_id, r.score) for r in greedy_groups(e).collect()}
    assert got == {1: (1, 0.9), 2: (1, 0.9), 3: (3, 0.8), 4: (3, 0.8), 5: (3, 0.8), 9: (9, 0.5), 7: (9, 0.5)}
    assert {r.id: r.component for r in similar_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 9: 7}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())
