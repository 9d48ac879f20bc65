"""The driver contract, and every core query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from loomgraph import queries
from loomgraph.catalog import TABLES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert set(queries.QUERIES) <= set(known)


@needs_data
def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "doc", "score", "rank"] and out.count() > 0


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return sorted(map(tuple, df.astype(str).values.tolist()))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
