"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidelog.plans import catalog_queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() and abs(v) < 2**53 else round(v, 6)
    return v if isinstance(v, (bool, int)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, sf, con, name):
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(Q.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_without_sql(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 4
    assert set(E.oracle_sql()) <= set(E.queries())
