"""Every registered query runs on the smallest tables and, where it has SQL, gives what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from redactum.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).map(plain).values.tolist()))
    assert rows(got) == rows(want)


def test_names_match():
    assert set(ORACLE_SQL) <= set(QUERIES)
