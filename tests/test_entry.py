"""The registry: every reference SQL has its query, and queries agree with their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from threadloom.plans import registry

SLOW: set[str] = set()


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return f"{float(v):.6g}" if type(v).__name__ in ("Decimal", "int64", "int32", "int") else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_registry():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql() if not n.startswith("stream_")))
def test_against_sql(spark, con, small, name):
    got, want = registry.queries()[name](spark, small).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n not in registry.oracle_sql() and n not in SLOW and not n.startswith("stream_")))
def test_runs(spark, small, name):
    """Queries without SQL give rows, each once, and the same ones when they run again."""
    first, again = (rows(registry.queries()[name](spark, small).toPandas()) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    assert entry.entry(spark).count() > 0
