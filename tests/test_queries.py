"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

SQL = entry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "" if x is None or str(x) in ("nan", "<NA>", "None") else f"{float(x):.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    ours = entry.queries()[name](spark, sf).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert set(ours.columns) == set(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
