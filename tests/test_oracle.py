"""Every core query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import importlib
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else round(float(v), 6)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(cell(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, folder, name):
    got, want = QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
