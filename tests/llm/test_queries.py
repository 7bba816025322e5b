"""Every query of the package runs; those with SQL agree with DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from jobweave.llm import query_modules

QUERIES = {n: q for m in query_modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in query_modules() for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    got = QUERIES[name](spark, folder)
    rows = got.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in SQL:
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        result = con.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(got.columns)
        assert {tuple(r[c] for c in columns) for r in rows} == set(result.fetchall())
