"""Queries with SQL give what DuckDB gives on the same tables."""

import duckdb
import pytest

from sparkevo.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name]).df()
    got = q.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    plain = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    assert plain(got) == plain(want)
