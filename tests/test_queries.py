"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from sparkevo import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def plain(frame):
    cell = lambda v: "~" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_registry():
    assert set(plans.oracle_sql()) <= set(plans.queries())
