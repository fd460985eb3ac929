"""Registry of queries: a function of (spark, sf_dir) and, where there is one, the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of one argument, which reads a table by name."""

    def wrap(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name or f.__name__, f.__doc__
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return f

    return wrap
