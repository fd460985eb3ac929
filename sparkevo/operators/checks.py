"""Expectations on columns: conditions that every row should meet, counted in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(c: str, low: float | None = None, high: float | None = None) -> Column:
    x = F.col(c)
    met = F.lit(True) if low is None else x >= low
    return met if high is None else met & (x <= high)


def positive(c: str) -> Column:
    return F.col(c) > 0


def whole(c: str) -> Column:
    return F.col(c) == F.rint(F.col(c).cast("double"))


def one_of(c: str, choices: Sequence) -> Column:
    return F.col(c).isin(list(choices))


def length(c: str, low: int = 0, high: int | None = None) -> Column:
    met = F.size(c) >= low
    return met if high is None else met & (F.size(c) <= high)


def violations(df: DataFrame, expected: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """by, check and rows that do not meet it; a missing value meets nothing."""
    counts = df.groupBy(*by).agg(*[F.count_if(~F.coalesce(met, F.lit(False))).alias(name) for name, met in expected.items()])
    return counts.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in expected])).alias("v")).select(*by, "v.check", "v.rows")


def ratios(*shares: float) -> None:
    """Raises unless shares are positive and make one together."""
    if not shares or any(s <= 0 for s in shares) or abs(sum(shares) - 1) > 1e-6:
        raise ValueError(f"shares {shares} must be positive and make one")
