"""Canonical frames: row_id, label and numeric columns, missing values as NULL; wide, long and array views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def present(c: str) -> Column:
    """The value as double, NULL where it is NaN or infinite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: present(c) for c in columns})


def unpivoted(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, value: one row a cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.feature", "cell.value")


def vectors(df: DataFrame, columns: Sequence[str], keys: Sequence[str], name: str = "features") -> DataFrame:
    return df.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias(name))


def onehot_class(flags: Sequence[str]) -> Column:
    """Index of the first greatest flag; -1 where none is set."""
    a = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags])
    return F.when(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)) == 0, F.lit(-1)).otherwise((F.array_position(a, F.array_max(a)) - 1).cast("int"))
