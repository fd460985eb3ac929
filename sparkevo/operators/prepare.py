"""Imputation, scaling, splits: fit gives a small model of numbers, transform is a projection.

Fits read the frame once per statistic and keep one number or few a column; transforms never shuffle, but for
the fills along an order, which run by group or over ranges of the order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import seeded_key
from ..functions.order import celled, null_safe_join, quantiles
from ..functions.shared import free
from .frame import clean, present, unpivoted


class Unfitted(RuntimeError):
    pass


@dataclass
class Imputer:
    """strategy mean, median, mode, constant, drop or knn; values and dropped are what fit found.

    knn takes the mean of the nearest rows of the frame it was fitted on, and needs id_, a whole number; what has no
    such rows gets the column's mean.
    """

    columns: Sequence[str]
    strategy: str = "mean"
    constant: float = 0.0
    max_missing: float = 0.5
    neighbours: int = 5
    id_: str | None = None
    donors: DataFrame | None = None
    values: dict[str, float | None] | None = None
    dropped: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Imputer:
        cleaned, columns = clean(df, self.columns), list(self.columns)
        if self.strategy in ("mean", "knn"):
            if self.strategy == "knn":
                if not self.id_:
                    raise ValueError("knn needs id_")
                self.donors = cleaned.select(F.col(self.id_).alias("id"), F.array(*columns).alias("features"))
            self.values = cleaned.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
        elif self.strategy == "median":
            self.values = {c: q[0] for c, q in quantiles(cleaned, columns, (0.5,)).items()}
        elif self.strategy == "mode":
            counts = unpivoted(cleaned, columns).filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            best = counts.groupBy("feature").agg(F.min(F.struct(-F.col("n"), F.col("value")))["value"].alias("value"))
            self.values = dict.fromkeys(columns, 0.0) | {r.feature: r.value for r in best.collect()}
        elif self.strategy == "constant":
            self.values = dict.fromkeys(columns, self.constant)
        elif self.strategy == "drop":
            shares = cleaned.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
            self.dropped, self.values = [c for c in columns if (shares[c] or 0) > self.max_missing], {}
        else:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.values is None:
            raise Unfitted("fit comes before transform")
        cleaned = clean(df, self.columns)
        if self.strategy == "knn":
            from .neighbours import fill_from_neighbours

            filled, key = free(df, "_filled"), free(df, "_of")
            found = fill_from_neighbours(cleaned.select(F.col(self.id_).alias("id"), F.array(*self.columns).alias("features")), self.donors, self.neighbours)
            joined = cleaned.join(found.select(F.col("id").alias(key), F.col("filled").alias(filled)), F.col(self.id_) == F.col(key), "left")
            near = {c: F.coalesce(F.col(c), F.element_at(filled, F.lit(i))) for i, c in enumerate(self.columns)}
            cleaned = joined.withColumns(near).drop(filled, key)
        if self.strategy == "drop":
            left = [c for c in self.columns if c not in self.dropped]
            return cleaned.drop(*self.dropped).dropna(how="any", subset=left) if left else cleaned.drop(*self.dropped)
        return cleaned.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items() if v is not None})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def filled(df: DataFrame, column: str, order: str, by: Sequence[str], forward: bool = True, name: str | None = None) -> DataFrame:
    """The last value before a gap (forward), or the first after it; gaps at an end take the other side's value."""
    window = Window.partitionBy(*by).orderBy(order)
    last = F.last(present(column), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(present(column), ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name or column, F.coalesce(last, following) if forward else F.coalesce(following, last))


def filled_over_all(df: DataFrame, column: str, order: str, forward: bool = True) -> DataFrame:
    """filled along one order over the whole frame: cells of the order fill inside, and take a neighbour's end else."""
    cell, first, last, before, after = (free(df, c) for c in ("_cell_of", "_first", "_last", "_before", "_after"))
    number = free(df, "_number_of")
    cells = celled(df.withColumn(number, F.col(order).cast("double")), number, cell).drop(number)
    x = present(column)
    ends = cells.groupBy(cell).agg(F.max_by(x, F.when(x.isNotNull(), F.col(order))).alias(last), F.min_by(x, F.when(x.isNotNull(), F.col(order))).alias(first))
    outer = Window.orderBy(cell)
    ends = ends.select(
        cell,
        F.last(last, ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias(before),
        F.first(first, ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)).alias(after),
    )
    inner = Window.partitionBy(cell).orderBy(order)
    back = F.coalesce(F.last(x, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col(before))
    following = F.coalesce(F.first(x, ignorenulls=True).over(inner.rowsBetween(0, Window.unboundedFollowing)), F.col(after))
    out = cells.join(ends, cell).withColumn(column, F.coalesce(back, following) if forward else F.coalesce(following, back))
    return out.drop(cell, before, after)


@dataclass
class Scaler:
    """kind standard, minmax, robust or maxabs: (x - shift) / scale, then into the range for minmax."""

    columns: Sequence[str]
    kind: str = "standard"
    low: float = 0.0
    high: float = 1.0
    quantile_range: tuple[float, float] = (25.0, 75.0)
    center: bool = True
    spread: bool = True
    shift: dict[str, float] | None = None
    scale: dict[str, float] | None = None

    def fit(self, df: DataFrame) -> Scaler:
        cleaned, columns = clean(df, self.columns), list(self.columns)
        if self.kind == "robust":
            lo, hi = (q / 100 for q in self.quantile_range)
            got = quantiles(cleaned, columns, (lo, 0.5, hi))
            shift, scale = {c: q[1] for c, q in got.items()}, {c: None if q[0] is None else q[2] - q[0] for c, q in got.items()}
        elif self.kind in ("standard", "minmax", "maxabs"):
            one, two = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max), "maxabs": (lambda c: F.lit(0.0), lambda c: F.max(F.abs(c)))}[self.kind]
            got = cleaned.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("a", one), ("b", two))]).first()
            shift, scale = {c: got[f"a_{c}"] for c in columns}, {c: got[f"b_{c}"] for c in columns}
            if self.kind == "minmax":
                scale = {c: None if scale[c] is None else scale[c] - shift[c] for c in columns}
        else:
            raise ValueError(f"unknown scaler {self.kind!r}")
        self.shift = {c: (v or 0.0) if self.center else 0.0 for c, v in shift.items()}
        self.scale = {c: v or 1.0 if self.spread else 1.0 for c, v in scale.items()}
        return self

    def _map(self, df: DataFrame, f) -> DataFrame:
        if self.shift is None:
            raise Unfitted("fit comes before transform")
        return clean(df, self.columns).withColumns({c: f(c, F.col(c)) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        k, low = (self.high - self.low, self.low) if self.kind == "minmax" else (1.0, 0.0)
        return self._map(df, lambda c, x: (x - self.shift[c]) * k / self.scale[c] + low)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        k, low = (self.high - self.low, self.low) if self.kind == "minmax" else (1.0, 0.0)
        return self._map(df, lambda c, x: (x - low) / k * self.scale[c] + self.shift[c])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def get_scaler(name: str, columns: Sequence[str], **options) -> Scaler:
    if name not in ("standard", "minmax", "robust", "maxabs"):
        raise ValueError(f"unknown scaler {name!r}")
    return Scaler(columns, name, **options)


def shuffled_rank(df: DataFrame, label: str, id_: str, seed: int = 42, name: str = "rank", size: str = "n") -> DataFrame:
    """df with its 1-based place in a seeded shuffle of its class, and size, the rows of the class; null is a class too.

    Places are counted by ranges of the shuffle key, which is uniform, so a class may hold any share of the rows. name
    and size are columns that df does not have.
    """
    if {name.lower(), size.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"{name!r} or {size!r} is a column already")
    key, place, count, before, at = (free(df, c) for c in ("_key", "_bin", "_count", "_before", "_at"))
    bins = max(1, math.isqrt(df.count()))
    keyed = df.withColumn(key, F.md5(seeded_key(seed, F.col(id_)))).withColumn(place, F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * bins / F.lit(2**32)))
    cells = keyed.groupBy(label, place).agg(F.count(F.lit(1)).alias(count))
    by = Window.partitionBy(label)
    cells = cells.select(label, place, F.sum(count).over(by).alias(size), F.coalesce(F.sum(count).over(by.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    numbered = keyed.withColumn(at, F.row_number().over(Window.partitionBy(label, place).orderBy(key, id_)))
    return null_safe_join(numbered, cells, [label, place]).withColumn(name, F.col(before) + F.col(at)).drop(key, place, before, at)


def stratified_folds(df: DataFrame, label: str, id_: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1; every class differs by one row at most between folds."""
    rank, size = free(df, "_rank"), free(df, "_size")
    return shuffled_rank(df, label, id_, seed, rank, size).withColumn("fold", F.pmod(F.col(rank) - 1, F.lit(k)).cast("int")).drop(rank, size)


def stratified_split(df: DataFrame, label: str, id_: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: the first round(test * n) rows of each class in a seeded shuffle."""
    if not 0 < test < 1:
        raise ValueError("test must lie between 0 and 1")
    rank, size = free(df, "_rank"), free(df, "_size")
    ranked = shuffled_rank(df, label, id_, seed, rank, size)
    return ranked.withColumn("is_test", F.col(rank) <= F.floor(F.col(size) * test + 0.5)).drop(rank, size)


def scaled(c: Column, shift: float, scale: float) -> Column:
    return (c - shift) / (scale or 1.0)
