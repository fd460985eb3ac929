"""Column profiles, correlations, class balance, outliers, missing values and histograms.

Every statistic is an aggregate with partial sums in the tasks; quantiles come from
:func:`sparkevo.functions.order.quantiles`, so no task holds a column's values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import before, quantiles
from ..functions.shared import saved
from . import gram
from .frame import clean, unpivoted


#: Columns whose means one aggregate takes; more are counted as cells.
PLAIN = 40


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, q25, median, q75: one row a column."""
    found = quantiles(df, columns, (0.25, 0.5, 0.75))
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], "feature string, q25 double, median double, q75 double")


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, population deviation, extremes, quartiles, missing, zeros and distinct values of each column.

    The source is read once, into rows of each distinct value; all else follows from their counts and running counts.
    """
    cells = unpivoted(clean(df, columns), columns)
    by_value = saved(cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    there, v, n = F.col("value").isNotNull(), F.col("value"), F.col("n")
    stats = by_value.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("_n"),
        F.try_divide(F.sum(v * n), F.sum(F.when(there, n))).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.sum(F.when(~there, n)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros"),
        F.count("value").alias("unique"),
    )
    stats = saved(stats, "stats")  # a row a feature
    ahead = F.col("n_before")
    places = F.array(*[F.struct(F.lit(q).alias("q"), at(F.lit(q) * (F.col("_n") - 1)).cast("bigint").alias("rank")) for q in (0.25, 0.5, 0.75) for at in (F.floor, F.ceil)])
    steps = before(by_value.filter(there), "value", ["n"], ["feature"]).join(F.broadcast(stats.select("feature", "mean", "_n", places.alias("places"))), "feature")
    held = F.transform(F.filter("places", lambda p: (p["rank"] >= ahead) & (p["rank"] < ahead + n)), lambda p: F.struct(p["q"].alias("q"), p["rank"].alias("rank"), v.alias("v")))
    spread = steps.groupBy("feature").agg(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(n)).alias("std"), F.flatten(F.collect_list(F.when(F.size(held) > 0, held))).alias("_held"), F.first("_n").alias("_n"))

    def quartile(q: float):  # at most two ranks of a feature for each
        own = F.array_sort(F.transform(F.filter("_held", lambda h: h["q"] == q), lambda h: F.struct(h["rank"], h["v"])))
        lo, hi = F.get(own, F.lit(0))["v"], F.element_at(own, -1)["v"]
        at = F.lit(q) * (F.col("_n") - 1)
        return F.when(F.size(own) > 0, lo + (hi - lo) * (at - F.floor(at)))

    spread = spread.select("feature", "std", quartile(0.25).alias("q25"), quartile(0.5).alias("median"), quartile(0.75).alias("q75"))
    return stats.join(F.broadcast(spread), "feature", "left").select("feature", "mean", "std", "min", "max", "median", "q25", "q75", "missing", "zeros", "unique")


def stats_overview(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("missing").alias("total_missing"), F.count_if(F.col("missing") > 0).alias("features_with_missing"), F.count_if(F.col("std") == 0).alias("constant_features"))


def top_variance(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n features of greatest variance; a report of n rows."""
    return stats.filter(F.col("std").isNotNull()).select("feature", (F.col("std") * F.col("std")).alias("variance")).orderBy(F.desc("variance"), "feature").limit(n)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for all ordered pairs: Pearson after filling with the mean; 0 where a column is constant.

    Sums of products come in tiles of columns, from one pass, and pairs are written out where the tiles are; only
    numbers of columns come to the driver.
    """
    names, p = list(columns), len(columns)
    known = df.select(F.transform(F.array(*[F.col(c).cast("double") for c in names]), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)).alias("x"))
    if p <= PLAIN:
        got = clean(df, names).agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
        stats = {i: (got[f"m{i}"], None, got[f"lo{i}"], got[f"hi{i}"]) for i in range(p) if got[f"m{i}"] is not None}
    else:
        stats = gram.column_stats(known)
    means = gram.literal([stats[i][0] if i in stats else 0.0 for i in range(p)])
    constant = np.array([i not in stats or stats[i][2] == stats[i][3] for i in range(p)])
    tiles = saved(gram.tiles(known.select(F.zip_with("x", means, lambda x, m: F.coalesce(x - m, F.lit(0.0))).alias("x")), p), "tiles")
    side = lambda a: min(gram.TILE, p + 1 - a)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of tiles of the first row, sums; of tiles on the diagonal, sums of squares."""
        for batch in batches:
            for r in batch.to_pylist():
                cells = np.array(r["cells"]).reshape(side(r["i"]), -1)
                at, found = [], []
                if not r["i"]:
                    at, found = [*range(r["j"], r["j"] + side(r["j"]))], [(float(x), None) for x in cells[0]]
                if r["i"] == r["j"]:
                    at, found = [*at, *range(r["i"], r["i"] + side(r["i"]))], [*found, *[(None, float(x)) for x in np.diag(cells)]]
                yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "s": pa.array([x for x, _ in found], pa.float64()), "ss": pa.array([x for _, x in found], pa.float64()), "n": pa.array([r["n"]] * len(at), pa.int64())})

    rows = {r["at"]: r for r in tiles.mapInArrow(own, "at int, s double, ss double, n bigint").groupBy("at").agg(F.max("s").alias("s"), F.max("ss").alias("ss"), F.max("n").alias("n")).collect()}
    n = max(1, rows[0].n if rows else 1)
    mean, square = (np.array([(rows[i][k] or 0.0) / n if i in rows else 0.0 for i in range(1, p + 1)]) for k in ("s", "ss"))
    scale = np.where(constant, 0.0, np.sqrt(np.maximum(square - mean**2, 0)))
    told = df.sparkSession.sparkContext.broadcast((names, mean, scale))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mean, scale = told.value
        for batch in batches:
            for r in batch.to_pylist():
                i, j = (np.arange(r[k], r[k] + side(r[k])) - 1 for k in ("i", "j"))
                both = scale[i][:, None] * scale[j][None, :]
                cov = np.array(r["cells"]).reshape(len(i), -1) / r["n"] - mean[i][:, None] * mean[j][None, :]
                got = np.where(both > 0, np.clip(cov / np.where(both > 0, both, 1), -1, 1), 0.0)
                x, y = np.meshgrid(i, j, indexing="ij")
                keep = (x >= 0) & (x < y)
                a, b, v = x[keep], y[keep], got[keep]
                own = i[(i >= 0)] if r["i"] == r["j"] else i[:0]
                a, b, v = np.concatenate((a, b, own)), np.concatenate((b, a, own)), np.concatenate((v, v, (scale[own] > 0).astype(float)))
                yield pa.RecordBatch.from_pydict({"a": [names[k] for k in a], "b": [names[k] for k in b], "r": v})

    if not rows:  # no rows of df
        return df.sparkSession.createDataFrame([(a, b, 0.0) for a in names for b in names], "a string, b string, r double")
    return tiles.mapInArrow(pairs, "a string, b string, r double")


def high_correlations(matrix: DataFrame, threshold: float = 0.9) -> DataFrame:
    return matrix.filter((F.col("a") < F.col("b")) & (F.abs("r") > threshold))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, share, and whether it is the majority (first greatest) or minority (first least); ratio of the two."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.max("n").alias("_most"), F.min("n").alias("_least"), F.min(F.struct(-F.col("n"), "label"))["label"].alias("_major"), F.min(F.struct("n", "label"))["label"].alias("_minor"))
    return counts.join(F.broadcast(whole)).select(
        "label", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("label") == F.col("_major")).alias("is_majority"), (F.col("label") == F.col("_minor")).alias("is_minority"), (F.col("_most") / F.col("_least")).alias("ratio")
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> dict[str, tuple[float, float]]:
    q = quantiles(clean(df, columns), columns, (0.25, 0.75))
    return {c: (a - threshold * (b - a), b + threshold * (b - a)) for c, (a, b) in q.items() if a is not None}


def zscore_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> dict[str, tuple[float, float]]:
    got = clean(df, columns).agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (got[f"m_{c}"] - threshold * got[f"s_{c}"], got[f"m_{c}"] + threshold * got[f"s_{c}"]) for c in columns if got[f"s_{c}"]}


def outside(c: str, bounds: dict[str, tuple[float, float]]):
    if c not in bounds:
        return F.lit(False)
    lo, hi = bounds[c]
    return F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))


def outliers_by_feature(df: DataFrame, columns: Sequence[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    counts = clean(df, columns).agg(*[F.count_if(outside(c, bounds)).alias(c) for c in columns])
    return unpivoted(counts, columns).select("feature", F.col("value").cast("bigint").alias("outliers"))


def outliers_by_row(df: DataFrame, columns: Sequence[str], bounds: dict[str, tuple[float, float]], keys: Sequence[str]) -> DataFrame:
    total = sum((outside(c, bounds).cast("int") for c in columns), F.lit(0))
    return clean(df, columns).select(*keys, total.cast("bigint").alias("outliers"))


def missing_by_feature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, nan_count (NULL and NaN), inf_count, missing, percent."""
    cells = unpivoted(df, columns)
    inf = F.abs("value") == float("inf")
    nan = F.col("value").isNull() | F.isnan("value")
    return cells.groupBy("feature").agg(
        F.count_if(nan).alias("nan_count"), F.count_if(inf).alias("inf_count"), F.count_if(nan | inf).alias("missing"), (F.count_if(nan | inf) * 100.0 / F.count(F.lit(1))).alias("percent")
    )


def missing_by_row(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    cleaned = clean(df, columns)
    return cleaned.select(*keys, sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint")).alias("missing"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """feature, bin (0-based, the last closed) and n of non-empty bins of equal width."""
    cells = unpivoted(clean(df, columns), columns).filter("value is not null")
    ends = cells.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # a row a feature
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    return cells.join(F.broadcast(ends), "feature").groupBy("feature", F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
