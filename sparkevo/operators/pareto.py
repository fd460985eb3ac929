"""Non-dominated sorting, crowding and environmental selection for objectives that are all maximised.

Fronts are found many at a time: each task reduces its distinct objective rows to those of the first ``AT_ONCE``
fronts of its own (a row's rank among some rows is never greater than its rank among all), and these meet level by
level, in a tree of stages, until one task holds the first fronts of all and nothing else. With more than two
objectives further fronts take another round, written to the shared folder.

All fronts of two objectives take a wave over a grid of cells instead, cut at quantiles of both: a row's front is one
more than the greatest front of the rows that dominate it, and of these a cell needs one number for all cells that are
better in both, and for those of its row and of its column a step function of the other objective. Cells of one diagonal
are independent, so G x G cells take 2 G - 1 rounds, whatever the number of fronts; G grows with the square root of rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import MEET, neighbours, ordinals
from ..functions.shared import free, saved, scratch

#: Fronts that one round finds, and partial results that meet in a task of a tree of stages.
AT_ONCE, FAN_IN = 32, 16
#: Rows of a cell of the grid, if rows were even over it, and cells a side at most.
CELL, SIDES = 50_000, 256


def signed(df: DataFrame, objectives: dict[str, bool]) -> DataFrame:
    """df with obj_0.. as doubles, the minimised ones (False) negated; rows with a missing objective go."""
    out = df.withColumns({f"obj_{i}": (F.col(c) if up else -F.col(c)).cast("double") for i, (c, up) in enumerate(objectives.items())})
    return out.dropna(subset=[f"obj_{i}" for i in range(len(objectives))])


def _skyline(values: np.ndarray) -> np.ndarray:
    """Mask of rows that no other row dominates; rows are compared with the kept ones, best sums first."""
    order = np.argsort(-values.sum(1), kind="stable")
    kept, mask = np.empty((0, values.shape[1])), np.zeros(len(values), bool)
    for i in order:
        v = values[i]
        beats = (kept >= v).all(1) & (kept > v).any(1)
        if not beats.any():
            kept = np.vstack((kept, v))
            mask[i] = True
    return mask


def local_ranks(values: np.ndarray, most: int) -> np.ndarray:
    """The front of each distinct row of values, most where it is beyond the first most."""
    out = np.full(len(values), most, np.int64)
    if values.shape[1] == 2:
        # By falling first objective (then second), a row is dominated by those fronts whose greatest second objective
        # so far is no less than its own; these maxima fall from front to front, so bisection finds its front.
        tops: list[float] = []  # the maxima, negated
        for i in np.lexsort((-values[:, 1], -values[:, 0])):
            at = bisect_right(tops, -values[i, 1])
            if at < most:
                out[i] = at
                tops[at : at + 1] = [-values[i, 1]]
        return out
    left = np.arange(len(values))
    for k in range(most):
        if not len(left):
            break
        own = _skyline(values[left])
        out[left[own]] = k
        left = left[~own]
    return out


def fronts(df: DataFrame, n: int, most: int) -> DataFrame:
    """obj_0..obj_{n-1} and pareto_rank of the distinct objective rows of df in the first most fronts."""
    names = [f"obj_{i}" for i in range(n)]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rank = np.zeros((0, n)), np.zeros(0, np.int64)
        for b in batches:
            held = np.unique(np.concatenate((held, b[names].to_numpy(float))), axis=0)
            rank = local_ranks(held, most)
            held, rank = held[rank < most], rank[rank < most]
        yield pd.DataFrame(held, columns=names).assign(pareto_rank=rank)

    schema = ", ".join(f"{c} double" for c in names) + ", pareto_rank int"
    best = df.select(*names).distinct().mapInPandas(reduce, schema)
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        best = best.repartition(parts).mapInPandas(reduce, schema)
    return best


def front(df: DataFrame, n: int) -> DataFrame:
    """Rows of df (with obj_0..obj_{n-1}) that no row dominates."""
    return df.join(fronts(df, n, 1), [f"obj_{i}" for i in range(n)], "left_semi")


def _steps(x: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step function of the greatest rank among all x that are no less: falling x, rising ranks."""
    order = np.lexsort((-rank, -x))
    x, rank = x[order], rank[order]
    first = np.ones(len(x), bool)
    first[1:] = rank[1:] > np.maximum.accumulate(rank)[:-1]
    return x[first], rank[first]


def _at(steps: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The greatest rank at x, -1 where there is none."""
    place = np.searchsorted(-steps[0], -x, "right")
    return np.append(steps[1], -1)[place - 1] if len(steps[0]) else np.full(len(x), -1, np.int64)


def chained(values: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Fronts of distinct rows of two objectives, none below its least."""
    out = np.empty(len(values), np.int64)
    ys: list[float] = []  # of the rows so far: negated second objectives, rising, and the greatest front up to each
    tops: list[int] = []
    for i in np.lexsort((-values[:, 1], -values[:, 0])).tolist():
        y = -values[i, 1]
        at = bisect_right(ys, y)
        rank = max(int(least[i]), tops[at - 1] + 1 if at else 0)
        out[i] = rank
        end = at
        while end < len(tops) and tops[end] <= rank:
            end += 1
        ys[at:end], tops[at:end] = [y], [rank]
    return out


_WAVE = "i int, j int, kind int, obj_0 double, obj_1 double, pareto_rank int, xs array<double>, tops array<int>"


def _cell(base: dict[tuple[int, int], int]):
    """Fronts of the rows of one cell (kind 0), and the step functions that its row (1) and column (2) hand on."""

    def run(key: tuple[pa.Scalar, ...], points: pa.Table, handed: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        v = np.column_stack([points.column(c).to_numpy() for c in ("obj_0", "obj_1")])
        held = {1: (np.zeros(0), np.zeros(0, np.int64)), 2: (np.zeros(0), np.zeros(0, np.int64))}
        for r in handed.select(["kind", "xs", "tops"]).to_pylist():
            held[r["kind"]] = np.array(r["xs"], float), np.array(r["tops"], np.int64)
        least = np.maximum(base.get((i, j), -1), np.maximum(_at(held[1], v[:, 0]), _at(held[2], v[:, 1]))) + 1
        rank = chained(v, least)
        out = {"i": [i] * len(v), "j": [j] * len(v), "kind": [0] * len(v), "obj_0": v[:, 0].tolist(), "obj_1": v[:, 1].tolist(), "pareto_rank": rank.tolist(), "xs": [None] * len(v), "tops": [None] * len(v)}
        for kind, at, to in ((1, 0, (i, j + 1)), (2, 1, (i + 1, j))):
            xs, tops = _steps(np.concatenate((held[kind][0], v[:, at])), np.concatenate((held[kind][1], rank)))
            row = {"i": to[0], "j": to[1], "kind": kind, "obj_0": None, "obj_1": None, "pareto_rank": int(rank.max(initial=-1)), "xs": xs.tolist(), "tops": tops.tolist()}
            for c, x in row.items():
                out[c].append(x)
        types = {"obj_0": pa.float64(), "obj_1": pa.float64(), "xs": pa.list_(pa.float64()), "tops": pa.list_(pa.int32())}
        return pa.table({c: pa.array(x, types.get(c, pa.int32())) for c, x in out.items()})

    return run


def all_fronts(df: DataFrame) -> DataFrame:
    """obj_0, obj_1 and pareto_rank of the distinct rows of two objectives, of all fronts."""
    spark = df.sparkSession
    distinct = saved(df.select("obj_0", "obj_1").distinct(), "distinct")
    side = max(1, min(SIDES, math.ceil(math.sqrt(distinct.count() / CELL))))
    cuts = {c: sorted(set(distinct.agg(F.percentile_approx(c, F.lit([k / side for k in range(1, side)]), F.lit(100 * side))).first()[0] or [])) if side > 1 else [] for c in ("obj_0", "obj_1")}

    def placed(c: str) -> Column:  # 0 holds the best values
        at = F.aggregate(F.array(*[F.lit(float(x)) for x in cuts[c]]).cast("array<double>"), F.lit(0), lambda n, x: n + (F.col(c) < x).cast("int"))
        return at if cuts[c] else F.lit(0)

    rows, columns = (len(cuts[c]) + 1 for c in ("obj_0", "obj_1"))
    grid = distinct.withColumns({"i": placed("obj_0"), "j": placed("obj_1")}).withColumn("wave", F.col("i") + F.col("j"))
    source, out = scratch(spark, "grid"), scratch(spark, "wave")
    grid.write.partitionBy("wave").parquet(source)
    grid = spark.read.schema("obj_0 double, obj_1 double, i int, j int, wave int").parquet(source)
    handed = spark.createDataFrame([], _WAVE)
    best: dict[tuple[int, int], int] = {}  # greatest front of all cells up to one, a number a cell
    for wave in range(rows + columns - 1):
        cells = [(i, wave - i) for i in range(rows) if 0 <= wave - i < columns]
        base = {(i, j): best.get((i - 1, j - 1), -1) for i, j in cells}
        points = grid.filter(F.col("wave") == wave).select("i", "j", "obj_0", "obj_1")
        told = handed.filter(f"i < {rows} and j < {columns}").select(F.col("i").alias("to_i"), F.col("j").alias("to_j"), "kind", "xs", "tops")
        points.groupBy("i", "j").cogroup(told.groupBy("to_i", "to_j")).applyInArrow(_cell(base), _WAVE).write.parquet(f"{out}/wave={wave}")
        done = spark.read.schema(_WAVE).parquet(f"{out}/wave={wave}")
        handed = done.filter("kind > 0")
        top = {(r.i, r.j - 1): r.pareto_rank for r in handed.filter("kind = 1").select("i", "j", "pareto_rank").collect()}  # a number a cell
        for i, j in cells:
            best[i, j] = max(top.get((i, j), -1), best.get((i - 1, j), -1), best.get((i, j - 1), -1))
    found = spark.read.schema(_WAVE + ", wave int").parquet(out)
    return found.filter("kind = 0").select("obj_0", "obj_1", "pareto_rank")


def ranks(df: DataFrame, n: int, most: int | None = None, rows: int | None = None) -> DataFrame:
    """df with pareto_rank (0 first), of all fronts, of the first most, or of as many as hold rows rows."""
    names = [f"obj_{i}" for i in range(n)]
    if n == 2 and (most is None or most > AT_ONCE):
        found = df.join(all_fronts(df).hint(MEET), names)
        if most is not None:
            found = found.filter(F.col("pareto_rank") < most)
        if rows is None:
            return found
        found = saved(found, "ranked")
        sizes = found.groupBy("pareto_rank").agg(F.count(F.lit(1)).alias("_n"))  # a row a front
        before = sizes.select("pareto_rank", F.coalesce(F.sum("_n").over(Window.orderBy("pareto_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        last = before.filter(F.col("_before") < rows).agg(F.max("pareto_rank")).first()[0]
        return found.filter(F.col("pareto_rank") <= (-1 if last is None else last))
    rest, found, rank, held = df, None, 0, 0
    while (most is None or rank < most) and (rows is None or held < rows):
        step = AT_ONCE if most is None else min(AT_ONCE, most - rank)
        own = saved(fronts(rest, n, step).withColumn("pareto_rank", F.col("pareto_rank") + rank), "fronts")
        ranked = saved(rest.join(own.hint(MEET), names), "ranked")
        found, rank = ranked if found is None else found.unionByName(ranked), rank + step
        at = ranked.agg(F.count(F.lit(1)).alias("n"), F.max("pareto_rank").alias("last")).first()
        held += at.n
        if at.last is None or at.last < rank - 1:
            break  # the last fronts are not filled: nothing is left
        rest = saved(rest.join(own.select(*names).hint(MEET), names, "left_anti"), "rest")
    return found


def crowding(df: DataFrame, n: int, id_: str, by: Sequence[str] = ("pareto_rank",)) -> DataFrame:
    """df with crowding: per front and objective the gap of a row's neighbours over the range, summed; ends infinite."""
    total, ends = F.lit(0.0), F.lit(False)
    lo, hi = ([free(df, f"{k}_{i}") for i in range(n)] for k in ("_lo", "_hi"))
    before, after = ([free(df, f"{k}_{i}") for i in range(n)] for k in ("_before", "_after"))
    span = df.groupBy(*by).agg(*[f(f"obj_{i}").alias(c[i]) for i in range(n) for f, c in ((F.min, lo), (F.max, hi))])
    for i in range(n):
        df = neighbours(df, f"obj_{i}", id_, by, before[i], after[i])
        ends = ends | F.col(before[i]).isNull() | F.col(after[i]).isNull()
        total = total + F.coalesce(F.try_divide(F.col(after[i]) - F.col(before[i]), F.col(hi[i]) - F.col(lo[i])), F.lit(0.0))
    df = df.join(span, list(by))  # a row a front
    return df.withColumn("crowding", F.when(ends, F.lit(float("inf"))).otherwise(total)).drop(*lo, *hi, *before, *after)


def survivors(df: DataFrame, n: int, id_: str) -> DataFrame:
    """The first n rows by rank, then greater crowding, then id: whole fronts, and the last one in part."""
    df = saved(df, "crowded")
    sizes = df.groupBy("pareto_rank").agg(F.count(F.lit(1)).alias("n"))  # a row a front
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy("pareto_rank")) - F.col("n")).filter(F.col("before") < n)
    last = sizes.agg(F.max("pareto_rank").alias("last"), F.max("before").alias("before")).first()
    if last.last is None:
        return df.limit(0)
    place = free(df, "_place")
    part = ordinals(df.filter(F.col("pareto_rank") == last.last), "crowding", id_, descending=True, name=place).filter(F.col(place) <= n - last.before).drop(place)
    return df.filter(F.col("pareto_rank") < last.last).unionByName(part)


def crowding_select(front_: DataFrame, n_objectives: int, id_: str, k: int) -> DataFrame:
    """The k rows of one front of greatest crowding, ties to the least id; all of them where there are no more than k."""
    return survivors(crowding(front_.withColumn("pareto_rank", F.lit(0)), n_objectives, id_), k, id_)


def best_of(entries: DataFrame, draw: str, id_: str) -> DataFrame:
    """draw, id: of each draw's entries the one of least rank, then greatest crowding, then least id."""
    best = entries.groupBy(draw).agg(F.min(F.struct("pareto_rank", -F.col("crowding"), id_)).alias("b"))
    return best.select(draw, F.col(f"b.{id_}").alias(id_))
