"""Sums of products of many columns by tiles: each task adds up its own rows, tiles are merged by their key.

Rows are arrays of one length p. A task holds p x p sums while it runs, cut into tiles of ``TILE`` columns as it ends; no
expression and no row grows with p squared. Partial tiles of many tasks meet in two steps, ``FAN_IN`` at a time first,
so no merge reads those of all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a tile, partial sums merged by a task in the first step, and rows multiplied at a time.
TILE, FAN_IN, ROWS = 128, 64, 4096
_SCHEMA = "i int, j int, part int, n bigint, cells array<double>"
_NAMES = ["i", "j", "part", "n", "cells"]


def literal(values) -> Column:
    """An array of numbers as one constant, whatever its length; missing ones are null."""
    told = "[" + ",".join("null" if v is None or not math.isfinite(v) else repr(float(v)) for v in values) + "]"
    return F.from_json(F.lit(told), "array<double>")


def _flat(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def tiles(df: DataFrame, p: int, tile: int = TILE) -> DataFrame:
    """i, j, n and cells of the tiles i <= j of the sums of products of the array column x of df, all of length p >= 1.

    Entry 0 of the rows multiplied is 1, so that tiles hold the sums of the columns as well; columns follow from 1 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            rows = _flat(batch, p)
            for a in range(0, len(rows), ROWS):
                own = np.hstack((np.ones((len(rows[a : a + ROWS]), 1)), rows[a : a + ROWS]))
                total = own.T @ own if total is None else total + own.T @ own
            n += len(rows)
        if total is not None:
            part = TaskContext.get().partitionId() // FAN_IN
            for a in range(0, p + 1, tile):
                for b in range(a, p + 1, tile):
                    cells = total[a : a + tile, b : b + tile].ravel().tolist()
                    yield pa.RecordBatch.from_pydict({"i": pa.array([a], pa.int32()), "j": pa.array([b], pa.int32()), "part": pa.array([part], pa.int32()), "n": [n], "cells": [cells]})

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cells = t.column("cells").combine_chunks()
        total = cells.flatten().to_numpy().reshape(len(t), -1).sum(0)
        first = {c: t.column(c)[:1] for c in ("i", "j", "part")}
        return pa.table({**first, "n": [pc.sum(t.column("n")).as_py()], "cells": [total.tolist()]})

    own = df.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, _SCHEMA)
    some = own.groupBy("i", "j", "part").applyInArrow(merge, _SCHEMA).select("i", "j", F.lit(0).alias("part"), "n", "cells")
    return some.groupBy("i", "j").applyInArrow(merge, _SCHEMA).select("i", "j", "n", "cells")


def moments(df: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of the array column x, at the driver: p x p numbers."""
    total, n = np.zeros((p + 1, p + 1)), 0
    for r in tiles(df, p).collect():
        n, a, b = r.n, r.i, r.j
        rows = min(TILE, p + 1 - a)
        total[a : a + rows, b : b + TILE] = np.array(r.cells).reshape(rows, -1)
    total = np.triu(total) + np.triu(total, 1).T
    return n, total[0, 1:], total[1:, 1:]


def column_stats(df: DataFrame) -> dict[int, tuple]:
    """mean, population deviation, least and greatest of each place of the array column x; nulls and NaN left out."""
    long = df.select(F.posexplode("x").alias("at", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = long.groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # a row a place
    return {r["at"]: (r["mean"], r["std"], r["lo"], r["hi"]) for r in rows}


def column_quantiles(df: DataFrame, probabilities: tuple[float, ...]) -> dict[int, list[float]]:
    """Exact quantiles with linear interpolation of each place of the array column x; nulls and NaN left out."""
    from ..functions.order import running

    long = df.select(F.posexplode("x").alias("at", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    steps = running(long, "v", {"n": F.count(F.lit(1))}, ["at"])
    sizes = long.groupBy("at").agg(F.count(F.lit(1)).alias("size"))
    ranks = F.array(*[x for q in probabilities for x in (F.floor(F.lit(q) * (F.col("size") - 1)), F.ceil(F.lit(q) * (F.col("size") - 1)))])
    held = steps.join(F.broadcast(sizes.withColumn("ranks", ranks)), "at")  # a row a place
    held = held.withColumn("k", F.transform("ranks", lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n")))).filter(F.exists("k", lambda x: x))
    out: dict[int, list] = {}
    size = {}
    for r in held.select("at", "v", "size", "k").collect():  # at most two values a place and probability
        own = out.setdefault(r["at"], [None] * len(r["k"]))
        size[r["at"]] = r["size"]
        for i, mine in enumerate(r["k"]):
            if mine:
                own[i] = r["v"]
    share = lambda q, n: q * (n - 1) - math.floor(q * (n - 1))
    return {at: [own[2 * i] + (own[2 * i + 1] - own[2 * i]) * share(q, size[at]) for i, q in enumerate(probabilities)] for at, own in out.items()}
