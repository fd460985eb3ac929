"""Exact nearest neighbours of a stated query set against all rows, in blocks, and what builds on them.

Each task keeps the k best of its rows for every query of a block, and the candidates (k a query and task) meet by query.
No pair of rows is written out. Few rows are read by every block of queries in turn, as a broadcast of bounded size.

Beyond ``FEW`` rows an index of pivots comes first: rows belong to their nearest pivot and lie sorted by cell and distance
to it, blocks are queries of cells beside each other, and the triangle inequality rules out, for the queries of a cell,
whole cells and all but a ring of others, from the k-th best distance so far (that to the pivots, which are rows, to begin
with). Where rows form clusters most comparisons fall away; on evenly spread ones of many dimensions hardly any do, and
once some cells of a block have shown this its queries see all rows in large tiles. Blocks of queries and of rows meet by
shuffle, a pair of blocks a task; only the pivots come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import uniform
from ..functions.order import few, latest, null_safe_join
from ..functions.shared import discard, saved
from .prepare import shuffled_rank
from .select import picked

#: Bytes of the vectors of a block of queries; a block of rows has twice as many.
BLOCK = 24 << 20
#: Rows of a block that are sent as one, and queries and rows whose distances are found at once.
PIECE, QUERIES, ROWS = 2048, 512, 1024
#: Cells of queries that must rule out hardly anything, with none before that did, for others not to be tried.
TRIED = 16
#: Entries of vectors that levels may stand for, sum of a vector's levels, queries and rows whose levels are compared at once.
LEVELLED, MOST, TOGETHER, LEVEL_ROWS = 512, 16_000, 16, 512
#: Candidates by levels that are judged together, and candidates whose differences are found at once.
LEVELS_HELD, JUDGED = 1024, 256


#: Bytes of the pivots, and their number at most.
PIVOT_BYTES, PIVOTS = 4 << 20, 512


def distances(x: np.ndarray, y: np.ndarray, manhattan: bool) -> np.ndarray:
    """Of each row of x to each of y."""
    if manhattan:
        return np.stack([np.abs(y - v).sum(1) for v in x]) if len(x) else np.zeros((0, len(y)))
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))


def _matrix(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1)


def _places(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of flags, a multiple of eight in a row, few of them set: eight are looked at at once."""
    flat = close.reshape(-1)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flat[at]], close.shape[1])


class _Told(NamedTuple):
    """Rows as they were given, and coarse: what _Top finds candidates with, and how far off that may be."""

    rows: np.ndarray
    own: np.ndarray
    labels: np.ndarray
    coarse: np.ndarray
    off: np.ndarray

    def taken(self, at) -> _Told:
        return _Told(*(x[at] for x in self))


class _Top:
    """The k best of the rows seen, once or again, for each query, ties to the least id; most is a distance that the k-th does not exceed.

    Candidates are found coarsely, with a bound that leaves none out, and judged by the differences in full precision.
    Squared distances are found as one product of single precision, around the mean of the queries. Manhattan ones are
    at least the sum of the differences of the entries' levels, less what both rows lie off their levels; that sum is the
    sum of all levels less twice that of the smaller ones, which 16 bits hold.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int, same_class: bool, manhattan: bool, most: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.labels, self.k, self.same_class, self.manhattan = ids, vectors, labels, k, same_class, manhattan
        self.d = np.full((len(ids), k), np.inf)
        self.i = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.label = np.zeros((len(ids), k), np.int64)
        self.most = np.full(len(ids), np.inf) if most is None else most if manhattan else most**2
        self.width = vectors.shape[1]
        known = np.isfinite(vectors)
        self.shift = np.where(known, vectors, 0).sum(0) / np.maximum(known.sum(0), 1)
        self.levels = manhattan and 0 < self.width <= LEVELLED
        if self.levels:
            every = max(1, len(vectors) // QUERIES)
            some = np.where(known, vectors - self.shift, 0)[::every]
            self.top = MOST // (2 * self.width)
            steps = [max(np.abs(some).max(initial=0), 1e-300) / self.top / 2**i for i in range(6)]
            self.step = min(steps, key=lambda step: np.abs(some - step * np.clip(np.rint(some / step), -self.top, self.top)).sum())
        self.told = self.tell(vectors, ids, labels)
        # New arrays of this size would come from the system each time, which takes longer than what is done with them.
        self.apart = np.empty((2, JUDGED, self.width))
        self.tile = np.empty(0 if manhattan else QUERIES * ROWS, self.told.coarse.dtype)
        self.close = np.empty(QUERIES * ROWS, bool)

    def tell(self, rows: np.ndarray, own: np.ndarray, labels: np.ndarray) -> _Told:
        centred = rows - self.shift
        if self.levels:
            level = np.clip(np.rint(centred / self.step), -self.top, self.top)
            off = np.abs(centred - level * self.step).sum(1) + 1e-15 * self.width * (np.abs(rows) + np.abs(self.shift)).sum(1)
            coarse = (np.nan_to_num(level) + self.top).astype(np.int16)
        elif self.manhattan:
            coarse, off = rows, np.zeros(len(rows))
        else:
            square = (centred**2).sum(1)
            kind = np.float32 if square.max(initial=0) < 1e34 else np.float64
            coarse = np.hstack((centred, square[:, None], np.ones((len(rows), 1)))).astype(kind)
            off = 4 * (self.width + 2) * (2.0**-23 * square + 2.0**-50 * (rows**2).sum(1)) + 1e-30
        return _Told(rows, own, labels, coarse, np.where(np.isfinite(off), off, 0))  # without a finite distance no row is near

    def _squares(self, q: np.ndarray, told: _Told) -> np.ndarray:
        """Squared distances, off by no more than the sum of what both sides say."""
        own = self.told.coarse[q]
        left = np.hstack((-2 * own[:, :-2], own[:, -1:], own[:, -2:-1]))
        return np.matmul(left, told.coarse.T, out=self.tile[: len(q) * len(told.own)].reshape(len(q), -1))

    def limit(self, q: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[q, -1], self.most[q])

    def _other(self, q: np.ndarray, told: _Told) -> np.ndarray:
        """Which rows are the query itself, or of another class where that matters."""
        other = self.ids[q][:, None] == told.own[None, :]
        return other | (self.labels[q][:, None] != told.labels[None, :]) if self.same_class else other

    def see(self, q: np.ndarray, told: _Told) -> None:
        """Rows told, for the queries of numbers q."""
        if self.levels:
            return self._see_levels(q, told)
        for a in range(0, len(q), QUERIES):
            own, held = q[a : a + QUERIES], []
            for c in range(0, len(told.own), ROWS):
                at, found = self._tile(own, told.taken(slice(c, c + ROWS)))
                self._hold(held, own[at], found + c, 4 * len(own) if c else 0, told)
            self._hold(held, own[:0], own[:0], 0, told)

    def _hold(self, held: list, q: np.ndarray, c: np.ndarray, enough: int, told: _Told) -> bool:
        """Keeps candidates, rows c of queries q, until there are enough, and judges them, which lowers the limits."""
        if len(q):
            held.append((q, c))
        elif enough:
            return False
        if not held or sum(len(x) for x, _ in held) < enough:
            return False
        self._merge(*map(np.concatenate, zip(*held)), told)
        held.clear()
        return True

    def _tile(self, q: np.ndarray, told: _Told) -> tuple[np.ndarray, np.ndarray]:
        """Places in q, and rows, of candidates."""
        d = distances(self.vectors[q], told.rows, True) if self.manhattan else self._squares(q, told)
        limit, n = self.limit(q), d.shape[1]
        unbound = np.flatnonzero(np.isinf(limit))
        if len(unbound) and n > self.k:
            some = d[unbound]
            some[self._other(q[unbound], told)] = np.inf
            limit[unbound] = np.partition(some, self.k - 1, 1)[:, self.k - 1]
        limit = limit * (1 + 1e-6) + 2 * (self.told.off[q] + told.off.max(initial=0))
        size = -(-n // 8) * 8
        close = self.close[: len(q) * size].reshape(len(q), size)
        close[:, n:] = False
        np.less_equal(d, limit[:, None].astype(d.dtype), out=close[:, :n])
        if self.same_class:
            close[:, :n] &= self.labels[q][:, None] == told.labels[None, :]
        return _places(close)

    def _see_levels(self, q: np.ndarray, told: _Told) -> None:
        """Some queries at a time; their candidates are judged when there are many, which lowers the limits."""
        size = min(LEVEL_ROWS, -(-len(told.own) // 8) * 8)
        tiles = [self._tiled(told.coarse[c : c + size], size) for c in range(0, len(told.own), size)]
        summed = lambda x: x.sum(1, dtype=np.int32)
        half = np.full(len(tiles) * size, MOST + 1, np.int16)  # none of the rows that fill the last tile
        half[: len(told.own)] = np.clip(np.floor((summed(told.coarse) - told.off / self.step) / 2), -MOST, None)
        wide = np.empty((TOGETHER, self.width, size), np.int16)
        smaller, sums, close = np.empty_like(wide), np.empty((TOGETHER, size), np.int16), np.empty((TOGETHER, size), bool)
        for a in range(0, len(q), TOGETHER):
            own, held, least = q[a : a + TOGETHER], [], None
            wide, smaller, sums, close = (x[: len(own)] for x in (wide, smaller, sums, close))
            far = summed(self.told.coarse[own])
            wide[:] = self.told.coarse[own][:, :, None]
            for t, tile in enumerate(tiles):
                if least is None:
                    most = (self.limit(own) * (1 + 1e-9) + self.told.off[own]) / self.step
                    least = np.clip(np.floor((far - most) / 2), -MOST, None).astype(np.int16)[:, None]
                np.minimum(wide, tile, out=smaller)
                np.add.reduce(smaller, axis=1, dtype=np.int16, out=sums)
                np.subtract(sums, half[t * size : (t + 1) * size], out=sums)
                at, c = _places(np.greater_equal(sums, least, out=close))
                if self._hold(held, own[at], c + t * size, LEVELS_HELD, told):
                    least = None
            self._hold(held, own[:0], own[:0], 0, told)

    @staticmethod
    def _tiled(coarse: np.ndarray, size: int) -> np.ndarray:
        tile = np.zeros((coarse.shape[1], size), np.int16)
        tile[:, : len(coarse)] = coarse.T
        return tile

    def _distances(self, at: np.ndarray, c: np.ndarray, told: _Told) -> np.ndarray:
        """Of rows c of those told to queries at, by the differences."""
        found = np.empty(len(at))
        for a in range(0, len(at), JUDGED):
            rows, own = self.apart[:, : len(at[a : a + JUDGED])]
            np.take(told.rows, c[a : a + JUDGED], 0, out=rows, mode="clip")
            np.take(self.vectors, at[a : a + JUDGED], 0, out=own, mode="clip")
            np.subtract(rows, own, out=rows)
            np.abs(rows, out=rows) if self.manhattan else np.multiply(rows, rows, out=rows)
            np.add.reduce(rows, 1, out=found[a : a + JUDGED])
        return found

    def _merge(self, at: np.ndarray, c: np.ndarray, told: _Told) -> None:
        """Rows c of those told, candidates of queries at, among the best so far."""
        k, own = self.k, told.own[c]
        keep = self.ids[at] != own
        if self.same_class:
            keep &= self.labels[at] == told.labels[c]
        at, c, own = at[keep], c[keep], own[keep]
        dd = self._distances(at, c, told)
        ahead = (dd < self.d[at, -1]) | ((dd == self.d[at, -1]) & (own < self.i[at, -1]))
        if not ahead.any():
            return
        at, c, own, dd = at[ahead], c[ahead], own[ahead], dd[ahead]
        touched = np.unique(at)
        every = np.concatenate((np.repeat(touched, k), at))
        dd, ii, ll = (np.concatenate((held[touched].ravel(), x)) for held, x in ((self.d, dd), (self.i, own), (self.label, told.labels[c])))
        order = np.lexsort((ii, dd, every))
        e, d, i = every[order], dd[order], ii[order]
        order = order[np.append(True, (e[1:] != e[:-1]) | (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | np.isinf(d[1:]))]  # a row may be seen twice
        first = np.searchsorted(every[order], touched)  # every query has k at least
        best = order[first[:, None] + np.arange(k)[None, :]]
        self.d[touched], self.i[touched], self.label[touched] = dd[best], ii[best], ll[best]

    def batch(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_pydict({"id": self.ids[q], "nb": self.i[q, j], "nb_label": self.label[q, j], "distance": self.d[q, j]})


_NEAR = "id bigint, nb bigint, nb_label bigint, distance double"


def _best(held, k: int, same_class: bool, manhattan: bool, counter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(*held.value[:3], k, same_class, manhattan)
        for b in batches:
            if not b.num_rows:
                continue
            top.see(np.arange(len(top.ids)), top.tell(_matrix(b), b.column("id").to_numpy(), b.column("label").to_numpy()))
            if counter is not None:
                counter.add(b.num_rows * len(top.ids))
        yield top.batch()

    return run


#: Numbers of a piece, and their types; vectors are of one length.
_PACKED = {"ids": np.int64, "labels": np.int64, "cells": np.int32, "far": np.float64, "most": np.float64, "vectors": np.float64}


def _best_of_cells(held, k: int, same_class: bool, manhattan: bool, counter):
    """The best of a block of rows for a block of queries, both in pieces; cells near the queries of a cell are seen first."""

    def unpacked(pieces: list[dict]) -> list[np.ndarray]:
        got = [np.concatenate([np.frombuffer(p[n], t) for p in pieces]) for n, t in _PACKED.items()]
        order = np.lexsort((got[0], got[3], got[2]))  # cell, far, id
        return [*(x[order] for x in got[:-1]), got[-1].reshape(len(order), -1)[order]]

    def cells_of(cells: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(cells, prepend=-1))
        return list(zip(cuts.tolist(), np.append(cuts[1:], len(cells)).tolist()))

    def met(asked: list[dict], seen: list[dict]) -> pa.RecordBatch:
        between, compared = held.value, 0
        ids, labels, cells, to_pivot, most, vectors = unpacked(asked)
        own, label, cell, far, _, rows = unpacked(seen)
        top = _Top(ids, vectors, labels, k, same_class, manhattan, most)
        told, dense = top.tell(rows, own, label), []
        few = max(4 * k, min(ROWS // 4, len(rows) // 64))
        segments, every = cells_of(cell), np.arange(len(rows))
        heads = cell[[a for a, _ in segments]]
        asking = cells_of(cells)
        for tried, at in enumerate(np.random.default_rng(0).permutation(len(asking))):
            first, last = asking[at]
            queries = np.arange(first, last)
            if len(dense) == tried >= TRIED:  # so it is for these, too
                dense.append(queries)
                compared += len(rows) * (last - first)
                continue
            apart, radius, size, rounds = between[cells[first]], to_pivot[first:last].max(), few, 0
            gap, kept = apart[cell], np.concatenate([every[slice(*segments[i])] for i in np.argsort(apart[heads], kind="stable")])
            while len(kept):
                top.see(queries, told.taken(kept[:size]))
                compared += min(size, len(kept)) * (last - first)
                limit, kept = top.limit(queries).max(), kept[size:]
                reach = radius + (limit if manhattan else np.sqrt(limit)) * (1 + 1e-9) + 1e-9
                kept = kept[np.abs(gap[kept] - far[kept]) <= reach]
                if rounds == 2 and 8 * len(kept) > 7 * len(rows):  # hardly any is ruled out: these queries see all, in large tiles
                    dense.append(queries)
                    compared += len(rows) * (last - first)
                    break
                size, rounds = size * 3 // 2, rounds + 1
        if dense:
            top.see(np.concatenate(dense), told)
        if counter is not None:
            counter.add(int(compared))
        return top.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, pieces = -1, ([], [])
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["pair"] != pair:
                    if all(pieces):
                        yield met(*pieces)
                    pair, pieces = piece["pair"], ([], [])
                pieces[piece["side"]].append(piece)
        if all(pieces):
            yield met(*pieces)

    return run


def _celled(rows: DataFrame, held, k: int, same_class: bool, manhattan: bool) -> DataFrame:
    """rows with cell, the number of the nearest pivot, far, the distance to it, and most, that to the k-th pivot which may be a neighbour (infinite without one, or for k = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pivots, classes = held.value
        away = lambda x, y: np.abs(x - y).sum(-1) if manhattan else np.sqrt(((x - y) ** 2).sum(-1))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                b = batch.slice(a, ROWS)
                x, most = _matrix(b), np.full(b.num_rows, np.inf)
                d = distances(x, pivots, manhattan)
                cell = d.argmin(1)
                if 0 < k <= len(pivots):
                    d[b.column("id").to_numpy()[:, None] == own[None, :]] = np.inf
                    if same_class:
                        d[b.column("label").to_numpy()[:, None] != classes[None, :]] = np.inf
                    near = np.argpartition(d, k - 1, 1)[:, :k]
                    known = np.isfinite(np.take_along_axis(d, near, 1)).all(1)
                    most[known] = away(x[known][:, None], pivots[near[known]]).max(1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "features")), pa.array(cell.astype(np.int32)), pa.array(away(x, pivots[cell])), pa.array(most)], names=["id", "label", "features", "cell", "far", "most"])

    return rows.mapInArrow(run, "id bigint, label bigint, features array<double>, cell int, far double, most double")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows of _celled as pieces of bytes, with part, the number of their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                b = batch.slice(a, PIECE)
                numbers = [*(b.column(c).to_numpy() for c in ("id", "label", "cell", "far", "most")), _matrix(b)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{n: pa.array([x.astype(t).tobytes()], pa.binary()) for (n, t), x in zip(_PACKED.items(), numbers)}})

    return rows.mapInArrow(run, "part int, " + ", ".join(f"{n} binary" for n in _PACKED))


def _indexed(queries: DataFrame, rows: DataFrame, n: int, k: int, same_class: bool, manhattan: bool, width: int, counter) -> DataFrame:
    """The candidates of n queries, by blocks of rows: each block of queries meets each block of rows in a task of its own."""
    spark, size = rows.sparkSession, rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, PIVOT_BYTES // (8 * width), math.isqrt(size)))).toPandas()
    pivots = np.stack(chosen["features"].to_numpy()).astype(float)
    order = np.argsort((pivots - pivots.mean(0)) @ np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0])  # near pivots get near numbers
    pivots = pivots[order]
    between = np.stack([np.abs(pivots - v).sum(1) if manhattan else np.sqrt(((pivots - v) ** 2).sum(1)) for v in pivots])
    told = spark.sparkContext.broadcast((chosen["id"].to_numpy()[order], pivots, chosen["label"].to_numpy()[order]))
    held = spark.sparkContext.broadcast(between)
    blocks, others = max(1, -(-n * 8 * width // BLOCK)), max(1, -(-size * 8 * width // (2 * BLOCK)))
    more = -(-2 * spark.sparkContext.defaultParallelism // (blocks * others))
    blocks, others = (blocks * more, others) if 4 * n > size else (blocks, others * more)  # many queries have k candidates for each block of rows
    stored = saved(_packed(_celled(rows, told, 0, same_class, manhattan).repartitionByRange(others, "cell", "far", "id")), "cells")
    asked = saved(_packed(_celled(queries, told, k, same_class, manhattan).repartitionByRange(blocks, "cell", "id")), "asked")
    blocks, others = ((d.agg(F.max("part")).first()[0] or 0) + 1 for d in (asked, stored))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("other", numbers(others)).select((F.col("part") * others + F.col("other")).alias("pair"), F.lit(0).alias("side"), *_PACKED)
    right = stored.withColumn("other", numbers(blocks)).select((F.col("other") * others + F.col("part")).alias("pair"), F.lit(1).alias("side"), *_PACKED)
    met = left.unionByName(right).repartitionById(blocks * others, F.col("pair")).sortWithinPartitions("pair")
    near = saved(met.mapInArrow(_best_of_cells(held, k, same_class, manhattan, counter), _NEAR), "near")
    for d in (stored, asked):
        discard(d)
    for b in (told, held):
        b.destroy()
    return near


def nearest(rows: DataFrame, is_query: Column, k: int, same_class: bool = False, donors: Column | None = None, metric: str = "euclidean", counter=None) -> DataFrame:
    """id, nb, nb_label, distance (squared Euclidean, or manhattan), place 1..k of the nearest other rows (donors) of every query row.

    rows has id (whole), label (whole) and features (array of numbers, all of one length); ties go to the least id.
    counter, an accumulator, gets the number of comparisons.
    """
    spark = rows.sparkSession
    shaped = lambda d: d.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("label").cast("bigint"), F.lit(-1)).alias("label"), F.col("features").cast("array<double>").alias("features"))
    queries, rows = shaped(rows.filter(is_query)), shaped(rows if donors is None else rows.filter(donors))
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    manhattan = metric == "manhattan"
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    found = []
    if n and width and not few(rows):
        found.append(_indexed(queries, rows, n, k, same_class, manhattan, width, counter))
    else:
        blocks = -(-n * 8 * max(1, width or 1) // BLOCK)
        for b in range(blocks):
            own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # BLOCK bytes
            if not len(own):
                continue
            own = own.combine_chunks().to_batches()[0]
            held = spark.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own), own.column("label").to_numpy()))
            part = rows.mapInArrow(_best(held, k, same_class, manhattan, counter), _NEAR)
            found.append(saved(part, "near") if blocks > 1 else part)
            if blocks > 1:
                held.destroy()
    if not found:
        return spark.createDataFrame([], _NEAR + ", place int")
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("distance", "nb"))).filter(F.col("place") <= k)


def vote(near: DataFrame, weighted: bool = False) -> DataFrame:
    """id, prediction: the class of most neighbours, or most 1/distance; ties to the least class."""
    w = 1 / F.greatest(F.sqrt("distance"), F.lit(1e-12)) if weighted else F.lit(1.0)
    votes = near.groupBy("id", "nb_label").agg(F.sum(w).alias("w"))
    return votes.groupBy("id").agg(F.min(F.struct(-F.round("w", 9), "nb_label"))["nb_label"].alias("prediction"))


def density(near: DataFrame, majority: int) -> DataFrame:
    """id, density (share of neighbours of the majority class), weight (its share of all densities)."""
    d = near.groupBy("id").agg(F.avg((F.col("nb_label") == majority).cast("double")).alias("density"))
    w = d.agg(F.sum("density").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return d.join(F.broadcast(w)).select("id", "density", F.when(F.col("_s") > 0, F.col("density") / F.col("_s")).otherwise(1 / F.col("_n")).alias("weight"))


def targets(counts: DataFrame, ratio: float | dict | None = None) -> DataFrame:
    """label, n, needed: rows to make per class; None raises each to the majority, a number or map adds int(n * ratio)."""
    most = counts.agg(F.max("n").alias("_most"))
    if ratio is None:
        needed = F.col("_most") - F.col("n")
    else:
        share = F.lit(float(ratio)) if not isinstance(ratio, dict) else F.coalesce(F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv])[F.col("label")].cast("double"), F.lit(0.0))
        needed = F.when(F.col("n") < F.col("_most"), F.floor(F.col("n") * share)).otherwise(0)
    return counts.join(F.broadcast(most)).select("label", "n", needed.cast("bigint").alias("needed"))


def interpolated(rows: DataFrame, near: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """draws (id, draw) with label and features: a point between row id and a hash-drawn neighbour of its, or the row itself without one."""
    k = near.groupBy("id").agg(F.max("place").alias("_k"))
    place = (F.floor(uniform(seed, F.col("id"), F.col("draw"), F.lit("nb")) * F.col("_k")) + 1).cast("int")
    ends = draws.join(k, "id", "left").withColumn("place", place).withColumn("gap", uniform(seed, F.col("id"), F.col("draw"), F.lit("gap")))
    ends = ends.join(near.select("id", "place", "nb"), ["id", "place"], "left")
    vec = rows.select("id", "label", F.col("features").cast("array<double>").alias("_x"))
    made = ends.join(vec, "id").join(vec.select(F.col("id").alias("nb"), F.col("_x").alias("_y")), "nb", "left")
    between = F.zip_with("_x", "_y", lambda x, y: x + F.col("gap") * (y - x))
    return made.select("id", "draw", "label", F.when(F.col("_y").isNull(), F.col("_x")).otherwise(between).alias("features"))


def synthetic(rows: DataFrame, near: DataFrame, copies: int, seed: int = 42) -> DataFrame:
    """id, draw, label, features: `copies` points between each query row and a hash-drawn neighbour of its class."""
    draws = near.select("id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return interpolated(rows, near, draws, seed)


def drawn(rows: DataFrame, needed: DataFrame, seed: int = 42) -> DataFrame:
    """label, draw (1..needed) and id: rows of each class drawn with replacement by hash, needed (label, n, needed) of them."""
    return _drawn(rows, _numbered(needed), seed).select("label", "draw", "id")


def _numbered(needed: DataFrame) -> DataFrame:
    """needed, a row a class, with the number of rows made for the classes before it."""
    before = F.sum("needed").over(Window.orderBy(F.col("label").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    return saved(needed.filter("needed > 0").select("label", "n", "needed", F.coalesce(before, F.lit(0)).cast("bigint").alias("_start")), "needed")


def _drawn(rows: DataFrame, needed: DataFrame, seed: int) -> DataFrame:
    """label, draw, id and number (from 1, over all classes): draws are numbers of one range, matched with their class."""
    total = needed.agg(F.sum("needed")).first()[0] or 0
    draws = latest(rows.sparkSession.range(total).withColumnRenamed("id", "_at"), "_at", needed, "_start", ["label", "n", "_start"])
    draws = draws.select("label", "n", (F.col("_at") + 1).alias("number"), (F.col("_at") - F.col("_start") + 1).alias("draw"))
    draws = draws.select("label", "number", "draw", (F.floor(uniform(seed, F.col("label"), F.col("draw")) * F.col("n")) + 1).alias("rank"))
    ranked = shuffled_rank(rows.select("id", "label"), "label", "id", seed, "rank", "size").drop("size")
    return null_safe_join(draws, ranked, ["label", "rank"]).select("label", "number", "draw", "id")


STRATEGIES = ("smote", "adasyn", "random_over", "random_under", "combined", "none")


def resample(rows: DataFrame, strategy: str = "smote", ratio: float | dict | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """id, label, features (array) and made: rows rebalanced by one of STRATEGIES; made rows have new ids above all others.

    smote and adasyn make points between rows of a class and their k nearest of it, adasyn from rows with many neighbours
    of the majority; random_over repeats rows; random_under keeps as many rows of each class as the smallest has (only
    without a ratio); combined is smote, then random_under. Neighbours are exact, so the seeds drawn are queries in blocks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "label", F.col("features").cast("array<double>").alias("features"), F.lit(False).alias("made"))
    if strategy == "none":
        return rows
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if strategy == "random_under":
        if ratio is not None:
            return rows
        least = counts.agg(F.min("n")).first()[0] or 0
        return shuffled_rank(rows, "label", "id", seed, "_rank", "_size").filter(F.col("_rank") <= least).drop("_rank", "_size")
    if strategy == "combined":
        return resample(resample(rows, "smote", ratio, k, seed), "random_under", None, k, seed).join(rows.select("id", F.lit(False).alias("own")), "id", "left").select("id", "label", "features", F.col("own").isNull().alias("made"))
    needed = _numbered(targets(counts, ratio))
    seeds = _by_density(rows, counts, needed, k, seed) if strategy == "adasyn" else _drawn(rows, needed, seed)
    base = (rows.agg(F.max("id")).first()[0] or 0) + 1
    # Numbers of the made rows follow each other from class to class.
    seeds = saved(seeds.select("id", F.col("number").alias("draw")), "seeds")
    if strategy == "random_over":
        made = seeds.join(rows.select("id", "label", "features"), "id")
    else:
        marked = rows.join(seeds.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
        made = interpolated(rows, nearest(marked, F.col("asked"), k, same_class=True), seeds, seed)
    return rows.unionByName(made.select((F.lit(base - 1) + F.col("draw")).alias("id"), "label", "features", F.lit(True).alias("made")))


def _by_density(rows: DataFrame, counts: DataFrame, needed: DataFrame, k: int, seed: int) -> DataFrame:
    """label, number and id: rows of each class drawn in proportion to their neighbours of the majority, equally where there are none."""
    majority = counts.orderBy(F.desc("n"), "label").first().label
    lacking, found = needed.collect(), None  # a row a class
    if lacking:
        mine = reduce(Column.__or__, [F.col("label").eqNullSafe(F.lit(r.label)) for r in lacking])
        # All classes are queries of one search.
        near = saved(nearest(rows, mine, k).join(rows.select("id", F.col("label").alias("of")), "id").select("id", "nb_label", "of"), "near")
    for r in lacking:
        weights = density(near.filter(F.col("of").eqNullSafe(F.lit(r.label))), majority).select(F.col("id").alias("ind_id"), F.col("weight").alias("prob"))
        draws = rows.sparkSession.range(1, r.needed + 1).select(F.col("id").alias("draw_id"), uniform(seed, F.lit(r.label), F.col("id"), F.lit("seed")).alias("u"))
        part = picked(weights, draws).select(F.lit(r.label).alias("label"), (F.col("draw_id") + r["_start"]).alias("number"), F.col("ind_id").alias("id"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.select("label", F.lit(0).cast("bigint").alias("number"), "id").limit(0)


def _donors(held, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked = held.value
        best: dict[tuple[int, int], list] = {}
        for b in batches:
            rows, own = np.stack(b["features"].to_numpy()).astype(float), b["id"].to_numpy()
            for q, x in zip(ids, asked):
                both = ~np.isnan(rows) & ~np.isnan(x)
                seen = both.sum(1)
                d = np.where(both, (rows - x) ** 2, 0.0).sum(1) * len(x) / np.maximum(seen, 1)
                d[(seen == 0) | (own == q)] = np.inf
                for f in np.flatnonzero(np.isnan(x)):
                    at = np.flatnonzero(np.isfinite(d) & ~np.isnan(rows[:, f]))
                    at = at[np.lexsort((own[at], d[at]))[:k]]
                    best[q, f] = sorted(best.get((q, f), []) + list(zip(d[at].tolist(), own[at].tolist(), rows[at, f].tolist())))[:k]
        out = [(q, int(f), *x) for (q, f), found in best.items() for x in found]
        yield pd.DataFrame(out, columns=["id", "feature", "distance", "nb", "value"])

    return run


def fill_from_neighbours(rows: DataFrame, donors: DataFrame, k: int = 5) -> DataFrame:
    """id and filled, a map of the missing places of features (null or NaN) and the mean of the k nearest donors' values there.

    The distance is over the places that both have, scaled up to all. Rows with a gap are queries in blocks, donors stay.
    """
    shaped = lambda d: d.select(F.col("id").cast("bigint").alias("id"), F.transform("features", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("features"))
    asked, donors, found = shaped(rows).filter(F.exists("features", F.isnan)), shaped(donors), None
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    blocks = max(1, -(-n * 8 * max(1, width or 1) // BLOCK))
    for b in range(blocks if n else 0):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if len(own):
            held = rows.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), np.stack(own["features"].to_numpy()).astype(float)))
            part = donors.mapInPandas(_donors(held, k), "id bigint, feature int, distance double, nb bigint, value double")
            if blocks > 1:
                part = saved(part, "donors")
                held.destroy()
            found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "id bigint, filled map<int,double>")
    place = F.row_number().over(Window.partitionBy("id", "feature").orderBy("distance", "nb"))
    means = found.withColumn("place", place).filter(F.col("place") <= k).groupBy("id", "feature").agg(F.avg("value").alias("value"))
    return means.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("filled"))
