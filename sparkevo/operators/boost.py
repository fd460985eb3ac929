"""Boosted histogram trees for two classes, grown leaf by leaf, with L1 and L2 terms and a limit of leaves.

Features are cut into bins at approximate quantiles once. A pass over the rows adds up gradients, Hessians and rows by
node, feature and bin in each task; sums of tasks meet by node, ``FAN_IN`` at a time first, and the task that has a node's
sums finds its best split, so one row a node comes to the driver. Growth is best first, and exactly so, but a pass serves
a whole level: children of all leaves that the best-first order may still reach are summed at once, and the order is then
replayed over what is known until it asks for a node that is not.

Margins of the rows are kept in the shared folder, written anew after each tree, with the loss of the rows held out, by which
training stops early. Nulls and NaN are in the lowest bin. Rows need row_id, label (0 or 1) and features (one length).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.shared import discard, saved

FAN_IN, BINS = 64, 64
_SUMS = "node int, part int, width int, sums array<double>"
_SPLIT = "node int, gain double, feature int, bin int, g double, h double, n double, left_g double, left_h double, left_n double"


def weight(g: np.ndarray, l1: float) -> np.ndarray:
    """The gradient sum drawn towards zero by the L1 term."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def score(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Twice the loss that the best value of a leaf takes off."""
    return weight(g, l1) ** 2 / np.maximum(h + l2, 1e-12)


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), the last bin that goes left, children, and value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, bin_
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for held, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            held += [empty, empty]
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, bin_, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            goes = bins[i, feature[at[i]]] <= bin_[at[i]]
            at[i] = np.where(goes, left[at[i]], right[at[i]])
        return at


def _gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - label, p * (1 - p)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    packed = batch.column("bins").to_pylist()
    return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)


def best_split(sums: np.ndarray, l1: float, l2: float, least: int) -> tuple[float, int, int]:
    """gain, feature and bin of the best split of the sums (feature, bin, of gradients, Hessians and rows); gain 0: none."""
    left = sums.cumsum(1)[:, :-1]
    whole = sums[0].sum(0)
    right = whole - left
    gain = (score(left[..., 0], left[..., 1], l1, l2) + score(right[..., 0], right[..., 1], l1, l2) - score(whole[0], whole[1], l1, l2)) / 2
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, 0.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain.size and gain[f, b] > 1e-12 else (0.0, -1, 0)


@dataclass
class Boosting:
    """trees of at most `leaves` leaves and `depth` levels; rate; l1, l2; least rows of a leaf; share of rows a tree sees.

    patience: trees without a better loss on the tenth held out before training stops (0: no rows are held out).
    """

    trees: int = 50
    leaves: int = 31
    depth: int = 16
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    least: int = 5
    subsample: float = 1.0
    patience: int = 0
    bins: int = BINS
    seed: int = 42
    cuts: list[np.ndarray] | None = None
    grown: list[Tree] = field(default_factory=list)
    base: float = 0.0
    losses: list[float] = field(default_factory=list)

    def _cut(self, df: DataFrame) -> None:
        long = df.select(F.size("features").alias("width"), F.posexplode("features").alias("at", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
        shares = F.lit([k / self.bins for k in range(1, self.bins)])
        got = long.groupBy("at").agg(F.percentile_approx("v", shares, F.lit(100 * self.bins)).alias("q"), F.max("width").alias("width")).collect()  # a row a feature
        width = max((r.width for r in got), default=1)
        self.cuts = [np.zeros(0)] * width
        for r in got:
            self.cuts[r["at"]] = np.unique(r.q)

    def _binned(self, df: DataFrame, *columns: str) -> DataFrame:
        """columns and bins (a byte a feature: how many cuts lie below the value) of rows with features."""
        cuts = self.cuts
        names = [*columns, "features"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                out = np.zeros(x.shape, np.uint8)
                for f, c in enumerate(cuts):
                    known = ~np.isnan(x[:, f])
                    out[known, f] = np.searchsorted(c, x[known, f])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([r.tobytes() for r in out], pa.binary())], names=[*columns, "bins"])

        own = df.select(*columns, F.transform("features", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("features")).select(*names)
        return own.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in own.dtypes if n != "features") + ", bins binary")

    def _sums(self, rows: DataFrame, tree: Tree, wanted: list[int], round_: int) -> list:
        """The best split of each wanted node."""
        width, bins, l1, l2, least = len(self.cuts), self.bins, self.l1, self.l2, self.least
        of = {n: k for k, n in enumerate(wanted)}
        number = np.array([of.get(n, -1) for n in range(len(tree.feature))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), width, bins, 3))
            for batch in batches:
                x = _matrix(batch)
                own = number[tree.leaf_of(x)]
                keep = own >= 0
                if not keep.any():
                    continue
                g, h = _gradients(batch.column("margin").to_numpy()[keep], batch.column("label").to_numpy()[keep])
                x, own = x[keep], own[keep]
                for f in range(width):
                    at = own * bins + x[:, f]
                    for k, w in enumerate((g, h, None)):
                        total[:, f, :, k] += np.bincount(at, w, len(wanted) * bins).reshape(len(wanted), bins)
            part = TaskContext.get().partitionId() // FAN_IN
            for k, node in enumerate(wanted):
                if total[k].any():
                    yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "part": pa.array([part], pa.int32()), "width": pa.array([width], pa.int32()), "sums": [total[k].ravel().tolist()]})

        def added(t: pa.Table) -> np.ndarray:
            return t.column("sums").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)

        def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            return pa.table({**{c: t.column(c)[:1] for c in ("node", "part", "width")}, "sums": [added(t).tolist()]})

        def choose(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            sums = added(t).reshape(width, bins, 3)
            gain, f, b = best_split(sums, l1, l2, least)
            g, h, n = sums[0].sum(0)
            lg, lh, ln = sums[f, : b + 1].sum(0) if f >= 0 else (0.0, 0.0, 0.0)
            types = {"node": pa.int32(), "feature": pa.int32(), "bin": pa.int32()}
            row = {"node": key[0].as_py(), "gain": gain, "feature": f, "bin": b, "g": g, "h": h, "n": n, "left_g": lg, "left_h": lh, "left_n": ln}
            return pa.table({c: pa.array([v], types.get(c, pa.float64())) for c, v in row.items()})

        seen = rows.filter(~F.col("held"))
        if self.subsample < 1:
            seen = seen.filter(uniform(self.seed, F.col("row_id"), F.lit(round_)) < self.subsample)
        own = seen.select("bins", "margin", "label").mapInArrow(run, _SUMS)
        some = own.groupBy("node", "part").applyInArrow(merge, _SUMS)
        return some.groupBy("node").applyInArrow(choose, _SPLIT).collect()  # a row a node

    def _grow(self, rows: DataFrame, round_: int) -> Tree:
        """One tree, best first: the splits of a level are found in one pass."""
        sketch, level, known = Tree(), {0: 0}, {}  # every split found; depth of each node; best split of each node
        wanted = [0]
        while wanted:
            found = {r.node: r for r in self._sums(rows, sketch, wanted, round_)}
            for n in wanted:
                known[n] = found.get(n)
            for n in wanted:
                r = known[n]
                if r is not None and r.gain > 0 and level[n] < self.depth:
                    for child in sketch.split(n, r.feature, r.bin):
                        level[child] = level[n] + 1
            order, wanted = self._first(sketch, known)
        tree, at = Tree(), {0: 0}
        for n in order:
            left, right = tree.split(at[n], sketch.feature[n], sketch.bin[n])
            at[sketch.left[n]], at[sketch.right[n]] = left, right
        for n, mine in at.items():
            r = known.get(n)
            if tree.feature[mine] < 0 and r is not None:
                tree.value[mine] = float(-weight(np.float64(r.g), self.l1) / max(r.h + self.l2, 1e-12) * self.rate)
        return tree

    def _first(self, sketch: Tree, known: dict) -> tuple[list[int], list[int]]:
        """Nodes split, best gain first, as far as the limit of leaves goes; and the nodes whose sums are still needed."""
        heap, order, missing = [], [], []

        def offer(n: int) -> None:
            if n not in known:
                missing.append(n)
            elif sketch.feature[n] >= 0:
                heapq.heappush(heap, (-known[n].gain, n))

        offer(0)
        while heap and len(order) < self.leaves - 1:
            _, n = heapq.heappop(heap)
            order.append(n)
            offer(sketch.left[n])
            offer(sketch.right[n])
        return order, missing

    def fit(self, df: DataFrame) -> Boosting:
        """df: row_id, label, features."""
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must lie between 2 and 256")
        self._cut(df)
        held = uniform(self.seed, F.col("row_id"), F.lit("held")) < 0.1 if self.patience else F.lit(False)
        p = df.agg(F.avg(F.col("label").cast("double"))).first()[0]
        p = min(1 - 1e-6, max(1e-6, p if p is not None else 0.5))
        self.base, self.grown, self.losses = float(np.log(p / (1 - p))), [], []
        marked = df.select("row_id", F.col("label").cast("double").alias("label"), "features")
        rows = saved(self._binned(marked, "row_id", "label").withColumns({"held": held, "margin": F.lit(self.base)}).hint("rebalance"), "margins")
        for round_ in range(self.trees):
            tree = self._grow(rows, round_)
            if tree.feature[0] < 0:
                break  # no split helps any more
            self.grown.append(tree)
            old, rows = rows, saved(self._moved(rows, tree), "margins")
            discard(old)
            if self.patience:
                y, m = F.col("label"), F.col("margin")
                loss = F.when(m > 0, m).otherwise(0) - m * y + F.log1p(F.exp(-F.abs(m)))
                self.losses.append(rows.filter("held").agg(F.avg(loss)).first()[0] or 0.0)
                best = int(np.argmin(self.losses))
                if len(self.losses) - 1 - best >= self.patience:
                    self.grown = self.grown[: best + 1]
                    break
        discard(rows)
        return self

    @staticmethod
    def _moved(rows: DataFrame, tree: Tree) -> DataFrame:
        value = np.array(tree.value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = batch.column("margin").to_numpy() + value[tree.leaf_of(_matrix(batch))]
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

        return rows.mapInArrow(run, rows.schema)

    def margins(self, df: DataFrame, *columns: str) -> DataFrame:
        """columns of df (with features) and margin, the log-odds of class 1."""
        if self.cuts is None:
            raise RuntimeError("fit comes before margins")
        held = df.sparkSession.sparkContext.broadcast((self.grown, self.base))
        binned = self._binned(df, *columns)
        schema = ", ".join(f"{n} {t}" for n, t in binned.dtypes if n != "bins") + ", margin double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, base = held.value
            for batch in batches:
                x, total = _matrix(batch), np.full(batch.num_rows, base)
                for tree in trees:
                    total += np.array(tree.value)[tree.leaf_of(x)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(total)], names=[*columns, "margin"])

        return binned.mapInArrow(run, schema)


def predicted(train: DataFrame, test: DataFrame, classes: int, **parameters) -> DataFrame:
    """row_id, label and prediction of the test rows; more than two classes are boosted one against the rest."""
    if classes == 2:
        margins = Boosting(**parameters).fit(train).margins(test, "row_id", "label")
        return margins.select("row_id", F.col("label").cast("int").alias("label"), (F.col("margin") > 0).cast("int").alias("prediction"))
    best = None
    for c in range(classes):
        one = Boosting(**parameters).fit(train.withColumn("label", (F.col("label") == c).cast("int")))
        own = one.margins(test, "row_id", "label").select("row_id", "label", F.struct((-F.col("margin")).alias("m"), F.lit(c).alias("c")).alias("s"))
        best = own if best is None else best.unionByName(own)
    return best.groupBy("row_id", "label").agg(F.min("s").alias("s")).select("row_id", F.col("label").cast("int").alias("label"), F.col("s.c").alias("prediction"))
