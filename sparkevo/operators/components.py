"""Principal components: from one pass of sums, a covariance of p x p, or for wide rows from a random subspace.

The latter iterates a block of l directions: a pass over the rows sums X'(XQ), p x l numbers in blocks of features, whose
QR gives the next directions; the l x l products of the last ones give components and variances. Neither the driver nor a
task holds p x p numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram


def moments(df: DataFrame, features: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample covariance of an array column: each task adds up its own rows' products."""
    rows = df.select(F.col(features).cast("array<double>").alias("x")).filter("x is not null")
    shift_row = rows.first()
    if shift_row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    shift = np.array(shift_row.x)  # taken off first, so that large means cost no digits
    n, s, ss = gram.moments(rows.select(F.zip_with("x", gram.literal(shift), lambda x, y: x - y).alias("x")), len(shift))
    return n, shift + s / n, (ss - np.outer(s, s) / n) / max(1, n - 1)


#: Features in one row of partial sums, and tasks whose sums meet first.
FEATURES, FAN_IN = 1024, 64


def _products(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X'(XQ) of the centred rows x: p x l numbers, summed by blocks of features."""
    held = rows.sparkSession.sparkContext.broadcast((mean, q))
    schema = "block int, part int, sums array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = held.value
        total = np.zeros(q.shape)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1) - mean
            total += x.T @ (x @ q)
        part = TaskContext.get().partitionId() // FAN_IN
        for block in range(0, len(total), FEATURES):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "sums": [total[block : block + FEATURES].ravel().tolist()]})

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = t.column("sums").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)
        return pa.table({"block": t.column("block")[:1], "part": t.column("part")[:1], "sums": [total.tolist()]})

    some = rows.mapInArrow(run, schema).groupBy("block", "part").applyInArrow(merge, schema)
    out = np.zeros(q.shape)
    for r in some.groupBy("block").applyInArrow(merge, schema).collect():
        own = np.array(r.sums).reshape(-1, q.shape[1])
        out[r.block : r.block + len(own)] = own
    held.destroy()
    return out


def subspace(rows: DataFrame, width: int, k: int, oversample: int = 20, passes: int = 12, tol: float = 1e-10, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """mean, k components, their variances and the whole variance of the array column x, by subspace iteration."""
    stats = gram.column_stats(rows)  # a row a feature
    mean = np.array([stats[i][0] for i in range(width)])
    n = max(2, rows.count())
    size = min(width, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    before = np.zeros(size)
    for _ in range(passes):
        z = _products(rows, mean, q)
        small = q.T @ z  # Q'X'XQ
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, axes = values[order], (q @ vectors[:, order]).T
        settled = np.abs(values[:k] - before[:k]).max() <= tol * max(values[0], 1e-300)
        if settled or size == width:
            break
        before, q = values, np.linalg.qr(z)[0]
    return mean, axes[:k], np.maximum(values[:k], 0) / (n - 1), float(sum(stats[i][1] ** 2 for i in range(width)) * n / (n - 1))


@dataclass
class PCA:
    """n_components: None (all), a whole number, or the share of variance to keep; whiten scales to variance 1.

    random: components of wide rows from a random subspace, for a whole number of them.
    """

    n_components: float | None = None
    whiten: bool = False
    random: bool = False
    mean: np.ndarray | None = None
    axes: np.ndarray | None = None
    variance: np.ndarray | None = None
    ratio: np.ndarray | None = None

    def fit(self, df: DataFrame, features: str = "features") -> PCA:
        if self.random:
            if not self.n_components or self.n_components < 1:
                raise ValueError("a random subspace needs a whole number of components")
            rows = df.select(F.col(features).cast("array<double>").alias("x")).filter("x is not null")
            width = rows.select(F.size("x")).first()
            if width is None:
                raise ValueError("no rows to fit")
            self.mean, axes, self.variance, total = subspace(rows, width[0], min(int(self.n_components), width[0]))
            lead = np.abs(axes).argmax(1)
            self.axes = axes * np.sign(axes[np.arange(len(axes)), lead])[:, None]
            self.ratio = self.variance / total if total else self.variance
            return self
        n, self.mean, cov = moments(df, features)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order].T
        lead = np.abs(vectors).argmax(1)
        vectors *= np.sign(vectors[np.arange(len(vectors)), lead])[:, None]  # the largest weight is positive
        ratio = values / values.sum() if values.sum() else values
        k = len(values) if self.n_components is None else int(self.n_components) if self.n_components >= 1 else int(np.searchsorted(np.cumsum(ratio), self.n_components) + 1)
        k = min(k, len(values), max(1, n))
        self.axes, self.variance, self.ratio = vectors[:k], values[:k], ratio[:k]
        return self

    def _apply(self, df: DataFrame, f, source: str, name: str) -> DataFrame:
        def run(batches):
            for b in batches:
                x = np.stack(b[source].to_numpy()).astype(float)
                yield b.assign(**{name: list(f(x))})

        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        fields = [x for x in df.schema.fields if x.name != name]
        return df.drop(*([name] if name != source else [])).mapInPandas(run, StructType([*[x for x in fields], StructField(name, ArrayType(DoubleType()))]))

    def transform(self, df: DataFrame, features: str = "features", name: str = "projected") -> DataFrame:
        if self.axes is None:
            raise RuntimeError("fit comes before transform")
        scale = np.sqrt(np.where(self.variance > 0, self.variance, 1)) if self.whiten else 1.0
        return self._apply(df, lambda x: (x - self.mean) @ self.axes.T / scale, features, name)

    def inverse_transform(self, df: DataFrame, projected: str = "projected", name: str = "restored") -> DataFrame:
        scale = np.sqrt(np.where(self.variance > 0, self.variance, 1)) if self.whiten else 1.0
        return self._apply(df, lambda z: z * scale @ self.axes + self.mean, projected, name)

    def importance(self, components: int = 3, features: int = 5) -> list[tuple[int, int, int, float]]:
        """(component, place, feature, weight): the features of greatest absolute weight."""
        return [(c, j + 1, int(f), float(a[f])) for c, a in enumerate(self.axes[:components]) for j, f in enumerate(np.argsort(-np.abs(a), kind="stable")[:features])]


def apply_pca(df: DataFrame, share: float = 0.95) -> tuple[DataFrame, PCA]:
    """df with projected, and the projection fitted on it."""
    pca = PCA(share).fit(df)
    return pca.transform(df), pca
