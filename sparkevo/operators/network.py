"""Feed-forward networks trained data-parallel: a pass sums the gradients of all rows, task by task.

Every task adds up the loss and gradients of its rows for the weights of the moment, as one array; sums of tasks meet
``FAN_IN`` at a time, and one array of the size of the weights comes to the driver, which takes a step of Adam and broadcasts
the new weights. Rows stay where they are, in a table that is written once; nothing depends on the number of them.

Rows need label (0..) and features (arrays of one length, complete).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import discard, saved

FAN_IN, ROWS = 64, 4096
_SUMS = "part int, n bigint, loss double, sums array<double>"
#: Each activation, and its slope as a function of its own value.
ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)),
    "identity": (lambda z: z, np.ones_like),
}

Weights = list[tuple[np.ndarray, np.ndarray]]


def initial(sizes: Sequence[int], seed: int) -> Weights:
    """Even draws within the usual bound of each layer, sqrt(6 / (in + out))."""
    random = np.random.default_rng(seed)
    bound = lambda a, b: np.sqrt(6 / (a + b))
    return [(random.uniform(-bound(a, b), bound(a, b), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for pair in weights for x in pair])


def unpacked(flat: np.ndarray, sizes: Sequence[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, weights: Weights, activation: str) -> list[np.ndarray]:
    """The values of all layers; the last are logarithms of class probabilities."""
    act, out = ACTIVATIONS[activation][0], [x]
    for k, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        out.append(act(z) if k < len(weights) - 1 else z - z.max(1, keepdims=True))
    out[-1] = out[-1] - np.log(np.exp(out[-1]).sum(1, keepdims=True))
    return out


def gradients(x: np.ndarray, label: np.ndarray, weights: Weights, activation: str) -> tuple[float, np.ndarray]:
    """Loss and packed gradients, summed over rows."""
    values, slope = forward(x, weights, activation), ACTIVATIONS[activation][1]
    rows = np.arange(len(x))
    delta = np.exp(values[-1])
    delta[rows, label] -= 1
    out = []
    for k in range(len(weights) - 1, -1, -1):
        out.append((values[k].T @ delta, delta.sum(0)))
        if k:
            delta = delta @ weights[k][0].T * slope(values[k])
    return float(-values[-1][rows, label].sum()), packed(out[::-1])


@dataclass
class Network:
    """hidden layers, activation of these, passes, step size, L2 share of the weights, and the gain below which it stops."""

    hidden: Sequence[int] = (100,)
    activation: str = "relu"
    max_iter: int = 200
    step: float = 0.05
    alpha: float = 1e-4
    tol: float = 1e-5
    patience: int = 10
    seed: int = 42
    sizes: list[int] | None = None
    weights: Weights | None = None
    losses: list[float] = field(default_factory=list)

    def _pass(self, rows: DataFrame, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and mean gradients over all rows."""
        sizes, activation = self.sizes, self.activation
        held = rows.sparkSession.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, n, loss, total = unpacked(held.value, sizes), 0, 0.0, np.zeros(len(held.value))
            for batch in batches:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                y = batch.column("label").to_numpy()
                for a in range(0, len(x), ROWS):
                    own, g = gradients(x[a : a + ROWS], y[a : a + ROWS], weights, activation)
                    loss, total = loss + own, total + g
                n += len(x)
            if n:
                part = TaskContext.get().partitionId() // FAN_IN
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [n], "loss": [loss], "sums": [total.tolist()]})

        def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            total = t.column("sums").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)
            return pa.table({"part": pa.array([0], pa.int32()), "n": [sum(t.column("n").to_pylist())], "loss": [float(sum(t.column("loss").to_pylist()))], "sums": [total.tolist()]})

        own = rows.select("label", "features").mapInArrow(run, _SUMS).groupBy("part").applyInArrow(merge, _SUMS)
        got = own.collect()  # an array of the weights for every FAN_IN tasks
        held.destroy()
        n = max(1, sum(r.n for r in got))
        return sum(r.loss for r in got) / n, sum((np.array(r.sums) for r in got), np.zeros(len(flat))) / n

    def fit(self, df: DataFrame, classes: int | None = None) -> Network:
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}")
        rows = saved(df.select(F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features")).hint("rebalance"), "rows")
        most = rows.agg(F.max("label"), F.max(F.size("features"))).first()
        self.sizes = [most[1] or 1, *self.hidden, max(classes or 0, (most[0] or 0) + 1, 2)]
        flat, self.losses = packed(initial(self.sizes, self.seed)), []
        m, v, best, stale = np.zeros(len(flat)), np.zeros(len(flat)), np.inf, 0
        for t in range(1, self.max_iter + 1):
            loss, g = self._pass(rows, flat)
            self.losses.append(loss)
            stale = 0 if loss < best - self.tol else stale + 1
            best = min(best, loss)
            if stale >= self.patience:
                break
            g = g + self.alpha * flat
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - self.step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = unpacked(flat, self.sizes)
        discard(rows)
        return self

    def predict(self, df: DataFrame, *columns: str) -> DataFrame:
        """columns of df and prediction, the likeliest class."""
        if self.weights is None:
            raise RuntimeError("fit comes before predict")
        held, activation = df.sparkSession.sparkContext.broadcast(self.weights), self.activation
        own = df.select(*columns, F.col("features").cast("array<double>").alias("features"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                said = forward(x, held.value, activation)[-1].argmax(1) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(said.astype(np.int32))], names=[*columns, "prediction"])

        return own.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in own.dtypes if n != "features") + ", prediction int")
