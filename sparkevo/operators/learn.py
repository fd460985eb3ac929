"""Model training on label and features, behind one search task: prepare, fit, score by folds, evolve.

Models are Spark ML's; what they lack of other libraries' options is not offered. Preparation (fill gaps, scale,
rebalance, project) is fitted on the training rows of a fold only, and only these are rebalanced. ``Folds`` makes each
preparation once, for all individuals, kinds and searches that ask for it: a scaler and rebalancing of a fold are one
pair of tables in the shared folder with all components, of which a share of variance is the first so many.

Searches run on :mod:`evolve`. All individuals of a generation, by all folds, are fitted at the same time, from as many
threads as the cluster has cores (``parallel`` at most), each in a scheduler pool of its own; searches of several kinds
run beside each other. An individual is scored once, by value. One whose model cannot be fitted scores 0 with its error
kept; a job that Spark lost is tried again, and stops the search if it fails each time.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError, Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.shared import discard, saved
from . import boost, evolve, gram, metrics
from .components import PCA
from .neighbours import nearest, resample, vote
from .network import Network
from .prepare import stratified_folds
from .space import PRESETS, SPACES, Space, decode


def fourier(df: DataFrame, width: int, gamma: float | None = None, size: int = 128, seed: int = 42) -> DataFrame:
    """df with features as random Fourier features, whose products approach the Gaussian kernel exp(-gamma |x - y|^2)."""
    random = np.random.default_rng(seed)
    w = random.normal(size=(width, size)) * math.sqrt(2 * (gamma or 1 / width))
    b = random.uniform(0, 2 * math.pi, size)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.stack(x.to_numpy()).astype(float) @ w + b) * math.sqrt(2 / size)))

    return df.withColumn("features", mapped("features"))


def tensor_sketch(df: DataFrame, width: int, degree: int = 3, gamma: float | None = None, coef: float = 1.0, size: int = 256, seed: int = 42) -> DataFrame:
    """df with features sketched so that products approach the polynomial kernel (gamma x.y + coef)^degree.

    Each of degree copies of the scaled row, with coef as one more entry, is count-sketched by hashes and signs of its
    own; a product of their Fourier transforms is that of the sketch of the whole tensor.
    """
    random = np.random.default_rng(seed)
    place, sign = random.integers(0, size, (degree, width + 1)), random.choice([-1.0, 1.0], (degree, width + 1))
    scale = math.sqrt(gamma or 1 / width)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()).astype(float) * scale
        rows = np.hstack((rows, np.full((len(rows), 1), math.sqrt(coef))))
        product = np.ones((len(rows), size // 2 + 1), complex)
        for k in range(degree):
            sketch = np.zeros((len(rows), size))
            for i in range(width + 1):
                sketch[:, place[k, i]] += sign[k, i] * rows[:, i]
            product *= np.fft.rfft(sketch, axis=1)
        return pd.Series(list(np.fft.irfft(product, size, axis=1)))

    return df.withColumn("features", mapped("features"))


def sigmoid_landmarks(train: DataFrame, width: int, gamma: float | None = None, coef: float = 0.0, size: int = 128) -> Callable[[DataFrame], DataFrame]:
    """A map of features to tanh(gamma x.y + coef) for `size` landmark rows y of train, those of least hash: the kernel's columns."""
    marks = train.orderBy(F.xxhash64("row_id"), "row_id").limit(size).select("features").collect()  # size rows at most
    y = np.array([r.features for r in marks], float).reshape(len(marks), -1)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.tanh((gamma or 1 / width) * np.stack(x.to_numpy()).astype(float) @ y.T + coef)))

    return lambda d: d.withColumn("features", mapped("features"))


def make_model(kind: str, p: dict, classes: int, width: int, rows: int, seed: int = 42):
    """An estimator of Spark ML with the parameters of a decoded individual, for so many training rows."""
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=int(p.get("trees", 50)), maxDepth=int(p.get("max_depth", 10)), minInstancesPerNode=int(p.get("min_leaf", 1)), featureSubsetStrategy=p.get("features", "sqrt"), seed=seed)
    if kind == "logistic":
        return LogisticRegression(regParam=1 / (float(p.get("C", 1.0)) * max(1, rows)), elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0, maxIter=20)
    if kind == "mlp":
        hidden = [int(p[k]) for k in ("layer1", "layer2", "layer3") if int(p.get(k, 0) or 0) > 0] or [100]
        return MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=int(p.get("max_iter", 100)), seed=seed)
    if kind == "svm":
        one = LinearSVC(regParam=1 / (float(p.get("C", 1.0)) * max(1, rows)), maxIter=20)
    elif kind == "gbt":
        early = {"validationIndicatorCol": "held", "validationTol": 0.0} if p.get("early_stop") else {}
        one = GBTClassifier(maxIter=int(p.get("trees", 50)), maxDepth=int(p.get("max_depth", 5)), stepSize=float(p.get("rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)), seed=seed, **early)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return one if classes == 2 else OneVsRest(classifier=one)


def predictions(kind: str, p: dict, train: DataFrame, test: DataFrame, classes: int, width: int, rows: int | None = None) -> DataFrame:
    """row_id, label, prediction of the test rows; rows is the number of training rows where it is known."""
    if kind == "knn":
        both = train.select("row_id", "label", "features", F.lit(False).alias("t")).unionByName(test.select("row_id", "label", "features", F.lit(True).alias("t")))
        near = nearest(both.withColumnRenamed("row_id", "id"), F.col("t"), int(p.get("k", 5)), donors=~F.col("t"), metric=p.get("metric", "euclidean"))
        said = test.select("row_id", "label").join(vote(near, p.get("weights") == "distance"), F.col("row_id") == F.col("id"), "left")
        return said.select("row_id", "label", F.coalesce("prediction", F.lit(0)).cast("int").alias("prediction"))
    if kind == "network":
        hidden = [int(p[k]) for k in ("layer1", "layer2", "layer3") if int(p.get(k, 0) or 0) > 0] or [100]
        net = Network(hidden, p.get("activation", "relu"), int(p.get("max_iter", 200)), float(p.get("step", 0.05)), float(p.get("alpha", 1e-4)))
        return net.fit(train, classes).predict(test, "row_id", "label").withColumn("label", F.col("label").cast("int"))
    if kind == "leafwise":
        known = {"trees": int, "leaves": int, "rate": float, "l1": float, "l2": float, "least": int, "subsample": float, "patience": int}
        return boost.predicted(train, test, classes, **{n: kind_(p[n]) for n, kind_ in known.items() if n in p})
    if kind == "svm" and p.get("kernel") == "rbf":
        train, test = (fourier(d, width, p.get("gamma")) for d in (train, test))
    if kind == "svm" and p.get("kernel") == "poly":
        train, test = (tensor_sketch(d, width, int(p.get("degree", 3)), p.get("gamma"), float(p.get("coef", 1.0))) for d in (train, test))
    if kind == "svm" and p.get("kernel") == "sigmoid":
        seen = sigmoid_landmarks(train, width, p.get("gamma"), float(p.get("coef", 0.0)))
        train, test = seen(train), seen(test)
    held = uniform(42, F.col("row_id"), F.lit("held")) < 0.1
    as_ml = lambda d: d.select("row_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"), held.alias("held"))
    fitted = make_model(kind, p, classes, width, train.count() if rows is None else rows).fit(as_ml(train))
    return fitted.transform(as_ml(test)).select("row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def together(spark: SparkSession, calls: Sequence[Callable[[], Any]], parallel: int = 16) -> list[Any]:
    """Results of calls that submit Spark jobs, made at the same time from threads with scheduler pools of their own."""

    def own(call: Callable[[], Any], at: int) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sparkevo-{at}")
        return call()

    if len(calls) < 2 or parallel < 2:
        return [c() for c in calls]
    width = max(1, min(len(calls), parallel, spark.sparkContext.defaultParallelism))
    with ThreadPoolExecutor(width) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(own), c, i % width) for i, c in enumerate(calls)]]


#: What Spark says where executors or shuffle files went, and not the model.
LOST = ("ExecutorLostFailure", "FetchFailed", "Lost executor", "SparkContext was shut down", "No space left")


def lost(error: BaseException) -> bool:
    """Whether Spark failed, and not the model: executors or their files were lost, or the JVM did not answer."""
    if isinstance(error, Py4JJavaError):
        return any(mark in str(error.java_exception) for mark in LOST)
    return isinstance(error, (Py4JError, ConnectionError, OSError))


def retried(call: Callable[[], Any], times: int = 3) -> Any:
    """What call returns; a call that Spark lost is made again, up to so many times."""
    for left in range(times - 1, -1, -1):
        try:
            return call()
        except Exception as e:
            if not left or not lost(e):
                raise


class Once:
    """Values made once a key, by the first thread that asks; others wait for it. A failure is forgotten."""

    def __init__(self) -> None:
        self.lock, self.held = threading.Lock(), {}

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        with self.lock:
            own = key not in self.held
            found = self.held.setdefault(key, Future())
        if own:
            try:
                found.set_result(make())
            except BaseException as e:
                with self.lock:
                    del self.held[key]
                found.set_exception(e)
        return found.result()

    def values(self) -> list[Any]:
        return [f.result() for f in self.held.values() if f.done() and not f.exception()]


@dataclass
class Folds:
    """Stratified folds of frame (row_id, label 0.., features) with their preparations, each made once."""

    frame: DataFrame
    folds: int = 3
    seed: int = 42
    made: Once = field(default_factory=Once)

    @property
    def classes(self) -> int:
        return self.made.get("shape", self._shape)[0]

    def _shape(self) -> tuple[int, int]:
        most = self.frame.agg(F.max("label"), F.max(F.size("features"))).first()
        return (most[0] or 0) + 1, most[1] or 0

    def _filled(self, fold: int) -> tuple[DataFrame, DataFrame, dict[int, tuple]]:
        """Training and test rows of a fold, gaps filled with the means of the former, and the statistics of its places."""
        folded = self.made.get("folded", lambda: saved(stratified_folds(self.frame, "label", "row_id", self.folds, self.seed), "folded"))
        places = F.sequence(F.lit(0), F.lit(self.made.get("shape", self._shape)[1] - 1))
        clean = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        known = folded.withColumn("x", F.transform(places, lambda i: clean(F.get("features", i).cast("double"))))
        train, test = known.filter(F.col("fold") != fold), known.filter(F.col("fold") == fold)
        means = gram.column_stats(train)
        means = gram.literal([means[i][0] if i in means else 0.0 for i in range(self.made.get("shape", self._shape)[1])])
        full = lambda d: d.select("row_id", "label", F.zip_with("x", means, lambda x, m: F.coalesce(x, m)).alias("x"))
        return full(train), full(test), gram.column_stats(full(train))

    def _scaled(self, scaler: str, train: DataFrame, stats: dict[int, tuple]) -> Callable[[DataFrame], DataFrame]:
        """Shifts and scales x as Scaler does columns; what is constant is only shifted."""
        if scaler == "robust":
            q = gram.column_quantiles(train, (0.25, 0.5, 0.75))
            pairs = [(q[i][1], q[i][2] - q[i][0]) for i in sorted(q)]
        elif scaler in ("standard", "minmax", "maxabs"):
            take = {"standard": lambda m, s, lo, hi: (m, s), "minmax": lambda m, s, lo, hi: (lo, hi - lo), "maxabs": lambda m, s, lo, hi: (0.0, max(abs(lo), abs(hi)))}[scaler]
            pairs = [take(*stats[i]) for i in sorted(stats)]
        else:
            raise ValueError(f"unknown scaler {scaler!r}")
        shift, scale = gram.literal([a for a, _ in pairs]), gram.literal([b or 1.0 for _, b in pairs])
        return lambda d: d.select("row_id", "label", F.zip_with(F.zip_with("x", shift, lambda x, a: x - a), scale, lambda x, b: x / b).alias("features"))

    def _prepared(self, scaler: str, rebalance: str, fold: int) -> tuple[DataFrame, DataFrame, list[float], int]:
        train, test, stats = self.made.get(("filled", fold), lambda: self._filled(fold))
        scaled = self.made.get(("scaled", scaler, fold), lambda: self._scaled(scaler, train, stats))
        even = saved(resample(scaled(train).withColumnRenamed("row_id", "id"), rebalance, seed=self.seed).select(F.col("id").alias("row_id"), "label", "features"), "even")
        pca = PCA().fit(even)
        apply = lambda d: pca.transform(d).select("row_id", "label", F.col("projected").alias("features"))
        # Models read these again and again: no more partitions than their bytes ask for.
        out = saved(apply(even).hint("rebalance"), "train"), saved(apply(scaled(test)).hint("rebalance"), "test")
        n = even.count()
        discard(even)
        return *out, np.cumsum(pca.ratio).tolist(), n

    def get(self, scaler: str, rebalance: str, share: float, fold: int) -> tuple[DataFrame, DataFrame, int, int]:
        """Prepared training and test rows of a fold, the number of their features, and of training rows."""
        train, test, held, n = self.made.get((scaler, rebalance, fold), lambda: retried(lambda: self._prepared(scaler, rebalance, fold)))
        width = min(len(held), int(np.searchsorted(held, share) + 1), max(1, n))
        first = lambda d: d.select("row_id", "label", F.slice("features", 1, width).alias("features"))
        return first(train), first(test), width, n

    def release(self) -> None:
        """Remove the tables made."""
        for v in self.made.values():
            for d in v if isinstance(v, tuple) else (v,):
                if isinstance(d, DataFrame) and hasattr(d, "saved_at"):
                    discard(d)
        self.made = Once()


@dataclass
class SearchTask:
    """Scores individuals of a search space on frames of row_id, label (0..), features (array of numbers).

    folds is a number, or Folds shared with other tasks; so may be the memo of scores, where kind, metrics and folds agree.
    judged are further metrics that score finds along with these; a search does not look at them.
    """

    frame: DataFrame
    kind: str
    folds: int | Folds = 3
    metrics: tuple[str, ...] = ("balanced_accuracy",)
    seed: int = 42
    space: Space | None = None
    parallel: int = 16
    judged: tuple[str, ...] = ()
    memo: Once = field(default_factory=Once)
    errors: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.space = self.space or SPACES[self.kind]
        self.shared = isinstance(self.folds, Folds)
        self.prepared = self.folds if self.shared else Folds(self.frame, self.folds, self.seed)

    def release(self) -> None:
        """Remove the prepared folds, unless other tasks share them."""
        if not self.shared:
            self.prepared.release()

    def on_fold(self, individual: dict, fold: int) -> list[float]:
        """Each metric on one fold, those of judged last."""
        train, test, width, rows = self.prepared.get(individual["scaler"], individual["rebalance"], individual["pca"], fold)
        said = predictions(self.kind, individual, train, test, self.prepared.classes, width, rows)
        names = (*self.metrics, *self.judged)
        if set(names) <= metrics.COUNTED:  # one job: a row a pair of classes
            got = metrics.from_counts({(r.label, r.prediction): r["count"] for r in said.groupBy("label", "prediction").count().collect()})
            return [got[m] for m in names]
        said = saved(said, "said")
        got = [metrics.METRICS[m](said).select(F.col(m)).first()[0] for m in names]
        discard(said)
        return [float(x or 0.0) for x in got]

    def _mean(self, known: tuple, individual: dict) -> list[float]:
        try:
            calls = [partial(retried, partial(self.on_fold, individual, f)) for f in range(self.prepared.folds)]
            return np.mean(together(self.frame.sparkSession, calls, self.parallel), axis=0).tolist()
        except Exception as e:  # the search goes on, and the failure can be seen
            if lost(e):
                raise
            self.errors[known] = str(e)
            return [0.0] * len((*self.metrics, *self.judged))

    def score(self, individual: dict) -> list[float]:
        """Mean of each metric over the folds, remembered by value; zeros, and the error in errors, where a model fails."""
        known = tuple(sorted((k, str(v)) for k, v in individual.items()))
        return self.memo.get(known, lambda: self._mean(known, individual))

    def values(self, pop: DataFrame) -> dict[int, dict]:
        """Decoded values of each individual: a candidate a row, in one job."""
        rows = pop.select("ind_id", *[c.alias(n) for n, c in decode(self.space, F.col("genes")).items()]).collect()
        return {r.ind_id: {n: r[n] for n in self.space} for r in rows}

    def fitness(self, pop: DataFrame, names: tuple[str, ...] = ("fitness",)) -> DataFrame:
        """pop with a column of each of names, the metrics of its individuals, which are scored at the same time.

        Preparations that they need come first, so that no two threads wait for the same one.
        """
        spark, found = pop.sparkSession, self.values(pop)
        needed = dict.fromkeys((v["scaler"], v["rebalance"], f) for v in found.values() for f in range(self.prepared.folds))
        together(spark, [partial(self._ready, *key) for key in needed], self.parallel)
        scores = together(spark, [partial(self.score, v) for v in found.values()], self.parallel)
        scored = [(i, *map(float, own[: len(names)])) for i, own in zip(found, scores)]
        schema = "ind_id bigint, " + ", ".join(f"{n} double" for n in names)
        return pop.join(F.broadcast(spark.createDataFrame(scored, schema)), "ind_id")

    def _ready(self, scaler: str, rebalance: str, fold: int) -> None:
        try:
            self.prepared.get(scaler, rebalance, 1.0, fold)
        except Exception as e:  # the individuals that need it fail one by one
            if lost(e):
                raise

    def search(self, size: int = 10, settings: evolve.Settings | None = None) -> tuple[DataFrame, list[evolve.Generation]]:
        """The last population with fitness, or with several metrics their survivors with pareto_rank, and the history."""
        s = replace(settings) if settings else evolve.Settings(generations=5)
        s.genes = len(self.space)
        start = evolve.initial(self.frame.sparkSession, size, s)
        try:
            if len(self.metrics) == 1:
                return evolve.run(start, self.fitness, s)
            return evolve.nsga2(start, partial(self.fitness, names=tuple(f"obj_{i}" for i in range(len(self.metrics)))), len(self.metrics), s), []
        finally:
            self.release()


def _searched(frame: DataFrame, kinds: Sequence[str], size: int | None = None, settings: dict | None = None, preset: str = "quick", spaces: dict[str, Space] | None = None, folds: int = 3, seed: int = 42, judged: Sequence[str] = (), **options) -> list[tuple]:
    """kind, ind_id, fitness, values (as text) and scores by judged of the last population of a search per kind, all at the same time on the same folds."""
    people, generations = PRESETS[preset]
    shared, spark = Folds(frame, folds, seed), frame.sparkSession

    def one(kind: str) -> list[tuple]:
        task = SearchTask(frame, kind, folds=shared, seed=seed, space=(spaces or {}).get(kind), judged=tuple(judged), **options)
        pop, _ = task.search(size or people, evolve.Settings(**({"generations": generations} | (settings or {}))))
        values = task.values(pop)  # which were all scored
        last = len(task.metrics)
        return [(kind, r.ind_id, r.fitness, str(sorted(values[r.ind_id].items())), task.score(values[r.ind_id])[last:]) for r in pop.select("ind_id", "fitness").collect()]

    try:
        return [r for own in together(spark, [partial(one, k) for k in kinds]) for r in own]
    finally:
        shared.release()


def tune(frame: DataFrame, kinds: Sequence[str], size: int | None = None, settings: dict | None = None, preset: str = "quick", spaces: dict[str, Space] | None = None, folds: int = 3, seed: int = 42, **options) -> DataFrame:
    """kind, ind_id, fitness and values (as text) of the last population of a search per kind of model.

    Kinds are searched at the same time, on the same prepared folds. preset gives population and generations where size
    or settings do not; spaces replaces the search space of kinds.
    """
    rows = [r[:4] for r in _searched(frame, kinds, size, settings, preset, spaces, folds, seed, **options)]
    return frame.sparkSession.createDataFrame(rows, "kind string, ind_id bigint, fitness double, `values` string")


def compare_kinds(frame: DataFrame, kinds: Sequence[str], judged: Sequence[str] = ("accuracy", "balanced_accuracy", "macro_f1"), folds: int = 3, **options) -> DataFrame:
    """kind, place (1 the best, by the search's fitness), fitness, metric, score and values: the best individual of each kind's search, judged by several metrics.

    The search's own models are judged, on the folds that it scored them on: none is fitted again.
    """
    best: dict[str, tuple] = {}
    for r in _searched(frame, kinds, folds=folds, judged=judged, **options):  # an individual a row
        kind, at, fitness, *_ = r
        if kind not in best or (-fitness, at) < (-best[kind][2], best[kind][1]):
            best[kind] = r
    order = {k: i for i, k in enumerate(sorted(kinds, key=lambda k: (-best[k][2], k)), 1)}
    rows = [(k, order[k], best[k][2], m, float(x), best[k][3]) for k in kinds for m, x in zip(judged, best[k][4])]
    return frame.sparkSession.createDataFrame(rows, "kind string, place int, fitness double, metric string, score double, `values` string")


def named_values(text: str) -> list[tuple[str, Any]]:
    """Names and values of an individual, from the text that tune gives."""
    import ast

    return ast.literal_eval(text)


def compare_metrics(frame: DataFrame, kind: str, first: str = "accuracy", second: str = "macro_f1", size: int | None = None, settings: dict | None = None, preset: str = "quick", folds: int = 3, seed: int = 42, **options) -> DataFrame:
    """driver, metric and score: what searches driven by one metric and by another find, each judged by both; and the difference.

    Both searches run at the same time on the same folds, and an individual that both meet is scored once, by both metrics.
    """
    people, generations = PRESETS[preset]
    both, shared, spark = (first, second), Folds(frame, folds, seed), frame.sparkSession
    judge = SearchTask(frame, kind, folds=shared, metrics=both, seed=seed, **options)

    def found(at: int) -> list[float]:
        s = evolve.Settings(**({"generations": generations} | (settings or {})))
        s.genes = len(judge.space)

        def fitness(pop: DataFrame) -> DataFrame:
            return judge.fitness(pop, ("_0", "_1")).withColumnRenamed(f"_{at}", "fitness").drop(f"_{1 - at}")

        pop, _ = evolve.run(evolve.initial(spark, size or people, s), fitness, s)
        best = pop.orderBy(F.desc("fitness"), "ind_id").limit(1)
        return judge.score(next(iter(judge.values(best).values())))

    try:
        scores = together(spark, [partial(found, 0), partial(found, 1)])
    finally:
        shared.release()
    rows = [(driver, m, x) for driver, own in zip(both, scores) for m, x in zip(both, own)]
    rows += [("difference", m, b - a) for m, a, b in zip(both, *scores)]
    return spark.createDataFrame(rows, "driver string, metric string, score double")
