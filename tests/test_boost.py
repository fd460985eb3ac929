"""Boosted histogram trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkevo.operators import boost, learn


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 12, (240, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) | (r.random(240) < 0.1)).astype(int)
    rows = [(i, int(y[i]), [None if i % 50 == 7 and f == 2 else float(v) for f, v in enumerate(x[i])]) for i in range(240)]
    return x, y, spark.createDataFrame(rows, "row_id bigint, label int, features array<double>").repartition(3)


def grown(bins, g, h, leaves, depth, l1, l2, least):
    """Best-first growth by trying every split of every leaf, one at a time."""
    parts, splits = [(np.arange(len(g)), 0)], []
    options = {}
    while len(parts) < leaves:
        best = None
        for k, (rows, level) in enumerate(parts):
            if level >= depth:
                continue
            if k not in options or options[k][0] is not rows:
                own = (0.0, -1, -1)
                for f in range(bins.shape[1]):
                    for b in range(bins[:, f].max()):
                        left = bins[rows, f] <= b
                        if min(left.sum(), (~left).sum()) < least:
                            continue
                        s = lambda m: max(abs(g[m].sum()) - l1, 0) ** 2 / (h[m].sum() + l2)
                        gain = (s(rows[left]) + s(rows[~left]) - s(rows)) / 2
                        if gain > own[0] + 1e-9:
                            own = (gain, f, b)
                options[k] = (rows, own)
            own = options[k][1]
            if own[1] >= 0 and (best is None or own[0] > best[0][0] + 1e-12):
                best = (own, k)
        if best is None:
            break
        (gain, f, b), k = best
        rows, level = parts[k]
        left = bins[rows, f] <= b
        splits.append(gain)
        parts[k] = (rows[left], level + 1)
        parts.append((rows[~left], level + 1))
    return parts, splits


@pytest.mark.parametrize("leaves,depth,l1,l2,least", [(2, 9, 0.0, 1.0, 1), (6, 9, 0.0, 0.0, 5), (9, 9, 1.5, 2.0, 3), (16, 3, 0.2, 1.0, 1)])
def test_a_tree_is_the_best_first_one(table, leaves, depth, l1, l2, least):
    x, y, df = table
    own = boost.Boosting(trees=1, leaves=leaves, depth=depth, l1=l1, l2=l2, least=least, rate=1.0, bins=32).fit(df)
    z = x.copy()
    z[np.arange(240) % 50 == 7, 2] = np.nan
    bins = np.stack([np.where(np.isnan(z[:, f]), 0, np.searchsorted(own.cuts[f], np.nan_to_num(z[:, f], nan=-1))) for f in range(3)], 1)
    p = y.mean()
    g, h = p - y, np.full(240, p * (1 - p))
    parts, _ = grown(bins, g, h, leaves, depth, l1, l2, least)
    want = np.zeros(240)
    for rows, _ in parts:
        want[rows] = np.log(p / (1 - p)) - np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - l1, 0) / (h[rows].sum() + l2)
    got = {r.row_id: r.margin for r in own.margins(df, "row_id").collect()}
    tree = own.grown[0]
    assert sum(f < 0 for f in tree.feature) == len(parts) <= leaves
    assert np.allclose([got[i] for i in range(240)], want)


def test_accuracy_and_early_stop(table):
    x, y, df = table
    train, test = df.filter("row_id % 4 <> 0"), df.filter("row_id % 4 = 0")
    right = lambda said: said.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    ours = right(learn.predictions("leafwise", {"trees": 10, "leaves": 8, "rate": 0.4}, train, test, 2, 3))
    plain = test.select("row_id", "label")
    assert ours >= 0.8 and plain.count() == 60
    spark_own = right(learn.predictions("gbt", {"trees": 10, "max_depth": 3, "rate": 0.4}, train.withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(0.0)))), test.withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(0.0)))), 2, 3))
    assert ours >= spark_own - 0.02
    stopped = boost.Boosting(trees=30, leaves=8, rate=1.0, patience=2).fit(train)
    assert len(stopped.losses) < 30 and len(stopped.grown) == int(np.argmin(stopped.losses)) + 1


def test_several_classes_and_odd_tables(spark):
    rows = [(i, i % 3, [float(i % 3), 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    said = learn.predictions("leafwise", {"trees": 2, "leaves": 4, "subsample": 0.8}, df, df, 3, 2).collect()
    assert len(said) == 90 and all(r.label == r.prediction for r in said)
    same = boost.Boosting(trees=3).fit(df.withColumn("label", F.lit(1)))
    assert not same.grown or same.margins(df, "row_id").agg(F.min("margin")).first()[0] > 0
    assert boost.Boosting(trees=1).fit(df.filter("false")).margins(df.filter("false"), "row_id").count() == 0
