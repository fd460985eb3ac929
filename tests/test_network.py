"""Networks: gradients against differences, sums over partitions, and what they learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkevo.operators import learn, network


@pytest.mark.parametrize("activation", sorted(network.ACTIVATIONS))
def test_gradients_are_differences(activation):
    r = np.random.default_rng(1)
    sizes, x, y = [4, 5, 3, 3], r.normal(size=(7, 4)), r.integers(0, 3, 7)
    flat = network.packed(network.initial(sizes, 2)) + r.normal(size=4 * 5 + 5 + 5 * 3 + 3 + 3 * 3 + 3) * 0.1
    loss, g = network.gradients(x, y, network.unpacked(flat, sizes), activation)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (network.gradients(x, y, network.unpacked(flat + s, sizes), activation)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4


def test_a_pass_over_partitions_is_one_over_all(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(50, 3)), r.integers(0, 2, 50)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, features array<double>").repartition(7)
    net = network.Network((4,), "tanh")
    net.sizes = [3, 4, 2]
    flat = network.packed(network.initial(net.sizes, 1))
    loss, g = net._pass(df, flat)
    want, h = network.gradients(x, y, network.unpacked(flat, net.sizes), "tanh")
    assert np.isclose(loss, want / 50) and np.allclose(g, h / 50)


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_rings_are_learnt(spark, activation):
    rows = [(i, i % 2, [float(np.cos(i) * (1 + i % 2)), float(np.sin(i) * (1 + i % 2))]) for i in range(160)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    said = learn.predictions("network", {"layer1": 16, "activation": activation, "max_iter": 60, "step": 0.1}, df.filter("row_id < 120"), df.filter("row_id >= 120"), 2, 2)
    assert said.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.9


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "row_id bigint, label int, features array<double>")
    net = network.Network((2,), max_iter=2).fit(df)
    assert net.predict(df, "row_id").first().prediction in (0, 1) and net.predict(df.filter("false"), "row_id").count() == 0
    assert network.Network((2,), max_iter=1).fit(df.filter("false")).weights is not None
    with pytest.raises(ValueError):
        network.Network(activation="none").fit(df)
    with pytest.raises(RuntimeError):
        network.Network().predict(df)
