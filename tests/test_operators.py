import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkevo.functions import order
from sparkevo.functions.order import ordinals, quantiles, running
from sparkevo.operators import checks, components, evolve, learn, neighbours, niche, pareto, prepare, profile, space
from sparkevo.operators import tests as paired
from sparkevo.sources import readers


@pytest.fixture(scope="module")
def numbers(spark):
    random = np.random.default_rng(0)
    rows = [(i, float(random.normal()), None if i % 5 == 0 else float(random.integers(4)), 7.0) for i in range(300)]
    rows += [(1000, float("nan"), float("inf"), 7.0), (1001, None, None, 7.0)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, z double")


def column(df, c):
    return np.array([r[0] for r in df.select(c).collect() if r[0] is not None and math.isfinite(r[0])])


@pytest.mark.parametrize("accuracy", [4, 50, 1000])
def test_quantiles_are_exact(numbers, monkeypatch, accuracy):
    monkeypatch.setattr(order, "LEAF", 3)
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    clean = profile.clean(numbers, ["x", "y", "z"])
    got = quantiles(clean, ["x", "y", "z"], (0.0, 0.25, 0.37, 0.5, 1.0))
    for c in ("x", "y", "z"):
        assert np.allclose(got[c], np.quantile(column(numbers, c), (0.0, 0.25, 0.37, 0.5, 1.0)))
    assert quantiles(clean.filter("false"), ["x"], (0.5,)) == {"x": [None]}


def test_running_and_ordinals(numbers):
    clean = profile.clean(numbers, ["x", "y"]).filter("y is not null")
    rows = {r.y: r.n_before for r in running(clean, "y", {"n": F.count(F.lit(1))}).collect()}
    y = column(numbers, "y")
    assert rows == {v: int((y < v).sum()) for v in set(y)}
    got = {r.id: r.ordinal for r in ordinals(clean, "y", "id", descending=True).collect()}
    want = sorted(((r.y, r.id) for r in clean.collect()), key=lambda p: (-p[0], p[1]))
    assert got == {i: k for k, (_, i) in enumerate(want, 1)}


@pytest.mark.parametrize("strategy", ["mean", "median", "mode", "constant", "drop"])
def test_imputers_leave_nothing_missing(numbers, strategy):
    out = prepare.Imputer(["x", "y", "z"], strategy).fit_transform(numbers)
    left = [c for c in ("x", "y", "z") if c in out.columns]
    assert all(v is not None and math.isfinite(v) for r in out.select(*left).collect() for v in r)
    with pytest.raises(RuntimeError):
        prepare.Imputer(["x"], strategy).transform(numbers)


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust", "maxabs"])
def test_scalers_invert(numbers, kind):
    plain = numbers.filter("id < 1000 and y is not null")
    s = prepare.get_scaler(kind, ["x", "z"]).fit(plain)
    back = s.inverse_transform(s.transform(plain))
    for c in ("x", "z"):
        assert np.abs(np.sort(column(back, c)) - np.sort(column(plain, c))).max() < 1e-10
    if kind != "maxabs":
        assert set(column(s.transform(plain), "z")) == {0.0}
    with pytest.raises(ValueError):
        prepare.get_scaler("other", ["x"])


def test_folds_are_balanced(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3).alias("label"))
    n = prepare.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in range(3):
        own = [r["count"] for r in n if r.label == label]
        assert len(own) == 5 and max(own) - min(own) <= 1


def test_p_values():
    assert abs(paired.t_p_value(2.776445, 5) - 0.05) < 1e-5 and abs(paired.t_p_value(2.262157, 10) - 0.05) < 1e-5
    assert paired.wilcoxon_p_value(0, 5) == 2 / 32 and paired.wilcoxon_p_value(8, 10) == 50 / 1024
    assert paired.t_p_value(None, 5) == 1.0


def test_codec(spark):
    s = {"a": space.Gene("discrete", 1, 6), "b": space.Gene("categorical", values=("u", "v", "w")), "c": space.Gene("continuous", 0.01, 100.0, "log10")}
    df = spark.range(7).select((F.col("id") / 6).alias("g"))
    out = df.select(*[c.alias(n) for n, c in space.decode(s, F.array("g", "g", "g")).items()]).collect()
    assert [r.a for r in out] == [round(1 + k / 6 * 5) for k in range(7)]
    assert [r.b for r in out] == ["uvw"[round(k / 6 * 2)] for k in range(7)]
    assert np.allclose([r.c for r in out], [10 ** (-2 + 4 * k / 6) for k in range(7)])
    with pytest.raises(Exception):
        spark.range(1).select(s["a"].encode(F.lit(9))).collect()


def test_three_objectives(spark):
    random = np.random.default_rng(4)
    v = random.integers(0, 6, (150, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "ind_id bigint, obj_0 double, obj_1 double, obj_2 double")
    got = {r.ind_id for r in pareto.front(df, 3).collect()}
    assert got == {i for i, a in enumerate(v) if not any((b >= a).all() and (b > a).any() for b in v)}


def test_nearest_is_exact(spark):
    random = np.random.default_rng(1)
    v = random.integers(0, 3, (200, 5)).astype(float)
    df = spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(v)], "id bigint, label bigint, features array<double>").repartition(4)
    got = {(r.id, r.place): r.nb for r in neighbours.nearest(df, F.col("id") % 50 == 0, 7).collect()}
    for q in (0, 50, 100, 150):
        want = sorted((float(((v[i] - v[q]) ** 2).sum()), i) for i in range(200) if i != q)[:7]
        assert [got[q, k] for k in range(1, 8)] == [i for _, i in want]


def test_components(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(200, 3)) @ random.normal(size=(3, 10)) + 0.1 * random.normal(size=(200, 10)) + 1e4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, features array<double>").repartition(3)
    pca = components.PCA(0.95).fit(df)
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 199
    assert np.allclose(pca.variance, values[: len(pca.variance)]) and len(pca.axes) <= 3
    back = pca.inverse_transform(pca.transform(df)).orderBy("id").collect()
    assert np.mean((np.array([r.restored for r in back]) - x) ** 2) < 0.1


def test_best_never_falls(spark):
    start = spark.range(12).select(F.col("id").alias("ind_id"), F.array(*[F.rand(i) for i in range(4)]).alias("genes"))
    fit = lambda d: d.withColumn("fitness", -F.aggregate("genes", F.lit(0.0), lambda s, x: s + x * x))
    pop, history = evolve.run(start, fit, evolve.Settings(generations=3, mutation=0.5))
    best = [h.best for h in history]
    assert best == sorted(best) and pop.count() == 12
    told = evolve.summary(history)
    assert told["best"] == best[-1] and told["evaluations"] == 12 + 11 * (len(history) - 1) and best[told["found"]] == best[-1]


def test_readers(spark, tmp_path):
    (tmp_path / "a.data").write_text("# head\n1 2 3\n\n4,5,6\n7 x 9\n1 2\n")
    found = readers.read_numbers(spark, str(tmp_path / "a.data"), 3)
    assert sorted((r.f_0, r.f_1, r.label) for r in found.frame.collect()) == [(1, 2, 3), (4, 5, 6)]
    assert readers.detect_delimiter("a,b,c") == "," and readers.detect_delimiter("1 2") is None and readers.detect_target(["x", "Class", "z"]) == "Class"
    with pytest.raises(ValueError):
        readers.detect_format("x.arff")
    r = readers.Registry(spark)
    (tmp_path / "b.csv").write_text("1,2\n")
    r.register("d", str(tmp_path / "none.csv"), 1)
    r.register("d", str(tmp_path / "b.csv"), 2)
    assert r.load("d", header=False).count() == 1
    with pytest.raises(ValueError):
        r.load("other")


def test_profile_of_odd_columns(numbers):
    stats = {r.feature: r for r in profile.feature_stats(numbers, ["x", "y", "z"]).collect()}
    assert stats["z"]["std"] == 0 and stats["x"]["missing"] == 2 and stats["y"]["missing"] == 62
    matrix = {(r.a, r.b): r.r for r in profile.correlations(numbers, ["x", "y", "z"]).collect()}
    assert matrix["x", "z"] == 0.0 and matrix["x", "x"] == 1.0


def test_one_far_value_leaves_cells_even(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") == 0, 1e15).otherwise(F.col("id").cast("double")).alias("x"))
    sizes = [r["count"] for r in order.celled(df, "x", "_cell").groupBy("_cell").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 400
    got = {r.id: r.ordinal for r in ordinals(df, "x", "id").collect()}
    assert got[1] == 1 and got[0] == 10_000 and got[9_999] == 9_999


def test_null_groups_and_clashing_names(spark):
    rows = [(i, None if i % 4 == 0 else i % 3, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, x double").withColumns({c: F.lit(c) for c in ("n", "_bin", "_cell", "_cell_of", "_before", "_at", "_n", "_rank", "_size", "_key")})
    for out in (prepare.stratified_folds(df, "label", "id", 3), prepare.stratified_split(df, "label", "id", 0.25)):
        assert out.columns == [*df.columns, out.columns[-1]] and out.count() == 60
        assert all(r.n == "n" and r._bin == "_bin" for r in out.collect())
    folds = prepare.stratified_folds(df, "label", "id", 3).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r.label is None} == {5}
    got = ordinals(df, "x", "id", ["label"])
    assert got.columns == [*df.columns, "ordinal"] and got.count() == 60
    want = {}
    for label in {r[1] for r in rows}:
        want |= {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[1] == label), key=lambda r: (r[2], r[0])), 1)}
    assert {r.id: r.ordinal for r in got.collect()} == want
    with pytest.raises(ValueError):
        prepare.shuffled_rank(df, "label", "id")


def test_fill_over_all_keeps_columns(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i), "c") for i in range(50)], "t bigint, x double, _cell_of string")
    got = prepare.filled_over_all(df, "x", "t").orderBy("t").collect()
    assert [r.x for r in got] == [float(i - i % 3) for i in range(50)] and got[0]["_cell_of"] == "c"


def pareto_ranks(v):
    left, out, k = set(range(len(v))), {}, 0
    while left:
        own = {i for i in left if not any((v[j] >= v[i]).all() and (v[j] > v[i]).any() for j in left)}
        out |= {i: k for i in own}
        left -= own
        k += 1
    return out


@pytest.mark.parametrize("n", [2, 3])
def test_pareto_by_hand(spark, monkeypatch, n):
    monkeypatch.setattr(pareto, "AT_ONCE", 2)
    monkeypatch.setattr(pareto, "FAN_IN", 2)
    random = np.random.default_rng(n)
    v = random.integers(0, 9, (120, n)).astype(float)
    names = [f"obj_{i}" for i in range(n)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "ind_id bigint, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    rank, found = pareto_ranks(v), pareto.crowding(pareto.ranks(df, n), n, "ind_id").cache()
    assert {r.ind_id: r.pareto_rank for r in found.collect()} == rank
    crowd = {}
    for k in set(rank.values()):
        own = [i for i in rank if rank[i] == k]
        gap = dict.fromkeys(own, 0.0)
        for o in range(n):
            order_ = sorted(own, key=lambda i: (v[i, o], i))
            span = v[order_[-1], o] - v[order_[0], o]
            for a, b, c in zip(order_, order_[1:], order_[2:]):
                gap[b] += (v[c, o] - v[a, o]) / span if span else 0.0
            gap[order_[0]] = gap[order_[-1]] = float("inf")
        crowd |= gap
    assert all(abs(r.crowding - crowd[r.ind_id]) < 1e-9 or r.crowding == crowd[r.ind_id] for r in found.collect())
    want = sorted(rank, key=lambda i: (rank[i], -crowd[i], i))[:50]
    assert {r.ind_id for r in pareto.survivors(found, 50, "ind_id").collect()} == set(want)
    assert {r.ind_id for r in pareto.ranks(df, n, most=1).collect()} == {i for i in rank if rank[i] == 0}
    some = pareto.ranks(df, n, rows=30)
    assert 30 <= some.count() and {r.ind_id: r.pareto_rank for r in some.collect()}.items() <= rank.items()


@pytest.mark.parametrize("cell", [40, 1_000_000])
def test_all_fronts_of_two_objectives(spark, monkeypatch, cell):
    monkeypatch.setattr(pareto, "CELL", cell)
    random = np.random.default_rng(4)
    for v in (random.integers(0, 12, (300, 2)), random.normal(size=(250, 2)), np.column_stack((np.arange(200), np.arange(200))), np.column_stack((np.arange(90), -np.arange(90))), np.zeros((5, 2)), np.zeros((0, 2))):
        v = v.astype(float)
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "ind_id bigint, obj_0 double, obj_1 double").repartition(3)
        assert {r.ind_id: r.pareto_rank for r in pareto.ranks(df, 2).collect()} == (pareto_ranks(v) if len(v) else {})


def test_a_long_chain(spark):
    df = spark.range(100_000).select(F.col("id").alias("ind_id"), F.col("id").cast("double").alias("obj_0"), (F.col("id") * 2).cast("double").alias("obj_1"))
    assert pareto.ranks(df, 2).filter(F.col("pareto_rank") != F.lit(99_999) - F.col("ind_id")).count() == 0


def test_crowding_of_few_values(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 50)
    df = spark.range(400).select(F.col("id").alias("ind_id"), (F.col("id") % 3).cast("double").alias("obj_0"), F.lit(0).alias("pareto_rank"), (F.col("id") % 7).cast("double").alias("obj_1"))
    got = {r.ind_id: r.crowding for r in pareto.crowding(df, 2, "ind_id").collect()}
    monkeypatch.setattr(order, "FEW", 20_000)
    assert got == {r.ind_id: r.crowding for r in pareto.crowding(df, 2, "ind_id").collect()} and len(got) == 400


def broadcast_rows(spark, run):
    """What run gives, and the rows of the largest table that it broadcast."""
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = {e.executionId() for e in listed(store.executionsList())}
    got, most = run(), 0
    bus.waitUntilEmpty()
    for e in listed(store.executionsList()):
        if e.executionId() in seen:
            continue
        values = listed(store.executionMetrics(e.executionId()))
        for node in listed(store.planGraph(e.executionId()).allNodes()):
            for m in listed(node.metrics()) if node.name() == "BroadcastExchange" else ():
                if m.name() == "number of output rows":
                    most = max(most, int((values.get(m.accumulatorId()) or "0").replace(",", "")))
    return got, most


def test_nsga2_broadcasts_no_population(spark, monkeypatch):
    from sparkevo.functions.hashing import uniform

    start = spark.range(600).select(F.col("id").alias("ind_id"), F.array(*[F.round(uniform(3, F.col("id"), F.lit(i)), 2) for i in range(4)]).alias("genes"))
    aims = lambda d: d.withColumns({"obj_0": F.col("genes")[0] + F.col("genes")[1], "obj_1": -F.col("genes")[0] - F.col("genes")[2]})
    search = lambda: {r.ind_id: tuple(r) for r in evolve.nsga2(start, aims, 2, evolve.Settings(generations=1)).collect()}
    want = search()
    monkeypatch.setattr(order, "FEW", 60)
    got, most = broadcast_rows(spark, search)
    assert got == want and len(got) == 600
    assert most <= 60  # a row a front at most, not one an individual


def test_neighbours_over_blocks(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("ind_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 37 % 50).cast("double").alias("x"))
    want = sorted(map(str, order.neighbours(df, "x", "ind_id", ["k"], "a", "b").collect()))
    for few in (1, 2, 7, 134):
        monkeypatch.setattr(order, "FEW", few)
        got = order.neighbours(df, "x", "ind_id", ["k"], "a", "b")
        assert got.columns == ["ind_id", "k", "x", "a", "b"] and sorted(map(str, got.collect())) == want


def test_draws_of_one_dominant_individual(spark, monkeypatch):
    from sparkevo.operators import select

    pop = spark.range(3000).select(F.col("id").alias("ind_id"), F.when(F.col("id") == 7, 1.0 - 2999e-7).otherwise(1e-7).alias("prob"))
    draws = spark.range(5000).select(F.col("id").alias("draw_id"), ((F.col("id") + 0.5) / 5000).alias("u")).unionByName(spark.createDataFrame([(5000, 1 - 1e-17), (5001, 0.0)], "draw_id bigint, u double"))
    found = []
    for few in (100, 20_000):
        monkeypatch.setattr(order, "FEW", few)
        found.append({r.draw_id: r.ind_id for r in select.picked(pop, draws).collect()})
    assert found[0] == found[1] and len(found[0]) == 5002 and found[0][5000] == 2999 and found[0][5001] == 0
    assert sum(i == 7 for i in found[0].values()) > 4990


def test_draws_of_a_class_that_lacks_many_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 100)
    rows = spark.range(30).select("id", F.when(F.col("id") < 3, 1).when(F.col("id") < 5, None).otherwise(0).alias("label"))
    needed = spark.createDataFrame([(0, 25, 0), (1, 3, 4000), (None, 2, 7)], "label int, n bigint, needed bigint")
    got = neighbours.drawn(rows, needed).collect()
    assert sorted(r.draw for r in got if r.label == 1) == list(range(1, 4001)) and {r.id for r in got if r.label == 1} == {0, 1, 2}
    assert sorted(r.draw for r in got if r.label is None) == list(range(1, 8)) and {r.id for r in got if r.label is None} <= {3, 4}


def greedy(genes, places, threshold):
    led = {}
    for i in sorted(genes, key=lambda i: places[i]):
        near = [j for j in led.values() if sum(abs(a - b) for a, b in zip(genes[i], genes[j])) / len(genes[i]) < threshold]
        led[i] = min(near, key=lambda j: places[j]) if near else i
    return led


@pytest.mark.parametrize("width", [1, 3])
def test_species_as_one_after_another(spark, monkeypatch, width):
    random = np.random.default_rng(width)
    for name, genes in {
        "copies": np.repeat(random.random((40, width)), 3, 0),
        "ties": random.integers(0, 5, (120, width)) / 8,
        "chain": np.repeat(np.arange(40)[:, None] * 0.03, width, 1),
    }.items():
        fitness = random.integers(0, 20, len(genes)).astype(float)
        rows = {i: list(map(float, g)) for i, g in enumerate(genes)}
        pop = spark.createDataFrame([(i, g, float(fitness[i])) for i, g in rows.items()], "ind_id bigint, genes array<double>, fitness double").repartition(3)
        for few, early in ((20_000, 512), (20, 3 if name == "copies" else 512))[: 1 if name == "ties" else 2]:
            monkeypatch.setattr(order, "FEW", few)
            monkeypatch.setattr(niche, "EARLIEST", early)
            got = {r.ind_id: r.leader for r in niche.species(pop, 0.12).collect()}
            assert got == greedy(rows, {i: i for i in rows}, 0.12), (name, few, early)
        monkeypatch.setattr(order, "FEW", 20_000)
        best = greedy(rows, {i: (-fitness[i], i) for i in rows}, 0.12)
        assert {r.ind_id: (r.leader, r.cleared) for r in niche.clearing(pop, 0.12).collect()} == {i: (j, fitness[i] if i == j else 0) for i, j in best.items()}
    assert {r.leader for r in niche.species(pop, 0.0).collect()} == set(rows)


def test_sharing_without_queries(spark):
    pop = spark.createDataFrame([(1, [0.5], 1.0)], "ind_id bigint, genes array<double>, fitness double")
    assert niche.shared_fitness(pop, F.lit(False)).count() == 0 and niche.species(pop.filter("false"), 0.1).count() == 0


@pytest.fixture(scope="module")
def uneven(spark):
    random = np.random.default_rng(6)
    rows = [(i, int(i % 10 == 0), (random.normal(size=3) + 2 * (i % 10 == 0)).tolist()) for i in range(150)]
    return spark.createDataFrame(rows, "id bigint, label bigint, features array<double>")


@pytest.mark.parametrize("strategy", neighbours.STRATEGIES)
def test_resample(uneven, strategy):
    got = neighbours.resample(uneven, strategy).collect()
    n = {k: sum(r.label == k for r in got) for k in (0, 1)}
    assert n == {"none": {0: 135, 1: 15}, "random_under": {0: 15, 1: 15}}.get(strategy, {0: 135, 1: 135})
    assert len({r.id for r in got}) == len(got)
    old = {r.id: r.features for r in uneven.collect()}
    assert all(old[r.id] == r.features for r in got if not r.made) and all(r.id > 149 and r.label == 1 for r in got if r.made)
    minority = np.array([v for i, v in old.items() if i % 10 == 0])
    for r in got:
        if r.made and strategy == "random_over":
            assert r.features in minority.tolist()
        elif r.made:  # on a segment between two rows of the class
            x = np.array(r.features)
            a, b = minority[:, None], minority[None]
            t = ((x - a) * (b - a)).sum(-1) / np.maximum(((b - a) ** 2).sum(-1), 1e-12)
            assert np.abs(a + np.clip(t, 0, 1)[..., None] * (b - a) - x).max(-1).min() < 1e-9
    with pytest.raises(ValueError):
        neighbours.resample(uneven, "other")


def test_resample_ratio_and_single_rows(spark):
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(20)] + [(50, 1, [9.0])], "id bigint, label bigint, features array<double>")
    got = neighbours.resample(df, "smote", {1: 4.0}).filter("made").collect()
    assert [r.features for r in got] == [[9.0]] * 4 and sorted(r.id for r in got) == [51, 52, 53, 54]


def test_manhattan_neighbours(uneven):
    got = {(r.id, r.place): r.nb for r in neighbours.nearest(uneven, F.col("id") % 50 == 0, 3, metric="manhattan").collect()}
    v = {r.id: np.array(r.features) for r in uneven.collect()}
    for q in (0, 50, 100):
        want = sorted((float(np.abs(v[i] - v[q]).sum()), i) for i in v if i != q)[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in want]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_index_of_pivots(spark, monkeypatch, metric):
    """All rows are queries, in several blocks; the same as brute force, with a part of its comparisons."""
    monkeypatch.setattr(order, "FEW", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 8 * 6 * 150)
    random = np.random.default_rng(9)
    x = np.round(random.normal(size=(12, 6))[random.integers(0, 12, 600)] * 20 + random.normal(size=(600, 6)), 3)
    x[:200] = np.round(x[200] + random.normal(size=(200, 6)) * 0.5, 1)  # one cell is larger than a block
    x[50:60] = x[50]
    label = random.integers(0, 3, 600)
    df = spark.createDataFrame([(i, int(label[i]), v.tolist()) for i, v in enumerate(x)], "id bigint, label bigint, features array<double>").repartition(3)
    for same in (False, True):
        counter = spark.sparkContext.accumulator(0)
        got = {(r.id, r.place): r.nb for r in neighbours.nearest(df, F.lit(True), 4, same_class=same, metric=metric, counter=counter).collect()}
        d = np.stack([(np.abs(x - v) if metric == "manhattan" else (x - v) ** 2).sum(1) for v in x])
        np.fill_diagonal(d, np.inf)
        if same:
            d[label[:, None] != label[None]] = np.inf
        want = {(i, p): int(j) for i in range(600) for p, j in enumerate(np.lexsort((np.arange(600), d[i]))[:4], 1)}
        assert got == want
        assert 0 < counter.value < 0.6 * 600 * 600


def test_queries_stay_off_the_driver(spark, monkeypatch):
    """Beyond few rows only the pivots are brought to the driver, whatever the number of queries."""
    monkeypatch.setattr(order, "FEW", 50)
    df = spark.range(400).select("id", (F.col("id") % 2).alias("label"), F.array(F.rand(1), F.rand(2)).alias("features"))
    taken, frame = [], type(df)
    for name in ("toPandas", "toArrow", "collect"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): [taken.append(len(got := f(self))), got][1])
    near = neighbours.nearest(df, F.lit(True), 3)
    assert max(taken) <= 20
    assert near.count() == 1200


@pytest.mark.parametrize("manhattan", [False, True])
@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e20), (0.0, 1e-12)])
def test_coarse_distances_leave_none_out(monkeypatch, manhattan, offset, scale):
    """Candidates are found without full distances of all pairs, few of them are judged, and they hold the exact best; rows may come again."""
    random = np.random.default_rng(4)
    x, y = (np.round(random.normal(size=(n, 20)), 2) * scale + offset for n in (70, 3000))
    y[:40] = y[40:80]  # ties
    y[100:130], y[200] = x[:30], 1e3 * scale + offset
    x[60, 3] = y[300, 5] = np.nan  # these two have no neighbours, and are none
    y[301, 2] = np.inf
    labels, own = random.integers(0, 3, 3000), np.arange(3000) + 60
    full = neighbours.distances(x, y, True) if manhattan else ((x[:, None] - y[None]) ** 2).sum(-1)
    monkeypatch.setattr(neighbours, "distances", None)
    for same in (False, True):
        top, judged = neighbours._Top(np.arange(70), x, labels[:70], 4, same, manhattan), []
        merge = top._merge
        top._merge = lambda at, *rest: [judged.append(len(at)), merge(at, *rest)]
        for part in (slice(0, 3000), slice(500, 900)):
            top.see(np.arange(70), top.tell(y[part], own[part], labels[part]))
        assert np.isinf(top.d[60]).all()
        d = np.where(~np.isfinite(full) | (np.arange(70)[:, None] == own[None]) | (same & (labels[:70, None] != labels[None])), np.inf, full)
        best = np.stack([np.lexsort((own, row))[:4] for row in d])
        finite = np.arange(70) != 60
        assert (top.i == own[best])[finite].all() and np.allclose(top.d[finite], np.take_along_axis(d, best, 1)[finite], rtol=1e-9, atol=0)
        assert sum(judged) < 0.75 * 70 * 3000


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_index_that_rules_nothing_out(spark, monkeypatch, metric):
    """Even rows of many dimensions: queries see all rows in large tiles, those seen before again, and the result stays exact."""
    monkeypatch.setattr(order, "FEW", 50)
    x = np.random.default_rng(5).normal(size=(2000, 24))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id bigint, label bigint, features array<double>").repartition(3)
    counter = spark.sparkContext.accumulator(0)
    got = {(r.id, r.place): r.nb for r in neighbours.nearest(df, F.lit(True), 3, metric=metric, counter=counter).collect()}
    d = np.stack([(np.abs(x - v) if metric == "manhattan" else (x - v) ** 2).sum(1) for v in x])
    np.fill_diagonal(d, np.inf)
    assert got == {(i, p): int(j) for i in range(2000) for p, j in enumerate(np.argsort(d[i])[:3], 1)}
    assert counter.value > 2000 * 2000


def test_many_queries_have_few_candidates(spark):
    """Queries as many as the rows are split, not the rows, whose blocks each have k candidates a query."""
    df = spark.range(400).select("id", F.lit(0).cast("bigint").alias("label"), F.array(F.rand(1), F.rand(2)).alias("features"))
    assert neighbours._indexed(df, df, 400, 3, False, False, 2, None).count() == 1200


def test_adasyn_searches_once_for_all_classes(spark, monkeypatch):
    rows = [(i, max(0, i % 10 - 6), [float(i % 7), float(i)]) for i in range(60)]
    df, calls, search = spark.createDataFrame(rows, "id bigint, label bigint, features array<double>"), [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a, **b: [calls.append(1), search(*a, **b)][1])
    got = neighbours.resample(df, "adasyn").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 42, 1: 42, 2: 42, 3: 42}
    assert len(calls) == 2  # densities, then neighbours of the class


def test_knn_imputer(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(60, 4))
    gaps = random.random((60, 4)) < 0.2
    rows = [(i, *[None if g else float(v) for v, g in zip(r, m)]) for i, (r, m) in enumerate(zip(x, gaps))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double").repartition(3)
    got = {r.id: r for r in prepare.Imputer(["a", "b", "c", "d"], "knn", id_="id").fit_transform(df).collect()}
    x[gaps] = np.nan
    for i in range(60):
        for f, c in enumerate("abcd"):
            if not gaps[i, f]:
                assert got[i][c] == x[i, f]
                continue
            both = ~np.isnan(x) & ~np.isnan(x[i])
            d = np.where(both, (x - x[i]) ** 2, 0).sum(1) * 4 / np.maximum(1, both.sum(1))
            donors = sorted((d[j], j) for j in range(60) if j != i and both[j].any() and not np.isnan(x[j, f]))[:5]
            want = np.mean([x[j, f] for _, j in donors]) if donors else np.nanmean(x[:, f])  # a row without values
            assert abs(got[i][c] - want) < 1e-9


@pytest.mark.parametrize("adapt", ["diversity", "schedule", "self"])
def test_adaptive_runs(spark, adapt):
    s = evolve.Settings(generations=3, adapt=adapt)
    start = evolve.initial(spark, 10, s)
    assert start.select(F.size("genes")).first()[0] == (6 if adapt == "self" else 4)
    fit = lambda d: d.withColumn("fitness", -F.get("genes", F.lit(0)))
    _, history = evolve.run(start, fit, s)
    assert all(0.01 <= h.mutation <= 0.5 and 0.5 <= h.crossover <= 0.95 for h in history)
    if adapt == "schedule":
        assert history[0].mutation == 0.5 and history[0].mutation > history[-1].mutation


def test_run_stops_without_diversity(spark):
    same = spark.range(8).select(F.col("id").alias("ind_id"), F.array(*[F.lit(0.5)] * 4).alias("genes"))
    fit = lambda d: d.withColumn("fitness", F.lit(1.0))
    _, history = evolve.run(same, fit, evolve.Settings(generations=9, mutation=0.0, floor=0.01))
    assert len(history) == 3


def test_search_task(spark):
    random = np.random.default_rng(1)
    rows = [(i, i % 2, [float(v) if k or i % 9 else None for k, v in enumerate(random.normal(size=3) + 2 * (i % 2))]) for i in range(80)]
    frame = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    task = learn.SearchTask(frame, "logistic", folds=2, metrics=("accuracy", "macro_f1"))
    pop, _ = task.search(1, evolve.Settings(generations=0))
    assert pop.count() == 1 and not task.errors and not task.prepared.made.held and all(r.obj_0 > 0.8 for r in pop.collect())
    bad = learn.SearchTask(frame, "logistic", folds=2, metrics=("accuracy",))
    assert bad.score({"scaler": "standard", "rebalance": "none", "pca": 0.9, "C": "x", "penalty": "l1"}) == [0.0] and len(bad.errors) == 1
    bad.release()
    ring = [(i, int(i % 2), [math.cos(i) * (1 + i % 2), math.sin(i) * (1 + i % 2)]) for i in range(200)]
    ring = spark.createDataFrame(ring, "row_id bigint, label int, features array<double>")
    for kernel, least in (("linear", 0.0), ("rbf", 0.9)):
        said = learn.predictions("svm", {"C": 100.0, "kernel": kernel, "gamma": 1.0}, ring.filter("row_id < 150"), ring.filter("row_id >= 150"), 2, 2)
        assert said.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] >= least
    task = learn.SearchTask(ring, "logistic", folds=2, metrics=("accuracy", "roc_auc"))
    assert len(task.metrics) == 2
    for kernel, least in (("poly", 0.9), ("sigmoid", 0.4)):
        said = learn.predictions("svm", {"C": 100.0, "kernel": kernel, "gamma": 1.0, "degree": 2}, ring.filter("row_id < 150"), ring.filter("row_id >= 150"), 2, 2)
        assert said.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] >= least
    early = learn.predictions("gbt", {"trees": 5, "early_stop": True}, ring.filter("row_id < 150"), ring.filter("row_id >= 150"), 2, 2)
    assert early.count() == 50


def test_sketched_products_are_near_the_kernel(spark):
    random = np.random.default_rng(8)
    x = random.normal(size=(40, 5)) / 3
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "row_id bigint, features array<double>")
    got = {r.row_id: np.array(r.features) for r in learn.tensor_sketch(df, 5, degree=3, gamma=0.7, coef=1.0, size=2048).collect()}
    z = np.stack([got[i] for i in range(40)])
    want = (0.7 * x @ x.T + 1) ** 3
    assert np.abs(z @ z.T - want).mean() < 0.05 * np.abs(want).mean()


def test_a_generation_is_scored_at_once(spark):
    """Individuals of a generation overlap in time, and each is fitted once, on folds that are made once."""
    import threading

    random = np.random.default_rng(1)
    rows = [(i, i % 2, (random.normal(size=3) + i % 2).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    lock, running, most, made, asked = threading.Lock(), [0], [0], [], []

    class Task(learn.SearchTask):
        def on_fold(self, individual, fold):
            with lock:
                asked.append((str(sorted(individual.items())), fold))
                running[0] += 1
                most[0] = max(most[0], running[0])
            try:
                return super().on_fold(individual, fold)
            finally:
                with lock:
                    running[0] -= 1

    class Prepared(learn.Folds):
        def _prepared(self, *key):
            made.append(key)
            return super()._prepared(*key)

    shared = Prepared(frame, 2)
    task = Task(frame, "logistic", folds=shared)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    pop, history = task.search(4, evolve.Settings(generations=2))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert pop.count() == 4 and len(history) == 2 and most[0] >= 3
    assert len(asked) == len(set(asked)) and len(made) == len(set(made)) and not task.errors
    assert jobs < 60 * len(made) + 120 * len(asked)
    shared.release()


def test_lost_jobs_are_tried_again():
    calls = []

    def once_lost():
        calls.append(1)
        if len(calls) == 1:
            raise ConnectionError("executor lost")
        return 5

    assert learn.retried(once_lost) == 5 and len(calls) == 2
    with pytest.raises(ValueError):
        learn.retried(lambda: (_ for _ in ()).throw(ValueError("model")))


def test_comparison_of_kinds(spark):
    random = np.random.default_rng(2)
    rows = [(i, i % 2, (random.normal(size=2) + 3 * (i % 2)).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    got = learn.compare_kinds(frame, ["logistic", "knn"], size=2, settings={"generations": 1}, folds=2).collect()
    assert {(r.kind, r.metric) for r in got} == {(k, m) for k in ("logistic", "knn") for m in ("accuracy", "balanced_accuracy", "macro_f1")}
    assert sorted({r.place for r in got}) == [1, 2] and all(r.score > 0.8 for r in got)


def test_comparison_fits_no_model_again(spark, monkeypatch):
    frame = spark.createDataFrame([(i, i % 2, [float(i % 7), float(i % 2)]) for i in range(60)], "row_id bigint, label int, features array<double>")
    asked, prepared, fold, prepare_ = [], [], learn.SearchTask.on_fold, learn.Folds._prepared
    monkeypatch.setattr(learn.SearchTask, "on_fold", lambda self, v, f: [asked.append((self.kind, str(sorted(v.items())), f)), fold(self, v, f)][1])
    monkeypatch.setattr(learn.Folds, "_prepared", lambda self, *key: [prepared.append(key), prepare_(self, *key)][1])
    got = learn.compare_kinds(frame, ["logistic"], size=1, settings={"generations": 1}, folds=2).collect()
    assert len(asked) == 2 and len(prepared) == 2
    assert {r.metric: r.score for r in got}["balanced_accuracy"] == got[0].fitness and {r.metric for r in got} == {"accuracy", "balanced_accuracy", "macro_f1"}


def test_every_gene_may_mutate(spark):
    s = evolve.Settings(per_gene=True, mutation=1.0, crossover=0.0, genes=3)
    pop = spark.range(6).select(F.col("id").alias("ind_id"), F.array(*[F.lit(0.5)] * 3).alias("genes"), F.lit(1 / 6).alias("prob"))
    got = evolve.children(pop, pop.select("ind_id"), 0, s).collect()
    assert len(got) == 6 and all(g != 0.5 for r in got for g in r.genes)
    s = evolve.Settings(per_gene=True, mutation=0.0, crossover=0.0, genes=3)
    assert all(list(r.genes) == [0.5] * 3 for r in evolve.children(pop, pop.select("ind_id"), 0, s).collect())


def test_random_subspace_finds_the_components(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    whole, part = components.PCA(5).fit(rows), components.PCA(5, random=True)
    part.fit(rows)
    assert np.abs(whole.axes - part.axes).max() < 1e-6 if len(whole.axes[0]) <= 25 else np.allclose(whole.variance, part.variance, rtol=1e-3)
    full = components.PCA(64, random=True).fit(rows)
    assert np.allclose(components.PCA(64).fit(rows).variance, full.variance, atol=1e-9)
    random = np.random.default_rng(0)
    x = random.normal(size=(300, 4)) * [9, 6, 4, 2] @ random.normal(size=(4, 1500)) + random.normal(size=(300, 1500)) * 0.01
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>").repartition(4)
    got = components.PCA(4, random=True).fit(wide)
    values, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    assert np.abs(np.abs((got.axes * axes[:4]).sum(1)) - 1).max() < 1e-6 and np.allclose(got.variance, values[:4] ** 2 / 299, rtol=1e-6)
    assert np.isclose(got.ratio.sum(), (values[:4] ** 2).sum() / (values**2).sum(), rtol=1e-6)
    with pytest.raises(ValueError):
        components.PCA(0.9, random=True).fit(wide)


def test_apply_pca(numbers):
    df = numbers.filter("id < 1000").select("id", F.array("x", F.col("x") * 2, F.coalesce("y", F.lit(0.0))).alias("features"))
    out, pca = components.apply_pca(df, 0.99)
    assert len(pca.axes) == 2 and out.select(F.max(F.size("projected"))).first()[0] == 2


def test_spaces_from_specs():
    spec = {"depth": {"type": "discrete", "min": 1, "max": 9}, "rate": {"type": "continuous", "min": 0.01, "max": 1.0, "scale": "log10"}, "kind": {"values": ["a", "b"]}, "empty": {}}
    got = space.from_spec(spec, {"depth": {"max": 5}})
    assert got == {"depth": space.Gene("discrete", 1, 5), "rate": space.Gene("continuous", 0.01, 1.0, "log10"), "kind": space.Gene("categorical", values=("a", "b"))}
    with pytest.raises(ValueError):
        space.narrowed(space.SPACES["knn"], {"trees": (1,)})
    assert set(space.QUICK) == set(space.SPACES) and space.PRESETS["quick"] == (10, 5)


def test_more_readers(spark, tmp_path):
    (tmp_path / "x.data").write_text("".join(f"{i} {i * 2} {'NaN' if i % 3 == 0 else i}\n" for i in range(50)))
    (tmp_path / "y.data").write_text("".join(f"{-1 if i % 2 else 1} \"19/07/2008\"\n" for i in range(50)))
    pair = readers.read_pair(spark, str(tmp_path / "x.data"), str(tmp_path / "y.data"))
    rows = pair.frame.orderBy("row").collect()
    assert [(r.row, r.f_0, r.f_1, r.f_2, r.label) for r in rows] == [(i, i, 2 * i, None if i % 3 == 0 else i, 0 if i % 2 else 1) for i in range(50)]
    assert pair.metadata["missing"] == 17
    (tmp_path / "a.txt").write_text("1.5,2,1\n3,4,2\n")
    (tmp_path / "b.txt").write_text("5,6,3\n")
    union = readers.read_union(spark, [str(tmp_path / n) for n in ("a.txt", "b.txt")], shift=-1)
    assert sorted((r.f_0, r.f_1, r.label) for r in union.frame.collect()) == [(1.5, 2, 0), (3, 4, 1), (5, 6, 2)] and dict(union.frame.dtypes)["label"] == "bigint"
    assert dict(readers.read_numbers(spark, str(tmp_path / "a.txt"), 3, target=0).frame.dtypes)["label"] == "double"
    (tmp_path / "f.nna").write_text("".join(" ".join(map(str, [i, 0.5] + [int(k == i) for k in range(3)])) + "\n" for i in range(4)))
    got = readers.read_onehot(spark, str(tmp_path / "f.nna"), 2, 3).frame
    assert {r.f_0: r.label for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: -1}
    lines = [" ".join(map(str, [i, 0.5] + [int(k == i) for k in range(3)])) for i in range(4)]
    (tmp_path / "odd.nna").write_text("\n".join([*lines, lines[0] + " 9", "1 2"]) + "\n")
    odd = readers.read_onehot(spark, str(tmp_path / "odd.nna"), 2, 3)
    assert sorted((r.f_0, r.label) for r in odd.frame.collect()) == [(0, 0), (0, 0), (1, 1), (2, 2), (3, -1)] and odd.metadata["odd_lines"] == 2
    (tmp_path / "plain.nna").write_text("1 2 3\n4 5 6\n7 8 9 10 11\n")
    assert sorted(r.label for r in readers.read_onehot(spark, str(tmp_path / "plain.nna"), 2, 3).frame.collect()) == [3, 6, 9]
    np.savez(tmp_path / "i.npz", X_train=np.arange(24).reshape(2, 3, 4), y_train=[0, 1], X_test=np.ones((1, 3, 4)), y_test=[2])
    arrays = sorted((r.part, r.row, len(r.features), r.label) for r in readers.read(spark, str(tmp_path / "i.npz")).collect())
    assert arrays == [("test", 0, 12, 2), ("train", 0, 12, 0), ("train", 1, 12, 1)]
    assert readers.read(spark, str(tmp_path / "a.txt")).features == ["f_0", "f_1"]
    (tmp_path / "c.txt").write_text("name,class\nu,1\n")
    assert readers.read(spark, str(tmp_path / "c.txt")).features == ["name"]
    r = readers.Registry(spark)
    r.register("d", str(tmp_path / "none.csv"), 1)
    r.register("d", str(tmp_path / "a.txt"), 2, about="two rows")
    assert r.load("d").count() == 2 and r.available() == ["d"] and r.describe("d")["about"] == "two rows" and r.describe("e") == {}
    r.register("both", [str(tmp_path / n) for n in ("a.txt", "b.txt")], 1, kind="union", options={"shift": -1})
    r.register("pair", [str(tmp_path / n) for n in ("x.data", "y.data")], 1, kind="pair")
    r.register("arrays", str(tmp_path / "i.npz"), 1)
    assert r.load("both").count() == 3 and r.load("pair").count() == 50 and r.load("arrays").count() == 3 and r.available() == ["arrays", "both", "d", "pair"]
    assert sorted(x.label for x in r.load("both").collect()) == [0, 1, 2]
    spark.range(3).createOrReplaceTempView("in_session")
    assert r.load("in_session").count() == 3
    readers.write_metadata(spark, str(tmp_path / "meta"), {"a": [1]})
    assert readers.read_metadata(spark, str(tmp_path / "meta")) == {"a": [1]} and readers.read_metadata(spark, str(tmp_path / "no")) == {}
    assert readers.run_path("/x/", datetime.datetime(2020, 1, 2, 3, 4, 5)) == "/x/run_20200102_030405"


def test_checks(spark):
    df = spark.createDataFrame([(1.0, [1]), (2.5, []), (None, [1, 2])], "x double, a array<int>")
    got = {r.check: r.rows for r in checks.violations(df, {"in": checks.in_range("x", 1, 2), "pos": checks.positive("x"), "whole": checks.whole("x"), "one": checks.one_of("x", [1.0]), "len": checks.length("a", 1, 1)}).collect()}
    assert got == {"in": 2, "pos": 1, "whole": 2, "one": 2, "len": 2}
    checks.ratios(0.6, 0.2, 0.2)
    with pytest.raises(ValueError):
        checks.ratios(0.6, 0.5)
