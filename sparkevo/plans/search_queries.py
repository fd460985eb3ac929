"""Pareto sorting, niching, neighbours, rebalancing, components, models, evolution runs, sources and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import uniform_sql
from ..functions.shared import saved, scratch
from ..operators import checks, evolve, learn, metrics, neighbours, niche, pareto, prepare, profile, space
from ..operators.components import PCA, moments
from ..operators.frame import onehot_class
from ..sources import readers
from .evolution_queries import K, gene_sql, genes, population, u, u_sql
from .profile_queries import rounded
from .registry import query


def shared(t) -> str:
    return scratch(t("region").sparkSession)


# --- Pareto ----------------------------------------------------------------------------------------


@query("select p_partkey from part a where not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice))")
def pareto_front(t):
    return pareto.front(pareto.signed(t("part"), {"p_size": True, "p_retailprice": False}), 2).select("p_partkey")


OBJ_SQL = "(select s_suppkey as ind_id, s_acctbal as obj_0, -s_nationkey::double as obj_1 from supplier)"
RANKED_SQL = f"(with recursive p as {OBJ_SQL}, o as (select distinct obj_0, obj_1 from p), d as (select w.obj_0 as a, w.obj_1 as b, l.obj_0 as c, l.obj_1 as e from o w, o l where w.obj_0 >= l.obj_0 and w.obj_1 >= l.obj_1 and (w.obj_0 > l.obj_0 or w.obj_1 > l.obj_1)), r as (select obj_0, obj_1, 0 as k from o union select d.c, d.e, k + 1 from r join d on d.a = r.obj_0 and d.b = r.obj_1) select ind_id, p.obj_0, p.obj_1, cast(max(k) as integer) as pareto_rank from p join r using (obj_0, obj_1) group by all)"


def ranked(t):
    df = t("supplier").select(F.col(K).alias("ind_id"), "s_acctbal", "s_nationkey")
    return pareto.ranks(pareto.signed(df, {"s_acctbal": True, "s_nationkey": False}).drop("s_acctbal", "s_nationkey"), 2)


@query(f"select ind_id, pareto_rank from {RANKED_SQL}")
def pareto_rank(t):
    return ranked(t).select("ind_id", "pareto_rank")


def _gap(i):
    w = f"over (partition by pareto_rank order by obj_{i}, ind_id)"
    span = "over (partition by pareto_rank)"
    return f"lag(obj_{i}) {w} as p{i}, lead(obj_{i}) {w} as n{i}, max(obj_{i}) {span} - min(obj_{i}) {span} as r{i}"


CROWD_SQL = f"(select ind_id, pareto_rank, obj_0, case when p0 is null or n0 is null or p1 is null or n1 is null then 1e9 else coalesce((n0 - p0) / nullif(r0, 0), 0) + coalesce((n1 - p1) / nullif(r1, 0), 0) end as crowding from (select *, {_gap(0)}, {_gap(1)} from {RANKED_SQL}))"


def crowded(t):
    """Infinite crowding is shown as 1e9."""
    return pareto.crowding(ranked(t), 2, "ind_id").withColumn("crowding", F.least("crowding", F.lit(1e9)))


@query(f"select ind_id, pareto_rank, round(crowding, 6) as crowding from {CROWD_SQL}")
def crowding_distance(t):
    return rounded(crowded(t).select("ind_id", "pareto_rank", "crowding"), ["crowding"])


@query(f"select ind_id, pareto_rank from {CROWD_SQL} order by pareto_rank, crowding desc, ind_id limit (select count(*) // 2 from supplier)")
def env_selection(t):
    """Half of the population survives."""
    return pareto.survivors(crowded(t), t("supplier").count() // 2, "ind_id").select("ind_id", "pareto_rank")


_PAIR = " union all ".join(f"select s_suppkey as draw_id, 1 + cast(floor({u_sql('pair', k)} * (select count(*) from supplier)) as bigint) as ind_id from supplier" for k in range(2))


@query(f"select draw_id, ind_id from (select draw_id, ind_id, row_number() over (partition by draw_id order by pareto_rank, crowding desc, ind_id) as k from ({_PAIR}) join {CROWD_SQL} using (ind_id)) where k = 1")
def nsga_tournament(t):
    n = t("supplier").count()
    entries = t("supplier").select(F.col(K).alias("draw_id"), F.explode(F.array(*[F.lit(1) + F.floor(u("pair", k) * n) for k in range(2)])).alias("ind_id"))
    return pareto.best_of(entries.join(crowded(t), "ind_id"), "draw_id", "ind_id")


@query(f"select ind_id from (select ind_id, row_number() over (order by obj_0, ind_id) as k, count(*) over () as n from {CROWD_SQL} where pareto_rank = 0) where k = n // 2 + 1")
def pareto_compromise(t):
    """The middle of the front in the order of the first objective, then id."""
    from ..functions.order import ordinals

    best = crowded(t).filter("pareto_rank = 0")
    return ordinals(best, "obj_0", "ind_id").filter(F.col("ordinal") == F.lit(best.count() // 2 + 1)).select("ind_id")


# --- niching ---------------------------------------------------------------------------------------

POP_GENES = "(select s_suppkey as ind_id, s_acctbal as fitness, [" + ", ".join(gene_sql("pa", i) for i in range(4)) + "] as genes from supplier)"


def gene_population(t):
    return t("supplier").select(F.col(K).alias("ind_id"), F.col("s_acctbal").alias("fitness"), genes("pa").alias("genes"))


@query(f"select {K} as ind_id, round((" + " + ".join(f"abs({gene_sql('pa', i)} - {gene_sql('pb', i)})" for i in range(4)) + ") / 4, 6) as distance from supplier")
def chrom_distance(t):
    return rounded(t("supplier").select(F.col(K).alias("ind_id"), niche.distance(genes("pa"), genes("pb")).alias("distance")), ["distance"])


_DIST = "list_sum(list_transform(list_zip(a.genes, b.genes), lambda x: abs(x[1] - x[2]))) / 4"


@query(f"select round(avg({_DIST}), 6) as diversity from {POP_GENES} a join {POP_GENES} b on a.ind_id < b.ind_id")
def diversity_genotypic(t):
    return rounded(niche.genotypic(gene_population(t)), ["diversity"])


@query("select round(stddev_pop(s_acctbal), 6) as diversity from supplier")
def diversity_phenotypic(t):
    return rounded(niche.phenotypic(population(t)), ["diversity"])


@query(f"select ind_id, round(niche, 6) as niche, round(fitness / niche, 5) as shared from (select a.ind_id, a.fitness, sum(greatest(0, 1 - {_DIST} / 0.2)) as niche from {POP_GENES} a, {POP_GENES} b where a.ind_id % 50 = 0 group by 1, 2)")
def fitness_sharing(t):
    """For every individual whose id 50 divides, against all."""
    return rounded(rounded(niche.shared_fitness(gene_population(t), F.col("ind_id") % 50 == 0, 0.2), ["niche"]), ["shared"], 5)


def greedy_sql(order: str, threshold: float) -> str:
    """ind_id, fitness and leader of the gene population, leaders taken one after another in the order given."""
    near = f"list_sum(list_transform(list_zip({{0}}, {{1}}), lambda x: abs(x[1] - x[2]))) / 4 < {threshold}"
    return f"""(with recursive p as (select *, row_number() over (order by {order}) as k from {POP_GENES}),
s as (select 0::bigint as k, []::struct(k bigint, g double[])[] as led union all select s.k + 1, case when len(list_filter(s.led, lambda l: {near.format('l.g', 'p.genes')})) > 0 then s.led else list_append(s.led, {{'k': p.k, 'g': p.genes}}) end from s join p on p.k = s.k + 1),
l as (select unnest(led, recursive := true) from s where k = (select max(k) from s)),
m as (select p.ind_id, p.fitness, min(l.k) as k from p, l where l.k <= p.k and ({near.format('l.g', 'p.genes')} or l.k = p.k) group by all)
select m.ind_id, m.fitness, p.ind_id as leader from m join p using (k))"""


@query(f"select ind_id, leader, count(*) over (partition by leader) as size, round(fitness / count(*) over (partition by leader), 5) as shared from {greedy_sql('ind_id', 0.15)}")
def speciation(t):
    """Species of the genes, each led by its first member, and the fitness shared in them."""
    return rounded(niche.speciation(gene_population(t), 0.15), ["shared"], 5)


@query(f"select ind_id, leader, case when ind_id = leader then fitness else 0 end as cleared from {greedy_sql('fitness desc, ind_id', 0.1)}")
def clearing(t):
    """The best of each niche keep their fitness."""
    return niche.clearing(gene_population(t), 0.1)


# --- neighbours and rebalancing ----------------------------------------------------------------------

VEC = "(select vec_id as id, label, embedding::double[] as v from embeddings)"


def near_sql(k: int, extra: str = "true") -> str:
    return f"(select id, nb, nb_label, distance, place from (select a.id, b.id as nb, b.label as nb_label, d.distance, row_number() over (partition by a.id order by d.distance, b.id) as place from {VEC} a join {VEC} b on a.id <> b.id and a.id % 50 = 0 and ({extra}), lateral (select list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as distance) d) where place <= {k})"


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def asked():
    return F.col("id") % 50 == 0


@query(f"with v as (select id, nb_label, count(*) as n from {near_sql(5)} group by 1, 2) select id, cast(nb_label as bigint) as prediction from (select *, row_number() over (partition by id order by n desc, nb_label) as k from v) where k = 1")
def knn_classify(t):
    """Classes of the vectors whose id 50 divides, by their five nearest among all."""
    return neighbours.vote(neighbours.nearest(vectors(t), asked(), 5))


@query(f"select id, nb, cast(place as integer) as place, round(distance, 6) as distance from {near_sql(5, 'a.label = b.label')}")
def smote_neighbours(t):
    return rounded(neighbours.nearest(vectors(t), asked(), 5, same_class=True).select("id", "nb", "place", "distance"), ["distance"])


_DRAW = "cast(floor({0} * 5) as integer) + 1".format("(cast(('0x'||substr(md5('42:'||cast(id as varchar)||':'||cast(draw as varchar)||':nb'),1,8))::bigint as double)/4294967296.0)")
_GAP = "(cast(('0x'||substr(md5('42:'||cast(id as varchar)||':'||cast(draw as varchar)||':gap'),1,8))::bigint as double)/4294967296.0)"


@query(f"select d.id, d.draw, x.label, round(x.v[1] + gap * (y.v[1] - x.v[1]), 6) as f0, round(x.v[64] + gap * (y.v[64] - x.v[64]), 6) as f63 from (select id, cast(draw as integer) as draw, {_DRAW} as place, {_GAP} as gap from {VEC}, range(3) r(draw) where id % 50 = 0) d join {near_sql(5, 'a.label = b.label')} n on n.id = d.id and n.place = d.place join {VEC} x on x.id = d.id join {VEC} y on y.id = n.nb")
def smote_synthetic(t):
    near = neighbours.nearest(vectors(t), asked(), 5, same_class=True)
    made = neighbours.synthetic(vectors(t), near, 3)
    return made.select("id", "draw", "label", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[63], 6).alias("f63"))


@query(f"select id, round(density, 6) as density, round(case when sum(density) over () > 0 then density / sum(density) over () else 1.0 / count(*) over () end, 6) as weight from (select id, avg(cast(nb_label = 0 as double)) as density from {near_sql(5)} group by 1)")
def adasyn_density(t):
    return rounded(neighbours.density(neighbours.nearest(vectors(t), asked(), 5), 0), ["density", "weight"])


@query(f"select id, round(avg(y.v[1]), 6) as f0 from {near_sql(5, 'b.id % 50 <> 0').replace('a.v, b.v', 'a.v[2:], b.v[2:]')} n join (select id as nb, v from {VEC}) y using (nb) group by 1")
def impute_knn(t):
    """The first entry of the vectors whose id 50 divides, taken as missing: mean of the five nearest others by the rest."""
    rows = vectors(t).withColumn("first", F.col("features")[0]).withColumn("features", F.slice("features", 2, 1000))
    near = neighbours.nearest(rows, asked(), 5, donors=~asked())
    return rounded(near.join(rows.select(F.col("id").alias("nb"), "first"), "nb").groupBy("id").agg(F.avg("first").alias("f0")), ["f0"])


_SEG = "(select c_mktsegment as label, count(*) as n from customer group by 1)"


@query(f"select label, n, cast((select max(n) from {_SEG}) - n as bigint) as needed from {_SEG}")
def resample_targets(t):
    return neighbours.targets(t("customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n")))


@query("select c_custkey, c_mktsegment from (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5('42:'||cast(c_custkey as varchar)), c_custkey) as k, (select min(n) from " + _SEG + ") as least from customer) where k <= least")
def undersample(t):
    """Every class at the size of the smallest, by a seeded shuffle."""
    least = t("customer").groupBy("c_mktsegment").count().agg(F.min("count")).first()[0] or 0
    return prepare.shuffled_rank(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").filter(F.col("rank") <= least).select("c_custkey", "c_mktsegment")


@query("select c_mktsegment, (select max(n) from " + _SEG + ") as n from customer group by 1")
def oversample_counts(t):
    """Sizes after drawing, with replacement, as many rows of each class as it lacks to the largest."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    drawn = neighbours.drawn(rows, neighbours.targets(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))))
    return drawn.select("label").unionByName(rows.select("label")).groupBy(F.col("label").alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"))


_SEGMENTS = "(select c_custkey as id, c_mktsegment as label from customer)"


def drawn_sql(rows: str) -> str:
    """label, draw, id: as neighbours.drawn draws, of rows (id, label)."""
    counts = f"(select label, count(*) as n from {rows} group by 1)"
    draw = f"(select c.label, r.draw, 1 + cast(floor({uniform_sql(42, 'c.label', 'r.draw')} * c.n) as bigint) as rank from {counts} c, range(1, (select max(n) + 1 from {counts})) r(draw) where r.draw <= (select max(n) from {counts}) - c.n)"
    ranked = f"(select id, label, row_number() over (partition by label order by md5('42:'||cast(id as varchar)), id) as rank from {rows})"
    return f"(select d.label, d.draw, k.id from {draw} d join {ranked} k on k.label = d.label and k.rank = d.rank)"


@query(f"select label, draw, id from {drawn_sql(_SEGMENTS)}")
def oversample_rows(t):
    """Rows of each segment drawn with replacement until it has as many as the largest."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return neighbours.drawn(rows, neighbours.targets(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))))


@query(f"select c_mktsegment as label, c_custkey as id from customer union all select label, id from {drawn_sql(_SEGMENTS)}")
def resample_random_over(t):
    """All rows and those drawn; a made row shows the row that it repeats."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.array(F.col("c_custkey")).alias("features"))
    return neighbours.resample(rows, "random_over").select("label", F.col("features")[0].cast("bigint").alias("id"))


@query("select c_mktsegment as label, c_custkey as id from (select *, row_number() over (partition by c_mktsegment order by md5('42:'||cast(c_custkey as varchar)), c_custkey) as k, (select min(n) from " + _SEG + ") as least from customer) where k <= least")
def resample_random_under(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.array(F.col("c_custkey")).alias("features"))
    return neighbours.resample(rows, "random_under").select("label", "id")


_VECTOR_ROWS = f"(select id, label from {VEC})"
_LACKS = f"(select label, (select max(n) from (select count(*) as n from {VEC} group by label)) - count(*) as needed from {VEC} group by label)"
_MADE = f"(select d.id, d.draw + coalesce((select sum(c.needed) from {_LACKS} c where c.label < d.label), 0) as draw from {drawn_sql(_VECTOR_ROWS)} d)"
_NEAR_ALL = f"(select id, nb, place from (select a.id, b.id as nb, row_number() over (partition by a.id order by d.distance, b.id) as place from (select v.* from {VEC} v where id in (select id from {_MADE})) a join {VEC} b on a.id <> b.id and a.label = b.label, lateral (select list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as distance) d) where place <= 5)"


_MADE_GAP = uniform_sql(42, "d.id", "d.draw", "'gap'")
_MADE_PLACE = f"cast(floor({uniform_sql(42, 'd.id', 'd.draw', chr(39) + 'nb' + chr(39))} * 5) as integer) + 1"


@query(f"select (select max(vec_id) from embeddings) + d.draw as id, x.label, round(x.v[1] + {_MADE_GAP} * (y.v[1] - x.v[1]), 6) as f0, round(x.v[64] + {_MADE_GAP} * (y.v[64] - x.v[64]), 6) as f63 from {_MADE} d join {_NEAR_ALL} n on n.id = d.id and n.place = {_MADE_PLACE} join {VEC} x on x.id = d.id join {VEC} y on y.id = n.nb")
def resample_smote(t):
    """Points made between each drawn row of a smaller class and one of its five nearest of the class."""
    made = neighbours.resample(vectors(t), "smote").filter("made")
    return made.select("id", "label", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[63], 6).alias("f63"))


@query()
def resample_adasyn(t):
    return neighbours.resample(vectors(t), "adasyn").select("id", "label", "made", F.round(F.col("features")[0], 6).alias("f0"))


# --- components --------------------------------------------------------------------------------------


@query("with v as (select vec_id, cast(i as integer) as i, embedding[i + 1]::double as x from embeddings, range(64) r(i)) select a.i as i, b.i as j, round(covar_samp(a.x, b.x), 6) as cov from v a join v b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2")
def pca_covariance(t):
    _, _, cov = moments(vectors(t))
    rows = [(i, j, round(float(cov[i, j]), 6)) for i in range(len(cov)) for j in range(i, len(cov))]
    return t("embeddings").sparkSession.createDataFrame(rows, "i int, j int, cov double")


@query()
def pca_explained_variance(t):
    pca, total = PCA().fit(vectors(t)), 0.0
    rows = []
    for i, (v, r) in enumerate(zip(pca.variance, pca.ratio)):
        total += float(r)
        rows.append((i, float(v), float(r), total))
    return t("embeddings").sparkSession.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")


@query()
def pca_random(t):
    """Variances of all components from a random subspace."""
    pca = PCA(64, random=True).fit(vectors(t))
    rows = [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(pca.variance, pca.ratio))]
    return t("embeddings").sparkSession.createDataFrame(rows, "component int, variance double, ratio double")


@query()
def pca_project(t):
    """Components that hold nine tenths of the variance."""
    return PCA(0.9).fit(vectors(t)).transform(vectors(t)).select("id", F.size("projected").alias("k"), F.col("projected")[0].alias("z0"))


@query()
def pca_reconstruction_mse(t):
    pca = PCA(0.9).fit(vectors(t))
    both = pca.inverse_transform(pca.transform(vectors(t)))
    error = F.aggregate(F.zip_with("features", "restored", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.agg((F.sum(error) / F.sum(F.size("features"))).alias("mse"))


@query()
def pca_importance(t):
    return t("embeddings").sparkSession.createDataFrame(PCA(10).fit(vectors(t)).importance(), "component int, place int, feature int, weight double")


# --- models ------------------------------------------------------------------------------------------


def labelled(t):
    return vectors(t).withColumnRenamed("id", "row_id").withColumn("label", F.col("label").cast("int"))


def binary(t):
    return labelled(t).withColumn("label", (F.col("label") >= 5).cast("int"))


def _model(name: str, frame=labelled, classes: int = 10, kind: str | None = None, **parameters):
    def run(t):
        """A fifth of the rows, stratified, is held out; one row of its metrics."""
        split = saved(prepare.stratified_split(frame(t), "label", "row_id"), "split")
        train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
        said = learn.predictions(kind or name, parameters, train, test, classes, 64)
        return metrics.accuracy(said).join(F.broadcast(metrics.balanced_accuracy(said)))

    query(None, f"model_{name}")(run)


_model("random_forest", trees=10, max_depth=6)
_model("logistic", C=1.0)
_model("mlp", layer1=16, max_iter=20)
_model("svm", binary, 2, C=1.0)
_model("svm_poly", binary, 2, "svm", C=1.0, kernel="poly", degree=2)
_model("gbt", binary, 2, trees=3, max_depth=3)
_model("leafwise", binary, 2, trees=5, leaves=8, l1=0.1, l2=1.0, patience=2)
_model("network", binary, 2, layer1=8, activation="tanh", max_iter=15)
_model("knn", k=5, weights="distance")


@query()
def model_search(t):
    """A search over every kind of model, in the smaller spaces: the last individuals, their fitness and values."""
    return learn.tune(binary(t), list(space.QUICK), size=3, settings={"generations": 2}, spaces=space.QUICK, folds=2)


@query()
def model_comparison(t):
    """The best linear and neighbour models that short searches find, judged by three metrics."""
    return learn.compare_kinds(binary(t), ["logistic", "knn"], size=3, settings={"generations": 1}, folds=2)


@query()
def metric_delta(t):
    """What a search by accuracy and one by macro f1 find, at the usual quick setting, and the difference."""
    return learn.compare_metrics(binary(t), "logistic")


@query()
def ga_run(t):
    """Best and mean fitness per generation of a search for genes near one half."""
    start = t("supplier").select(F.col(K).alias("ind_id"), F.array(*[u(1, i) for i in range(4)]).alias("genes"))
    fit = lambda d: d.withColumn("fitness", -F.aggregate("genes", F.lit(0.0), lambda s, x: s + (x - 0.5) * (x - 0.5)))
    _, history = evolve.run(start, fit, evolve.Settings(generations=2, mutation=0.5))
    return start.sparkSession.createDataFrame([h[:3] for h in history], "gen int, best double, mean double")


@query()
def nsga2_run(t):
    """Survivors of two opposed aims after two generations."""
    start = t("supplier").select(F.col(K).alias("ind_id"), F.array(*[u(2, i) for i in range(4)]).alias("genes"))
    aims = lambda d: d.withColumns({"obj_0": F.col("genes")[0] + F.col("genes")[1], "obj_1": -F.col("genes")[0] - F.col("genes")[2]})
    return evolve.nsga2(start, aims, 2, evolve.Settings(generations=2)).select("ind_id", "obj_0", "obj_1", "pareto_rank", "crowding")


@query(f"select ind_id from (select ind_id, row_number() over (order by crowding desc, ind_id) as k from {CROWD_SQL} where pareto_rank = 1) where k <= 3")
def crowding_select(t):
    """The three least crowded of the second front."""
    return pareto.crowding_select(ranked(t).filter("pareto_rank = 1"), 2, "ind_id", 3).select("ind_id")


# --- sources, sinks and checks -------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice, o_orderpriority as label from orders")
def src_csv_target_split(t):
    """orders through CSV files: typed read, target split, excluded columns."""
    path = f"{shared(t)}/csv-{uuid.uuid4().hex}"
    t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(path)
    return readers.read_csv(t("orders").sparkSession, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string", target="o_orderpriority", exclude=["o_orderstatus", "absent"]).frame


@query("select c_mktsegment as label, count(*) as n from customer group by 1")
def result_json_sink(t):
    path = f"{shared(t)}/json-{uuid.uuid4().hex}"
    readers.write_results(profile.class_balance(t("customer"), "c_mktsegment"), path)
    return t("customer").sparkSession.read.schema("label string, n bigint").json(path)


@query("select event_id as f_0, value as f_1, case when event_id % 8 = 7 then -1 else cast(event_id % 8 as integer) end as label from events")
def src_onehot_file(t):
    """events through text lines of two numbers and seven flags, read as classes."""
    path, spark = f"{shared(t)}/flags", t("events").sparkSession
    flags = [(F.col("event_id") % 8 == k).cast("int").cast("string") for k in range(7)]
    t("events").select(F.concat_ws(" ", F.col("event_id").cast("string"), F.col("value").cast("string"), *flags).alias("value")).write.text(path)
    return readers.read_onehot(spark, path, 2, 7).frame.withColumn("f_0", F.col("f_0").cast("bigint"))


@query("select event_id, cast(dense_rank() over (order by event_type) - 1 as integer) as type from events")
def onehot_to_class(t):
    """The type of each event, through a flag for every type and back."""
    kinds = [r[0] for r in t("events").select("event_type").distinct().orderBy("event_type").collect()]  # a row a type
    flagged = t("events").withColumns({f"f{i}": (F.col("event_type") == k).cast("int") for i, k in enumerate(kinds)})
    return flagged.select("event_id", onehot_class([f"f{i}" for i in range(len(kinds))]).alias("type"))


@query("select l_returnflag, count(*) filter (l_discount < 0 or l_discount > 0.05) as out_of_range, count(*) filter (l_linestatus not in ('O')) as bad_choice from lineitem group by 1")
def dq_checks(t):
    """Rows outside a range and outside a set of choices, by flag."""
    return t("lineitem").groupBy("l_returnflag").agg(F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.05)).alias("out_of_range"), F.count_if(~F.col("l_linestatus").isin("O")).alias("bad_choice"))


_CHECKS = ("l_quantity between 1 and 50", "l_discount > 0", "l_quantity = round(l_quantity)", "l_returnflag in ('A', 'N')")


@query(" union all ".join(f"select l_linestatus, '{n}' as \"check\", count(*) filter (not coalesce({c}, false)) as rows from lineitem group by 1" for n, c in zip(("range", "positive", "whole", "choice"), _CHECKS)))
def dq_violations(t):
    """Rows of each line status that miss an expectation."""
    expected = {"range": checks.in_range("l_quantity", 1, 50), "positive": checks.positive("l_discount"), "whole": checks.whole("l_quantity"), "choice": checks.one_of("l_returnflag", ["A", "N"])}
    return checks.violations(t("lineitem"), expected, ["l_linestatus"])


@query("select event_id, case when s < 60 then printf('%.2fs', s) when s < 3600 then printf('%dm %ds', cast(floor(s / 60) as integer), cast(floor(s % 60) as integer)) else printf('%dh %dm', cast(floor(s / 3600) as integer), cast(floor((s % 3600) / 60) as integer)) end as shown from (select event_id, value * 60 as s from events)")
def fmt_duration(t):
    s = F.col("value") * 60
    whole = lambda c: F.floor(c).cast("int")
    shown = F.when(s < 60, F.format_string("%.2fs", s)).when(s < 3600, F.format_string("%dm %ds", whole(s / 60), whole(s % 60))).otherwise(F.format_string("%dh %dm", whole(s / 3600), whole((s % 3600) / 60)))
    return t("events").select("event_id", shown.alias("shown"))
