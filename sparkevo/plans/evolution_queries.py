"""Genes, selection, crossover, mutation, adaptive rates and histories.

The population is supplier: fitness is s_acctbal, genes are four uniform numbers of the key; each supplier is
also a draw, a parent pair and a mutant, so every query's work follows the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import uniform, uniform_sql
from ..operators import select, space, vary
from .profile_queries import rounded
from .registry import query

N = 4
LO, HI = [0.0, 0.0, 0.2, 0.1], [1.0, 0.9, 1.0, 0.8]
K = "s_suppkey"


def u_sql(seed, i=None):
    return uniform_sql(seed, K) if i is None else uniform_sql(seed, K, str(i))


def u(seed, i=None):
    return uniform(seed, F.col(K)) if i is None else uniform(seed, F.col(K), F.lit(i))


def gene_sql(seed, i):
    """A gene of a parent, within its bounds."""
    return f"({LO[i]} + ({HI[i]} - {LO[i]}) * {u_sql(seed, i)})"


def genes(seed):
    return F.array(*[F.lit(LO[i]) + (F.lit(HI[i]) - F.lit(LO[i])) * u(seed, i) for i in range(N)])


def draws(seed):
    return F.array(*[u(seed, i) for i in range(N)])


LOW, HIGH = F.lit, F.lit


def bounds():
    return F.array(*map(F.lit, LO)), F.array(*map(F.lit, HI))


def spread(df, **arrays):
    """ind_id and the entries of arrays, rounded, as columns."""
    return df.select(F.col(K).alias("ind_id"), *[F.round(a[i], 6).alias(f"{n}{i}") for n, a in arrays.items() for i in range(N)])


def spread_sql(**entries):
    cols = ", ".join(f"round({e(i)}, 6) as {n}{i}" for n, e in entries.items() for i in range(N))
    return f"select {K} as ind_id, {cols} from supplier"


def population(t):
    return t("supplier").select(F.col(K).alias("ind_id"), F.col("s_acctbal").alias("fitness"))


POP = "(select s_suppkey as ind_id, s_acctbal as fitness from supplier)"
DRAWS = f"(select s_suppkey as draw_id, {u_sql('draw')} as u from supplier)"


def draw_rows(t):
    return t("supplier").select(F.col(K).alias("draw_id"), u("draw").alias("u"))


# --- codec -----------------------------------------------------------------------------------------

SPACE = {
    "a_batch": space.Gene("discrete", 1, 50),
    "b_rate": space.Gene("continuous", 0.0001, 0.1, "log10"),
    "c_drop": space.Gene("continuous", 0.0, 0.5),
    "d_kind": space.Gene("categorical", values=("LARGE BRASS", "SMALL STEEL", "other")),
}


@query("select p_partkey, round((p_size - 1) / 49.0, 6) as g0, round((log10(p_retailprice / 100000) + 4) / 3.0, 6) as g1, round(p_size / 100.0 / 0.5, 6) as g2, case p_partkey % 3 when 0 then 0.0 when 1 then 0.5 else 1.0 end as g3 from part")
def gene_encode(t):
    kind = F.element_at(F.array(F.lit("LARGE BRASS"), F.lit("SMALL STEEL"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    values = {"a_batch": F.col("p_size"), "b_rate": F.col("p_retailprice") / 100000, "c_drop": F.col("p_size") / 100.0, "d_kind": kind}
    g = t("part").withColumn("g", space.encode(SPACE, values))
    return g.select("p_partkey", *[F.round(F.col("g")[i], 6).alias(f"g{i}") for i in range(4)])


_DEC = "cast(round_even(1 + {0} * 49, 0) as bigint) as a_batch, round(pow(10, -4 + {1} * 3), 9) as b_rate, round({2} * 0.5, 6) as c_drop, ['LARGE BRASS', 'SMALL STEEL', 'other'][cast(round_even({3} * 2, 0) as integer) + 1] as d_kind"


@query(f"select {K} as ind_id, {_DEC.format(*[u_sql('dec', i) for i in range(4)])} from supplier")
def gene_decode(t):
    g = t("supplier").withColumn("g", draws("dec"))
    return rounded(rounded(g.select(F.col(K).alias("ind_id"), *[c.alias(n) for n, c in space.decode(SPACE, F.col("g")).items()]), ["b_rate"], 9), ["c_drop"])


@query(f"select count(*) as n, 0.0::double as error, cast(0 as bigint) as changed from supplier")
def gene_roundtrip(t):
    """Decoded values survive encoding and decoding: greatest error of rates, number of changed categories."""
    one = t("supplier").withColumns(space.decode(SPACE, draws("dec")))
    two = one.withColumn("g", space.encode(SPACE, {n: F.col(n) for n in SPACE}))
    back = space.decode(SPACE, F.col("g"))
    return two.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(back["b_rate"] - F.col("b_rate")) + F.abs(back["c_drop"] - F.col("c_drop"))), 9).alias("error"), F.count_if((back["d_kind"] != F.col("d_kind")) | (back["a_batch"] != F.col("a_batch"))).alias("changed"))


@query(f"select {K} as ind_id, {u_sql('v', 0)} * 1.2 <= 1 as valid from supplier")
def chromosome_validate(t):
    g = F.array(u("v", 0) * 1.2, u("v", 1), u("v", 2), u("v", 3))
    return t("supplier").select(F.col(K).alias("ind_id"), space.valid(SPACE, g).alias("valid"))


@query(spread_sql(g=lambda i: u_sql(42, i)))
def population_init(t):
    return spread(t("supplier"), g=space.random_genes(SPACE, 42, F.col(K)))


# --- selection -------------------------------------------------------------------------------------

_ROULETTE = f"(select ind_id, fitness, case when s > 0 then (fitness - lo) / s else 1 / n end as prob from {POP}, (select least(min(fitness), 0) as lo, sum(fitness) - least(min(fitness), 0) * count(*) as s, count(*) as n from {POP}))"
_RANKED = f"(select ind_id, fitness, row_number() over (order by fitness, ind_id) as rank, row_number() over (order by fitness desc, ind_id) as place, count(*) over () as n from {POP})"


@query(f"select ind_id, round(prob, 9) as prob from {_ROULETTE}")
def sel_roulette_prob(t):
    return rounded(select.roulette(population(t)).select("ind_id", "prob"), ["prob"], 9)


_SPANS = f"(select ind_id, sum(prob) over (order by ind_id) as hi, sum(prob) over (order by ind_id) - prob as lo from {_ROULETTE})"


@query(f"select draw_id, round(u, 9) as u, ind_id from {DRAWS} join {_SPANS} on u >= lo and u < hi")
def sel_roulette_pick(t):
    return rounded(select.picked(select.roulette(population(t)), draw_rows(t)), ["u"], 9)


@query(f"select cast(draw_id as integer) as draw_id, ind_id from (select i as draw_id, (start + i) / n as u from (select count(*) as n, max({u_sql('sus')}) as start from supplier), range(0, 100000000) r(i) where i < n) join {_SPANS} on u >= lo and u < hi".replace("range(0, 100000000) r(i) where i < n", "(select row_number() over () - 1 as i from supplier)"))
def sel_sus(t):
    pop = select.roulette(population(t))
    start = t("supplier").agg(F.max(u("sus")).alias("start"))
    return select.picked(pop, select.pointers(start, pop.count())).select("draw_id", "ind_id")


@query(f"select ind_id, rank, round(rank / (n * (n + 1) / 2), 9) as prob from {_RANKED}")
def sel_rank_prob(t):
    return rounded(select.by_rank(population(t)).select("ind_id", "rank", "prob"), ["prob"], 9)


@query(f"select ind_id, round(e / sum(e) over (), 9) as prob from (select ind_id, exp((fitness - max(fitness) over ()) / 1000) as e from {POP})")
def sel_boltzmann_prob(t):
    return rounded(select.boltzmann(population(t), 1000.0).select("ind_id", "prob"), ["prob"], 9)


@query(f"select ind_id, place, round((1.5 - (place - 1) / (n - 1)) / n, 9) as prob from {_RANKED}")
def sel_linear_rank_prob(t):
    return rounded(select.linear_rank(population(t)).select("ind_id", "place", "prob"), ["prob"], 9)


@query(f"select ind_id, place, round(1 / floor(n * 0.5), 9) as prob from {_RANKED} where place <= floor(n * 0.5)")
def sel_truncation_pool(t):
    return rounded(select.truncated(population(t)).select("ind_id", "place", "prob"), ["prob"], 9)


_ENTRIES = " union all ".join(f"select s_suppkey as draw_id, 1 + cast(floor({u_sql('tour', k)} * (select count(*) from supplier)) as bigint) as ind_id from supplier" for k in range(3))


@query(f"select draw_id, ind_id, fitness from (select draw_id, ind_id, fitness, row_number() over (partition by draw_id order by fitness desc, ind_id) as k from ({_ENTRIES}) join (select row_number() over (order by s_suppkey) as place, s_suppkey, s_acctbal as fitness from supplier) p on p.s_suppkey = ind_id) where k = 1")
def sel_tournament(t):
    """Three entries a tournament, drawn by key; keys that name no supplier enter nobody."""
    n = population(t).count()
    entries = t("supplier").select(F.col(K).alias("draw_id"), F.explode(F.array(*[F.lit(1) + F.floor(u("tour", k) * n) for k in range(3)])).alias("ind_id"))
    return select.tournaments(entries.join(population(t), "ind_id").distinct())


@query(f"select ind_id, count(*) as picks from {DRAWS} join {_SPANS} on u >= lo and u < hi group by 1")
def sel_frequency(t):
    return select.picked(select.roulette(population(t)), draw_rows(t)).groupBy("ind_id").agg(F.count(F.lit(1)).alias("picks"))


@query(f"select ind_id, fitness, place from {_RANKED} where place <= cast(floor(n * 0.1) as bigint)")
def elites(t):
    return select.elites(population(t)).select("ind_id", "fitness", "place")


# --- crossover -------------------------------------------------------------------------------------

A, B = (lambda i: gene_sql("pa", i)), (lambda i: gene_sql("pb", i))


def parents():
    return genes("pa"), genes("pb")


@query(spread_sql(c=lambda i: f"case when {u_sql('x', i)} < 0.5 then {B(i)} else {A(i)} end", d=lambda i: f"case when {u_sql('x', i)} < 0.5 then {A(i)} else {B(i)} end"))
def xover_uniform(t):
    c, d = vary.uniform(*parents(), draws("x"))
    return spread(t("supplier"), c=c, d=d)


_CUT = f"(1 + floor({u_sql('cut')} * 3))"


@query(spread_sql(c=lambda i: f"case when {i} < {_CUT} then {A(i)} else {B(i)} end", d=lambda i: f"case when {i} < {_CUT} then {B(i)} else {A(i)} end"))
def xover_single_point(t):
    c, d = vary.single_point(*parents(), (1 + F.floor(u("cut") * 3)).cast("int"))
    return spread(t("supplier"), c=c, d=d)


_P1, _P2 = f"(case when {u_sql('cut')} < 2.0 / 3 then 1 else 2 end)", f"(case when {u_sql('cut')} < 1.0 / 3 then 2 else 3 end)"


@query(spread_sql(c=lambda i: f"case when {i} >= {_P1} and {i} < {_P2} then {B(i)} else {A(i)} end", d=lambda i: f"case when {i} >= {_P1} and {i} < {_P2} then {A(i)} else {B(i)} end"))
def xover_two_point(t):
    cut = u("cut")
    c, d = vary.two_point(*parents(), F.when(cut < 2.0 / 3, 1).otherwise(2), F.when(cut < 1.0 / 3, 2).otherwise(3))
    return spread(t("supplier"), c=c, d=d)


@query(spread_sql(c=lambda i: f"{A(i)} * 0.3 + {B(i)} * 0.7", d=lambda i: f"{B(i)} * 0.3 + {A(i)} * 0.7"))
def xover_arithmetic(t):
    c, d = vary.arithmetic(*parents(), 0.3)
    return spread(t("supplier"), c=c, d=d)


def _sbx_sql(sign, own):
    def gene(i):
        r = u_sql("sbx", i)
        s = f"case when {r} <= 0.5 then pow(2 * {r}, 1.0 / 21) else pow(1 / (2 * (1 - {r})), 1.0 / 21) end"
        return f"case when abs({A(i)} - {B(i)}) <= 1e-10 then {own(i)} else greatest({LO[i]}, least({HI[i]}, 0.5 * ({A(i)} + {B(i)} {sign} ({s}) * abs({A(i)} - {B(i)})))) end"

    return gene


@query(spread_sql(c=_sbx_sql("-", A), d=_sbx_sql("+", B)))
def xover_sbx(t):
    c, d = vary.sbx(*parents(), draws("sbx"), *bounds())
    return spread(t("supplier"), c=c, d=d)


def _blend_sql(seed):
    return lambda i: f"greatest({LO[i]}, least({HI[i]}, least({A(i)}, {B(i)}) - 0.5 * abs({A(i)} - {B(i)}) + {u_sql(seed, i)} * 2 * abs({A(i)} - {B(i)})))"


@query(spread_sql(c=_blend_sql("bu"), d=_blend_sql("bv")))
def xover_blend(t):
    c, d = vary.blend(*parents(), draws("bu"), draws("bv"), *bounds())
    return spread(t("supplier"), c=c, d=d)


# --- mutation --------------------------------------------------------------------------------------

_AT = f"floor({u_sql('at')} * {N})"


def at():
    return F.floor(u("at") * N).cast("int")


def one_gene_sql(change):
    return spread_sql(g=lambda i: f"case when {i} = {_AT} then greatest({LO[i]}, least({HI[i]}, {change(A(i), LO[i], HI[i])})) else {A(i)} end")


@query(one_gene_sql(lambda x, lo, hi: f"{lo} + {u_sql('m')} * ({hi} - {lo})"))
def mut_uniform(t):
    return spread(t("supplier"), g=vary.reset(genes("pa"), at(), *bounds(), u("m")))


_NORMAL = f"sqrt(-2 * ln(1 - {u_sql('m')})) * cos(2 * 3.141592653589793 * {u_sql('m2')})"
_PROGRESS = f"({K} % 100) / 100.0"


@query(one_gene_sql(lambda x, lo, hi: f"{x} + {_NORMAL} * 0.1 * ({hi} - {lo})"))
def mut_gaussian(t):
    return spread(t("supplier"), g=vary.gaussian(genes("pa"), at(), *bounds(), u("m"), u("m2")))


@query(one_gene_sql(lambda x, lo, hi: f"{x} + {_NORMAL} * 0.1 * (1 - {_PROGRESS}) * ({hi} - {lo})"))
def mut_adaptive(t):
    return spread(t("supplier"), g=vary.gaussian(genes("pa"), at(), *bounds(), u("m"), u("m2"), progress=F.col(K) % 100 / 100.0))


@query(one_gene_sql(lambda x, lo, hi: f"{x} + (case when {u_sql('m')} < 0.5 then pow(2 * {u_sql('m')}, 1.0 / 21) - 1 else 1 - pow(2 * (1 - {u_sql('m')}), 1.0 / 21) end) * ({hi} - {lo})"))
def mut_polynomial(t):
    return spread(t("supplier"), g=vary.polynomial(genes("pa"), at(), *bounds(), u("m")))


@query(one_gene_sql(lambda x, lo, hi: f"case when {u_sql('m')} < 0.5 then {lo} else {hi} end"))
def mut_boundary(t):
    return spread(t("supplier"), g=vary.boundary(genes("pa"), at(), *bounds(), u("m")))


@query(one_gene_sql(lambda x, lo, hi: f"{x} + (case when {u_sql('m')} < 0.5 then 1 else -1 end) * (1 - pow({u_sql('m2')}, pow(1 - {_PROGRESS}, 3))) * ({hi} - {lo})"))
def mut_non_uniform(t):
    return spread(t("supplier"), g=vary.non_uniform(genes("pa"), at(), *bounds(), u("m"), u("m2"), F.col(K) % 100 / 100.0))


@query(spread_sql(g=lambda i: f"case when {u_sql('gate', i)} < 0.3 then {LO[i]} + {u_sql('m', i)} * ({HI[i]} - {LO[i]}) else {A(i)} end"))
def mut_nsga(t):
    return spread(t("supplier"), g=vary.every_gene(genes("pa"), *bounds(), draws("gate"), draws("m")))


# --- histories: a generation is a day of events ------------------------------------------------------

HISTORY = "(select cast(strftime(ts, '%Y%m%d') as integer) as gen, max(value) as best, avg(value) as mean, stddev_pop(value) as std, case when avg(value) = 0 then 0 else stddev_pop(value) / (abs(avg(value)) + 1e-10) end as diversity from events group by 1)"


def generation_table(rows, gen, fitness):
    """gen, best, mean, std, diversity (std / |mean|) of every generation."""
    m, s = F.avg(fitness), F.stddev_pop(fitness)
    return rows.groupBy(gen.alias("gen")).agg(F.max(fitness).alias("best"), m.alias("mean"), s.alias("std"), F.when(m == 0, 0.0).otherwise(s / (F.abs(m) + 1e-10)).alias("diversity"))


def history(t):
    return generation_table(t("events"), F.date_format("ts", "yyyyMMdd").cast("int"), F.col("value"))


@query(f"select gen, round(best, 6) as best, round(mean, 6) as mean, round(std, 6) as std, round(diversity, 6) as diversity from {HISTORY}")
def generation_stats(t):
    return rounded(history(t), ["best", "mean", "std", "diversity"])


_BEST = f"(select gen, best, max(best) over (order by gen) as so_far, coalesce(best > max(best) over (order by gen rows between unbounded preceding and 1 preceding), true) as improved from {HISTORY})"


def with_best(h):
    """A window over generations, of which there are few (one row each)."""
    w = Window.orderBy("gen")
    before = F.max("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return h.select("gen", "best", "diversity", F.max("best").over(w).alias("so_far"), F.coalesce(F.col("best") > before, F.lit(True)).alias("improved"))


@query(f"select gen, round(best, 6) as best, round(so_far, 6) as so_far, improved from {_BEST}")
def best_so_far(t):
    return rounded(with_best(history(t)).drop("diversity"), ["best", "so_far"])


@query(f"select gen, cast(row_number() over (partition by run order by gen) - 1 as integer) as stale, row_number() over (partition by run order by gen) - 1 >= 10 as stop from (select gen, sum(cast(improved as integer)) over (order by gen) as run from {_BEST})")
def stagnation_run(t):
    """Generations since the last improvement, and whether patience (10) has run out."""
    runs = with_best(history(t)).withColumn("run", F.sum(F.col("improved").cast("int")).over(Window.orderBy("gen")))
    stale = (F.row_number().over(Window.partitionBy("run").orderBy("gen")) - 1).cast("int")
    return runs.select("gen", stale.alias("stale"), (stale >= 10).alias("stop"))


@query(f"select gen, round(m, 6) as mutation, round(0.95 - (m - 0.01) / 0.49 * 0.45, 6) as crossover from (select gen, case when d < 0.05 then 0.5 when d > 0.3 then 0.01 else 0.5 - (d - 0.05) / 0.25 * 0.49 end as m from (select gen, diversity / 3 as d from {HISTORY}))")
def adapt_diversity(t):
    m, c = vary.diversity_rates(F.col("diversity") / 3)
    return rounded(history(t).select("gen", m.alias("mutation"), c.alias("crossover")), ["mutation", "crossover"])


@query(f"select gen, round(0.5 - p * 0.49, 6) as mutation, round(0.5 + p * 0.45, 6) as crossover from (select gen, (gen % 100) / 31.0 as p from {HISTORY})")
def adapt_schedule(t):
    m, c = vary.scheduled_rates(F.col("gen") % 100, 31)
    return rounded(history(t).select("gen", m.alias("mutation"), c.alias("crossover")), ["mutation", "crossover"])


@query(f"select gen, coalesce(best - lag(best, 4) over (order by gen) < 0.001, false) as stagnant from {HISTORY}")
def adapt_fitness_flag(t):
    lagged = F.lag("best", 4).over(Window.orderBy("gen"))
    return history(t).select("gen", F.coalesce(F.col("best") - lagged < 0.001, F.lit(False)).alias("stagnant"))


@query(f"with recursive h as (select row_number() over (order by gen) as k, gen, coalesce(best - lag(best, 4) over (order by gen) < 0.001, false) as s, row_number() over (order by gen) >= 5 as old from {HISTORY}), r as (select k, gen, 0.1::double as mutation from h where k = 1 union all select h.k, h.gen, case when not old then mutation when s then least(0.5, mutation * 1.2) else greatest(0.01, mutation * 0.9) end from r join h on h.k = r.k + 1) select gen, round(mutation, 6) as mutation from r")
def adapt_fitness(t):
    """The rate grows by a fifth while the best stagnates over five generations, and shrinks by a tenth otherwise."""
    w = Window.orderBy("gen")
    steps = history(t).select("gen", (F.col("best") - F.lag("best", 4).over(w)).alias("gain"))
    # A fold over generations, one entry each: the recurrence is sequential by nature and a history is short.
    row = steps.agg(F.array_sort(F.collect_list(F.struct("gen", "gain"))).alias("all"))
    start = F.struct(F.lit(0.1).alias("rate"), F.array().cast("array<struct<gen:int,mutation:double>>").alias("got"))

    def step(acc, s):
        rate = F.when(s["gain"].isNull(), acc["rate"]).when(s["gain"] < 0.001, F.least(F.lit(0.5), acc["rate"] * 1.2)).otherwise(F.greatest(F.lit(0.01), acc["rate"] * 0.9))
        return F.struct(rate.alias("rate"), F.concat(acc["got"], F.array(F.struct(s["gen"].alias("gen"), rate.alias("mutation")))).alias("got"))

    return rounded(row.select(F.explode(F.aggregate("all", start, step, lambda a: a["got"])).alias("r")).select("r.*"), ["mutation"])


@query("select e.user_id, count(*) as n from events e where not exists (select 1 from events m where m.user_id = e.user_id and m.event_id % 3 = 0 and m.event_type = e.event_type) group by 1")
def fitness_memo_antijoin(t):
    """Individuals (user, type) that the memo, the events with an id divisible by 3, doesn't know."""
    e = t("events")
    memo = e.filter("event_id % 3 = 0").select("user_id", "event_type")
    return e.join(memo, ["user_id", "event_type"], "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
