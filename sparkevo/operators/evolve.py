"""Evolution of a population DataFrame: select, cross, mutate and survive, one generation at a time.

fitness is a function from a population (ind_id, genes) to the same with fitness (or obj_0..) added, so it may
be any Spark job. Each generation is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.order import MEET, ordinals
from ..functions.shared import saved
from . import niche, pareto, select, vary


@dataclass
class Settings:
    """Sizes and rates of a run (defaults: fixed values users know).

    adapt: none (fixed rates), diversity, schedule, or self: the last two genes of each individual are its own mutation
    and crossover rates. per_gene: every gene mutates with the mutation rate, not one gene of the individual. floor: a run also stops at a diversity under it after two generations without progress.
    """

    genes: int = 4
    crossover: float = 0.8
    mutation: float = 0.1
    elite: float = 0.1
    generations: int = 10
    patience: int = 10
    floor: float = 0.0
    adapt: str = "none"
    per_gene: bool = False
    seed: int = 42


#: Ranges of adaptive mutation and crossover rates (fixed values).
MUTATION, CROSSOVER = (0.01, 0.5), (0.5, 0.95)


class Generation(NamedTuple):
    gen: int
    best: float
    mean: float
    diversity: float | None  # only where the settings use it
    mutation: float
    crossover: float
    evaluations: int


def rates(pop: DataFrame, gen: int, s: Settings) -> tuple[float | None, float, float]:
    """Diversity of the population (None where nothing uses it), and the mutation and crossover rates of a generation (of self, their means)."""
    diversity = (niche.genotypic(pop).first()[0] or 0.0) if s.adapt == "diversity" or s.floor > 0 else None
    if s.adapt == "none":
        return diversity, s.mutation, s.crossover
    if s.adapt == "self":
        own = pop.agg(*[F.avg(r) for r in own_rates(F.col("genes"))]).first()
        return diversity, own[0], own[1]
    if s.adapt not in ("diversity", "schedule"):
        raise ValueError(f"unknown adaptation {s.adapt!r}")
    pair = vary.diversity_rates(F.lit(diversity)) if s.adapt == "diversity" else vary.scheduled_rates(F.lit(gen), s.generations)
    return diversity, *pop.sparkSession.range(1).select(*[c.cast("double") for c in pair]).first()


def own_rates(genes: Column) -> tuple[Column, Column]:
    """Mutation and crossover rate in the last two genes."""
    return tuple(F.element_at(genes, i) * (hi - lo) + lo for i, (lo, hi) in ((-2, MUTATION), (-1, CROSSOVER)))


def initial(spark, size: int, s: Settings) -> DataFrame:
    """ind_id 0.. and genes drawn evenly; two more for rates of their own."""
    n = s.genes + (2 if s.adapt == "self" else 0)
    return spark.range(size).select(F.col("id").alias("ind_id"), F.array(*[_draw(s, -1, F.col("id"), "gene", i) for i in range(n)]).alias("genes"))


def _draw(s: Settings, gen: int, *what) -> Column:
    return uniform(s.seed, F.lit(gen), *[F.lit(w) if isinstance(w, (str, int)) else w for w in what])


def children(parents: DataFrame, ids: DataFrame, gen: int, s: Settings, mutation: float | None = None, crossover: float | None = None) -> DataFrame:
    """ind_id, genes: a child for every row of ids, of two parents picked by prob; uniform crossover, one mutated gene."""
    u = lambda *w: _draw(s, gen, F.col("draw_id"), *w)
    draws = ids.select(F.col("ind_id").alias("draw_id"))
    side = lambda k: select.picked(parents, draws.withColumn("u", u("parent", k)), ["genes"]).select("draw_id", F.col("genes").alias(f"g{k}"))
    pairs = side(0).join(side(1), "draw_id")
    width = s.genes + (2 if s.adapt == "self" else 0)
    low, high = F.array_repeat(F.lit(0.0), width), F.array_repeat(F.lit(1.0), width)
    gates = F.array(*[u("swap", i) for i in range(width)])
    mutate, cross = (F.lit(s.mutation if mutation is None else mutation), F.lit(s.crossover if crossover is None else crossover)) if s.adapt != "self" else own_rates(F.col("g0"))
    crossed = F.when(u("cross") < cross, vary.uniform(F.col("g0"), F.col("g1"), gates)[0]).otherwise(F.col("g0"))
    pairs = pairs.withColumn("genes", crossed)
    if s.per_gene:
        drawn = lambda what: F.array(*[u(what, i) for i in range(width)])
        changed = F.zip_with(F.zip_with("genes", drawn("m1"), lambda x, a: F.struct(x.alias("x"), a.alias("a"))), drawn("m2"), lambda p, b: vary.clip(p["x"] + vary.normal(p["a"], b) * 0.1, F.lit(0.0), F.lit(1.0)))
        mutated = F.zip_with(F.arrays_zip(F.col("genes").alias("x"), changed.alias("y")), drawn("gate"), lambda p, g: F.when(g < mutate, p["y"]).otherwise(p["x"]))
        return pairs.select(F.col("draw_id").alias("ind_id"), mutated.alias("genes"))
    mutated = vary.gaussian(F.col("genes"), F.floor(u("at") * F.lit(width)).cast("int"), low, high, u("m1"), u("m2"))
    return pairs.select(F.col("draw_id").alias("ind_id"), F.when(u("mutate") < mutate, mutated).otherwise(F.col("genes")).alias("genes"))


def run(start: DataFrame, fitness: Callable[[DataFrame], DataFrame], s: Settings) -> tuple[DataFrame, list[Generation]]:
    """The last population and a Generation of each; the best individuals stay, so best never falls.

    Only newborn individuals are evaluated; the elites keep their fitness.
    """
    pop, history, stale = saved(fitness(start), "population"), [], 0
    evaluations = pop.count()
    for gen in range(s.generations):
        best, mean = pop.agg(F.max("fitness"), F.avg("fitness")).first()
        diversity, mutation, crossover = rates(pop, gen, s)
        stale = 0 if not history or best > history[-1].best else stale + 1
        history.append(Generation(gen, best, mean, diversity, mutation, crossover, evaluations))
        if gen + 1 == s.generations or stale >= s.patience or (s.floor > 0 and diversity < s.floor and stale >= 2):
            break
        keep = select.elites(pop, s.elite).select("ind_id", "genes", "fitness")
        born = children(select.by_rank(pop), pop.join(keep.select("ind_id"), "ind_id", "left_anti"), gen, s, mutation, crossover)
        fresh = saved(fitness(born).select("ind_id", "genes", "fitness"), "born")
        evaluations += fresh.count()
        pop = saved(keep.unionByName(fresh), "population")
    return pop, history


def summary(history: list[Generation]) -> dict:
    """best, the generation that found it, generations run and evaluations made."""
    best = max(h.best for h in history)
    return {"best": best, "found": next(h.gen for h in history if h.best == best), "generations": len(history), "evaluations": history[-1].evaluations}


def offspring(pop: DataFrame, ids: DataFrame, gen: int, s: Settings) -> DataFrame:
    """ind_id, genes: children by binary tournaments on pareto_rank, then crowding."""
    n, place = pop.count(), "_place"
    numbered = saved(ordinals(pop.withColumn("_one", F.lit(0)), "_one", "ind_id", name=place).select(place, "ind_id", "pareto_rank", "crowding"), "numbered")
    u = lambda *w: _draw(s, gen, F.col("draw_id"), *w)
    draws = ids.select(F.col("ind_id").alias("draw_id"))

    def side(k: int) -> DataFrame:
        entries = draws.select("draw_id", F.explode(F.array(*[F.floor(u("entry", k, e) * n) + 1 for e in (0, 1)])).alias(place))
        won = pareto.best_of(entries.join(numbered.hint(MEET), place), "draw_id", "ind_id")
        return won.join(pop.select("ind_id", "genes").hint(MEET), "ind_id").select("draw_id", F.col("genes").alias(f"g{k}"))

    pairs = side(0).join(side(1).hint(MEET), "draw_id")
    low, high = F.array_repeat(F.lit(0.0), s.genes), F.array_repeat(F.lit(1.0), s.genes)
    gates = F.array(*[u("swap", i) for i in range(s.genes)])
    pairs = pairs.withColumn("genes", F.when(u("cross") < s.crossover, vary.uniform(F.col("g0"), F.col("g1"), gates)[0]).otherwise(F.col("g0")))
    mutated = vary.gaussian(F.col("genes"), F.floor(u("at") * s.genes).cast("int"), low, high, u("m1"), u("m2"))
    return pairs.select(F.col("draw_id").alias("ind_id"), F.when(u("mutate") < s.mutation, mutated).otherwise(F.col("genes")).alias("genes"))


def nsga2(start: DataFrame, objectives: Callable[[DataFrame], DataFrame], n: int, s: Settings) -> DataFrame:
    """The survivors with objectives, pareto_rank and crowding after all generations."""
    size = start.count()
    offset = (start.agg(F.max("ind_id")).first()[0] or 0) + 1

    def survive(df: DataFrame) -> DataFrame:
        # Fronts are found only as far as they hold the survivors.
        return saved(pareto.survivors(pareto.crowding(pareto.ranks(df, n, rows=size), n, "ind_id"), size, "ind_id"), "survivors")

    pop = survive(objectives(start))
    for gen in range(s.generations):
        born = offspring(pop, start, gen, s).withColumn("ind_id", F.col("ind_id") + F.lit(offset * (gen + 1)))
        born = saved(objectives(born), "born")
        pop = survive(pop.drop("pareto_rank", "crowding").unionByName(born))
    return pop
