"""Selection of individuals: probabilities as columns, picks from given draws.

A population has ind_id (a whole number) and fitness. Probabilities need totals and ranks only; picks match
draws in [0, 1) with cumulative probabilities in one merged order, cut into cells, so neither side is paired with all of
the other, and an individual that takes nearly all draws is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import celled, few, latest, ordinals
from ..functions.shared import free


def roulette(pop: DataFrame) -> DataFrame:
    """prob in proportion to fitness, shifted by the least where that is negative; equal where all are zero."""
    w = pop.agg(F.least(F.min("fitness"), F.lit(0.0)).alias("_lo"), F.sum("fitness").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    total = F.col("_sum") - F.col("_lo") * F.col("_n")
    p = F.when(total > 0, (F.col("fitness") - F.col("_lo")) / total).otherwise(1 / F.col("_n"))
    return pop.join(F.broadcast(w)).withColumn("prob", p).drop("_lo", "_sum", "_n")


def by_rank(pop: DataFrame) -> DataFrame:
    """prob = rank / (1 + ... + n), ranks from the worst."""
    n = pop.count()
    return ordinals(pop, "fitness", "ind_id", name="rank").withColumn("prob", F.col("rank") / F.lit(n * (n + 1) / 2))


def boltzmann(pop: DataFrame, temperature: float = 1.0) -> DataFrame:
    """prob in proportion to exp(fitness / temperature); the greatest is taken off first, so nothing overflows."""
    hi = pop.agg(F.max("fitness").alias("_hi"))
    e = pop.join(F.broadcast(hi)).withColumn("_e", F.exp((F.col("fitness") - F.col("_hi")) / F.lit(temperature)))
    return e.join(F.broadcast(e.agg(F.sum("_e").alias("_all")))).withColumn("prob", F.col("_e") / F.col("_all")).drop("_hi", "_e", "_all")


def linear_rank(pop: DataFrame, pressure: float = 1.5, best_first: bool = True) -> DataFrame:
    """prob = (s - (2s - 2)(place - 1)/(n - 1)) / n; place 1 is the best, or the worst with best_first false."""
    n = pop.count()
    placed = ordinals(pop, "fitness", "ind_id", descending=best_first, name="place")
    slope = (2 * pressure - 2) / max(1, n - 1)
    p = (F.lit(pressure) - F.lit(slope) * (F.col("place") - 1)) / F.lit(n)
    return placed.withColumn("prob", p if n > 1 else F.lit(1.0))


def truncated(pop: DataFrame, share: float = 0.5) -> DataFrame:
    """The best max(1, int(n * share)) individuals, equally likely."""
    k = max(1, int(pop.count() * share))
    return ordinals(pop, "fitness", "ind_id", descending=True, name="place").filter(F.col("place") <= k).withColumn("prob", F.lit(1.0 / k))


def cumulative(pop: DataFrame) -> DataFrame:
    """pop (with prob) with lo and hi, its share of the unit interval in the order of ind_id; the first lo is 0."""
    cell, total, own = (free(pop, c) for c in ("_cell_of", "_total", "_own"))
    if few(pop):
        placed = pop.withColumn("lo", F.coalesce(F.sum("prob").over(Window.orderBy("ind_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        return placed.withColumn("hi", F.col("lo") + F.col("prob"))
    cells = celled(pop, "ind_id", cell)
    sums = cells.groupBy(cell).agg(F.sum("prob").alias(total))
    sums = sums.select(cell, F.coalesce(F.sum(total).over(Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(total))
    inner = Window.partitionBy(cell).orderBy("ind_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn(own, F.coalesce(F.sum("prob").over(inner), F.lit(0.0))).join(sums, cell).withColumn("lo", F.col(total) + F.col(own))
    return placed.withColumn("hi", F.col("lo") + F.col("prob")).drop(cell, own, total)


def picked(pop: DataFrame, draws: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """draw_id, u, ind_id: the individual whose share of the unit interval holds the draw u.

    The last share is open above, so rounding of the sums loses no draw. Draws are merged with the shares' lower ends.
    """
    spans = cumulative(pop.filter(F.col("prob") > 0)).select("ind_id", "lo", *keep)
    return latest(draws, "u", spans, "lo", ["ind_id", *keep]).select("draw_id", "u", "ind_id", *keep)


def pointers(start: DataFrame, n: int) -> DataFrame:
    """draw_id 0..n-1 and u = (start + draw_id) / n: the equally spaced pointers of one draw (column start)."""
    draws = start.sparkSession.range(n).select(F.col("id").cast("int").alias("draw_id") if n < 1 << 31 else F.col("id").alias("draw_id"))
    return draws.join(F.broadcast(start.select("start"))).select("draw_id", ((F.col("start") + F.col("draw_id")) / F.lit(n)).alias("u"))


def tournaments(entries: DataFrame) -> DataFrame:
    """draw_id, ind_id and fitness of the best entry (draw_id, ind_id, fitness) of each tournament; ties to the least id."""
    best = entries.groupBy("draw_id").agg(F.min(F.struct(-F.col("fitness"), "ind_id")).alias("b"))
    return best.select("draw_id", F.col("b.ind_id").alias("ind_id"), (-F.col("b.col1")).alias("fitness"))


def elites(pop: DataFrame, rate: float = 0.1) -> DataFrame:
    """The best int(rate * n) individuals."""
    k = int(pop.count() * rate)
    return ordinals(pop, "fitness", "ind_id", descending=True, name="place").filter(F.col("place") <= k)
