"""Diversity of populations of gene arrays, and niching.

The mean distance of all pairs needs no pairs: per gene it follows from ranks, as the sum of (2 rank - n - 1) x
over sorted values. Sharing compares a stated query set with all rows, in blocks.

Speciation and clearing are greedy: in a given order, whoever is near no leader before becomes one. That is the first
maximal independent set of the order, and it is found in rounds: each cell of a grid looks at its own earliest individuals
and those of the cells around, ``EARLIEST`` of each, and settles whom no unsettled one before can change; all near a new
leader are settled too. The grid cuts signed sums of genes, which differ by less than the distance times the genes, so
what is near is in the same cell or the next. Equal genes count once. Up to ``FEW`` individuals one task does the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import few, ordinals, running
from ..functions.shared import saved


def distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of the genes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def genotypic(pop: DataFrame) -> DataFrame:
    """diversity: the mean distance over all pairs; 0 for fewer than two individuals."""
    genes = pop.select(F.size("genes").alias("_g"), F.posexplode("genes").alias("gene", "x"))
    steps = running(genes, "x", {"n": F.count(F.lit(1))}, ["gene"])
    count, width = pop.count(), pop.select(F.max(F.size("genes"))).first()[0] or 1
    if count < 2:
        return pop.sparkSession.createDataFrame([(0.0,)], "diversity double")
    # A run of n equal values at ranks before+1 .. before+n has the rank sum n * before + n (n + 1) / 2.
    ranks = F.col("n") * F.col("n_before") + F.col("n") * (F.col("n") + 1) / 2
    total = F.sum(F.col("x") * (2 * ranks - F.col("n") * F.lit(count + 1)))
    return steps.agg((total / F.lit(width * count * (count - 1) / 2)).alias("diversity"))


def phenotypic(pop: DataFrame) -> DataFrame:
    return pop.agg(F.coalesce(F.stddev_pop("fitness"), F.lit(0.0)).alias("diversity"))


#: Bytes of the genes of a block of queries.
BLOCK = 16 << 20


def shared_fitness(pop: DataFrame, is_query: Column, sigma: float = 0.1, alpha: float = 1.0) -> DataFrame:
    """ind_id, niche (sum of 1 - (d / sigma)^alpha over rows nearer than sigma, itself included), shared."""
    spark, queries = pop.sparkSession, pop.filter(is_query)
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("genes"))).first()
    blocks, found = -(-n * 8 * max(1, width or 1) // BLOCK), []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("ind_id"), F.lit(blocks)) == b).select("ind_id", "genes").toPandas()
        if not len(own):
            continue
        held = spark.sparkContext.broadcast((own["ind_id"].to_numpy(), np.stack(own["genes"].to_numpy())))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, genes = held.value
            total = np.zeros(len(ids))
            step = max(1, (1 << 21) // genes.shape[1])  # pairs compared at a time
            for rows in batches:
                other = np.stack(rows["genes"].to_numpy())
                for a in range(0, len(ids), 1024):
                    mine = genes[a : a + 1024]
                    for c in range(0, len(other), max(1, step // len(mine))):
                        d = np.abs(mine[:, None, :] - other[None, c : c + max(1, step // len(mine))]).mean(2)
                        total[a : a + 1024] += np.where(d < sigma, 1 - (d / sigma) ** alpha, 0).sum(1)
            yield pd.DataFrame({"ind_id": ids, "niche": total})

        part = pop.select("genes").mapInPandas(run, "ind_id bigint, niche double")
        sums = part.groupBy("ind_id").agg(F.sum("niche").alias("niche"))
        found.append(saved(sums, "niches") if blocks > 1 else sums)
        if blocks > 1:
            held.destroy()
    if not found:
        return spark.createDataFrame([], "ind_id bigint, niche double, shared double")
    sums = reduce(DataFrame.unionByName, found)
    return sums.join(queries.select("ind_id", "fitness"), "ind_id").select("ind_id", "niche", (F.col("fitness") / F.col("niche")).alias("shared"))


#: Individuals of a cell that a round looks at, and signed sums that the grid cuts.
EARLIEST, SUMS = 512, 3


def _near(mine: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether mine is nearer than threshold to each of others, genes added in their order."""
    total = np.zeros(len(others))
    for g in range(others.shape[1]):
        total += np.abs(others[:, g] - mine[g])
    return total / others.shape[1] < threshold


def _greedy(places: np.ndarray, genes: np.ndarray, own: np.ndarray, horizon: float, threshold: float) -> np.ndarray:
    """1 leader, 2 near one, 0 unsettled, of rows by rising place; others' rows stay unsettled, and own ones after the horizon."""
    out = np.zeros(len(places), np.int64)
    near = np.zeros(len(places), bool)  # near a leader before
    for i in np.flatnonzero(own):
        if near[i]:
            out[i] = 2
            continue
        if places[i] > horizon or _near(genes[i], genes[:i][out[:i] == 0], threshold).any():
            continue
        out[i] = 1
        near[i + 1 :] |= _near(genes[i], genes[i + 1 :], threshold)
    return out


def _all_at_once(threshold: float):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        genes, places = np.stack(t["genes"].to_numpy()), t["place"].to_numpy()
        leader = np.full(len(t), -1, np.int64)
        for i in range(len(t)):
            if leader[i] < 0:
                mine = np.flatnonzero(leader[i:] < 0) + i
                mine = mine[_near(genes[i], genes[mine], threshold)]
                leader[mine] = leader[i] = i
        return pd.DataFrame({"place": places, "leader": places[leader]})

    return run


def _cells(genes: str, width: int, threshold: float) -> list[Column]:
    """Cells of signed sums: all plus, alternating ones, alternating pairs, and so on."""
    size = threshold * width * (1 + 1e-9)
    signed = lambda k: F.aggregate(F.transform(genes, lambda x, i: x * F.when(F.pmod(F.floor(i / F.lit(1 << k >> 1)), F.lit(2)) == 1, -1.0).otherwise(1.0)) if k else F.col(genes), F.lit(0.0), lambda s, x: s + x)
    return [F.floor(signed(k) / F.lit(size)) for k in range(max(1, min(SUMS, width)))]


def _around(cell: Column, dims: int) -> Column:
    """The cell and those beside it."""
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * dims, indexing="ij"), -1).reshape(-1, dims)
    return F.array(*[F.array(*[F.get(cell, F.lit(d)) + F.lit(int(x)) for d, x in enumerate(step)]) for step in steps])


def _leaders(rows: DataFrame, dims: int, threshold: float) -> DataFrame:
    """place, genes and cell of the leaders of rows (place, genes, cell), in rounds."""

    def settle(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        own = t["own"].to_numpy()
        out = _greedy(t["place"].to_numpy(), np.stack(t["genes"].to_numpy()), own, t["horizon"].min(), threshold) if own.any() else np.zeros(len(t), np.int64)
        return pd.DataFrame({"place": t["place"].to_numpy()[out == 1]})

    left, found = rows, None
    while not left.isEmpty():
        by = Window.partitionBy("cell").orderBy("place")
        early = left.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= EARLIEST)
        ends = early.filter(F.col("n") == EARLIEST).select("cell", F.col("place").cast("double").alias("last"))  # later ones of the cell are not looked at
        early = early.join(ends, "cell", "left").withColumn("horizon", F.coalesce("last", F.lit(float("inf"))))
        shown = early.select("place", "genes", "cell", "horizon", F.explode(_around(F.col("cell"), dims)).alias("to")).withColumn("own", F.col("to") == F.col("cell"))
        new = saved(shown.groupBy("to").applyInPandas(settle, "place bigint").join(left, "place"), "leaders")
        found = new if found is None else found.unionByName(new)
        reach = new.select(F.col("genes").alias("of"), F.explode(_around(F.col("cell"), dims)).alias("cell"))
        settled = left.join(reach, "cell").filter(distance(F.col("genes"), F.col("of")) < threshold).select("place").distinct()
        left = saved(left.join(settled, "place", "left_anti").join(new.select("place"), "place", "left_anti"), "left")
    return found


def species(pop: DataFrame, threshold: float, order: str = "ind_id", descending: bool = False) -> DataFrame:
    """pop (ind_id, genes and the column of the order) with leader, the ind_id of the first leader nearer than threshold.

    Leaders are taken in the order given, ties by ind_id; they are their own leader. Rows with equal genes belong together.
    """
    if threshold <= 0:
        return pop.withColumn("leader", F.col("ind_id"))
    ranked = saved(ordinals(pop.select("ind_id", "genes", F.col(order).alias("_by")) if order != "ind_id" else pop.select("ind_id", "genes", F.lit(0).alias("_by")), "_by", "ind_id", descending=descending, name="place"), "ranked")
    distinct = saved(ranked.groupBy("genes").agg(F.min("place").alias("place")), "distinct")
    if few(distinct):
        led = distinct.groupBy().applyInPandas(_all_at_once(threshold), "place bigint, leader bigint")
    else:
        width = distinct.agg(F.max(F.size("genes"))).first()[0]
        cells = _cells("genes", width, threshold)
        rows = saved(distinct.select("place", "genes", F.array(*cells).alias("cell")), "rows")
        reach = _leaders(rows, len(cells), threshold).select(F.col("place").alias("leader"), F.col("genes").alias("of"), F.explode(_around(F.col("cell"), len(cells))).alias("cell"))
        near = rows.join(reach, "cell").filter((F.col("place") == F.col("leader")) | (distance(F.col("genes"), F.col("of")) < threshold))
        led = near.groupBy("place").agg(F.min("leader").alias("leader"))
    by_genes = distinct.join(led, "place").select("genes", F.col("leader").alias("_place"))
    names = ranked.select(F.col("place").alias("_place"), F.col("ind_id").alias("leader"))
    return pop.join(by_genes.join(names, "_place").select("genes", "leader"), "genes").select(*pop.columns, "leader")


def speciation(pop: DataFrame, threshold: float = 0.15) -> DataFrame:
    """ind_id, leader, size of its species and shared, the fitness over the size; species form in the order of ind_id."""
    led = saved(species(pop, threshold), "species")
    sizes = led.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    return led.join(sizes, "leader").select("ind_id", "leader", "size", (F.col("fitness") / F.col("size")).alias("shared"))


def clearing(pop: DataFrame, sigma: float = 0.1) -> DataFrame:
    """ind_id, leader (the winner of its niche, best first) and cleared: the fitness of winners, 0 for others."""
    led = species(pop, sigma, "fitness", descending=True)
    return led.select("ind_id", "leader", F.when(F.col("ind_id") == F.col("leader"), F.col("fitness")).otherwise(0.0).alias("cleared"))
