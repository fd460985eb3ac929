"""Paired comparisons of scores: t test, Wilcoxon signed ranks, Cohen's d.

Statistics are aggregates over pairs joined by fold; p-values follow from a few numbers by the regularised
incomplete beta function, or by the exact or normal distribution of the rank sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import running


def paired(scores: DataFrame, baseline: str) -> DataFrame:
    """model, fold, score, base: every model's score beside the baseline's at the same fold."""
    base = scores.filter(F.col("model") == baseline).select("fold", F.col("score").alias("base"))
    return scores.filter(F.col("model") != baseline).join(base, "fold").select("model", "fold", "score", "base")


def paired_t(pairs: DataFrame) -> DataFrame:
    """model, n, mean_diff and t; t is null where all differences are equal or there is one pair."""
    d = F.col("score") - F.col("base")
    return pairs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("t"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """model, n, w_plus, w_minus and w (the lesser): zero differences share their ranks between the two sides."""
    d = pairs.withColumn("_d", F.col("score") - F.col("base")).withColumn("_size", F.abs("_d"))
    ranked = running(d, "_size", {"_n": F.count(F.lit(1)), "_up": F.count_if(F.col("_d") > 0), "_down": F.count_if(F.col("_d") < 0)}, ["model"])
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2
    zeros = (F.col("_n") - F.col("_up") - F.col("_down")) / 2
    sums = ranked.groupBy("model").agg(F.sum("_n").alias("n"), F.sum(rank * (F.col("_up") + zeros)).alias("w_plus"), F.sum(rank * (F.col("_down") + zeros)).alias("w_minus"))
    return sums.withColumn("w", F.least("w_plus", "w_minus"))


def cohens_d(pairs: DataFrame) -> DataFrame:
    """model, d (pooled) and its size in words."""
    n = F.count(F.lit(1))
    pooled = F.sqrt(((n - 1) * F.var_samp("score") + (n - 1) * F.var_samp("base")) / (2 * n - 2))
    out = pairs.groupBy("model").agg(F.coalesce(F.try_divide(F.avg("score") - F.avg("base"), pooled), F.lit(0.0)).alias("d"))
    return out.withColumn("effect", effect_label(F.col("d")))


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def compare(scores: DataFrame, baseline: str) -> DataFrame:
    """All three statistics of every model against the baseline."""
    pairs = paired(scores, baseline)
    return paired_t(pairs).join(wilcoxon(pairs).select("model", "w"), "model").join(cohens_d(pairs), "model")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float | None, n: int) -> float:
    """Two-sided, n - 1 degrees of freedom; 1 where t is undefined."""
    return 1.0 if t is None or n < 2 else incomplete_beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def wilcoxon_p_value(w: float, n: int) -> float:
    """Two-sided: exact up to 25 pairs for whole rank sums, else by the normal distribution."""
    if n == 0:
        return 1.0
    if n <= 25 and w == int(w):
        ways = [1]
        for rank in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if 0 <= s - rank < len(ways) else 0) for s in range(len(ways) + rank)]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))
