"""Crossover and mutation of gene arrays; every random number is a column.

Genes live in [0, 1] (see :mod:`sparkevo.operators.space`); bounds may be given as arrays lo and hi. Draw
arrays have one entry a gene. All operators are projections: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip(*arrays: Column) -> Column:
    return F.arrays_zip(*[a.alias(f"_{i}") for i, a in enumerate(arrays)])


def mapped(f, *arrays: Column) -> Column:
    """f of the entries of equally long arrays, as an array."""
    return F.transform(_zip(*arrays), lambda z: f(*[z[f"_{i}"] for i in range(len(arrays))]))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


# --- crossover: each returns the two children ------------------------------------------------


def uniform(a: Column, b: Column, u: Column) -> tuple[Column, Column]:
    """Genes change sides where u < 0.5."""
    return mapped(lambda x, y, r: F.when(r < 0.5, y).otherwise(x), a, b, u), mapped(lambda x, y, r: F.when(r < 0.5, x).otherwise(y), a, b, u)


def single_point(a: Column, b: Column, cut: Column) -> tuple[Column, Column]:
    """Tails change sides after `cut` genes (1 to n - 1); shorter than two genes: copies."""
    n = F.size(a)
    swap = lambda x, y: F.when(n < 2, x).otherwise(F.concat(F.slice(x, F.lit(1), cut), F.slice(y, cut + 1, n)))
    return swap(a, b), swap(b, a)


def two_point(a: Column, b: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Genes first + 1 .. second change sides (0 < first < second < n)."""
    n = F.size(a)
    swap = lambda x, y: F.concat(F.slice(x, F.lit(1), first), F.slice(y, first + 1, second - first), F.slice(x, second + 1, n))
    return swap(a, b), swap(b, a)


def arithmetic(a: Column, b: Column, alpha: float = 0.5) -> tuple[Column, Column]:
    return mapped(lambda x, y: x * alpha + y * (1 - alpha), a, b), mapped(lambda x, y: y * alpha + x * (1 - alpha), a, b)


def sbx(a: Column, b: Column, u: Column, lo: Column, hi: Column, eta: float = 20.0) -> tuple[Column, Column]:
    """Simulated binary crossover; genes closer than 1e-10 are copied."""

    def child(sign: int, own: int):
        def gene(x, y, r, low, high):
            spread = F.when(r <= 0.5, F.pow(2 * r, F.lit(1 / (eta + 1)))).otherwise(F.pow(1 / (2 * (1 - r)), F.lit(1 / (eta + 1))))
            gap = F.abs(x - y)
            return F.when(gap <= 1e-10, y if own else x).otherwise(clip(0.5 * ((x + y) + sign * spread * gap), low, high))

        return mapped(gene, a, b, u, lo, hi)

    return child(-1, 0), child(1, 1)


def blend(a: Column, b: Column, u: Column, v: Column, lo: Column, hi: Column, alpha: float = 0.5) -> tuple[Column, Column]:
    """BLX: each child draws its own gene from the parents' interval, wider by alpha of its length on both sides."""

    def gene(x, y, r, low, high):
        gap = F.abs(x - y)
        return clip(F.least(x, y) - alpha * gap + r * (1 + 2 * alpha) * gap, low, high)

    return mapped(gene, a, b, u, lo, hi), mapped(gene, a, b, v, lo, hi)


# --- mutation: one gene, at (0-based) place `at` ----------------------------------------------


def at_place(genes: Column, at: Column, lo: Column, hi: Column, change) -> Column:
    """genes with change(x, low, high), clipped, at one place."""
    place = F.sequence(F.lit(0), F.size(genes) - 1)
    return mapped(lambda x, low, high, i: F.when(i == at, clip(change(x, low, high), low, high)).otherwise(x), genes, lo, hi, place)


def reset(genes: Column, at: Column, lo: Column, hi: Column, u: Column) -> Column:
    return at_place(genes, at, lo, hi, lambda x, low, high: low + u * (high - low))


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def gaussian(genes: Column, at: Column, lo: Column, hi: Column, u: Column, v: Column, sigma: float = 0.1, progress: Column | None = None) -> Column:
    """Adds a normal number times sigma of the range; with progress (0 to 1) it dies down to nothing."""
    scale = F.lit(sigma) * (1 - progress) if progress is not None else F.lit(sigma)
    return at_place(genes, at, lo, hi, lambda x, low, high: x + normal(u, v) * scale * (high - low))


def polynomial(genes: Column, at: Column, lo: Column, hi: Column, u: Column, eta: float = 20.0) -> Column:
    delta = F.when(u < 0.5, F.pow(2 * u, F.lit(1 / (eta + 1))) - 1).otherwise(1 - F.pow(2 * (1 - u), F.lit(1 / (eta + 1))))
    return at_place(genes, at, lo, hi, lambda x, low, high: x + delta * (high - low))


def boundary(genes: Column, at: Column, lo: Column, hi: Column, u: Column) -> Column:
    return at_place(genes, at, lo, hi, lambda x, low, high: F.when(u < 0.5, low).otherwise(high))


def non_uniform(genes: Column, at: Column, lo: Column, hi: Column, u: Column, v: Column, progress: Column, b: float = 3.0) -> Column:
    """Up (u < 0.5) or down by range * (1 - v^((1 - progress)^b))."""
    size = 1 - F.pow(v, F.pow(1 - progress, F.lit(b)))
    return at_place(genes, at, lo, hi, lambda x, low, high: x + F.when(u < 0.5, 1).otherwise(-1) * size * (high - low))


def every_gene(genes: Column, lo: Column, hi: Column, gate: Column, u: Column, rate: float = 0.3) -> Column:
    """Each gene is drawn anew where its gate is under rate."""
    return mapped(lambda x, low, high, g, r: F.when(g < rate, low + r * (high - low)).otherwise(x), genes, lo, hi, gate, u)


# --- rates ---------------------------------------------------------------------------------------


def diversity_rates(d: Column, low: float = 0.05, high: float = 0.3, mut=(0.01, 0.5), cross=(0.5, 0.95)) -> tuple[Column, Column]:
    """Mutation and crossover rates: little diversity calls for much mutation and less crossover."""
    m = F.when(d < low, mut[1]).when(d > high, mut[0]).otherwise(mut[1] - (d - low) / (high - low) * (mut[1] - mut[0]))
    return m, cross[1] - (m - mut[0]) / (mut[1] - mut[0]) * (cross[1] - cross[0])


def scheduled_rates(gen: Column, generations: int, mut=(0.01, 0.5), cross=(0.5, 0.95)) -> tuple[Column, Column]:
    p = gen / F.lit(max(generations, 1))
    return mut[1] - p * (mut[1] - mut[0]), cross[0] + p * (cross[1] - cross[0])
