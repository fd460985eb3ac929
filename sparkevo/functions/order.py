"""Order statistics without a global sort in one task.

``celled`` cuts a frame at sampled quantiles of a key into about sqrt(n) cells of nearly equal size, whatever the key's
distribution. ``running`` gives running totals over distinct values: totals of cells are summed up in one small window,
and only the values of one cell are ordered together. ``ordinals`` numbers rows by value, then id. ``quantiles``
brackets each rank by approximate percentiles, counts what lies below and inside, and collects no more than ``LEAF``
distinct values a rank. ``latest`` matches points with the last bound at or below them, by merging both in ranges of the
joint order, so neither a bound of many points nor a point's place makes a hot task. Up to ``FEW`` rows, which a count
that stops there tells, the same numbers come from one plain window. Tables of a row a value or a cell of one, as many as
the rows at worst, are joined by shuffle at every size (``MEET``), so no growing part of them passes through the driver.

Null group keys are groups of their own; internal columns take names that the frame does not have.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free, saved

LEAF, ACCURACY, WIDE = 20_000, 10_000, 40
#: Rows that one task may order.
FEW = 20_000
#: How tables meet that may have as many rows as the frame.
MEET = "shuffle_merge"
#: Cells of a frame at most; their bounds are all that comes to the driver.
PROBE, CELLS = 1024, 1 << 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys in which nulls equal each other; keys come from left."""
    names = [free(left, f"_right_{i}") for i in range(len(keys))]
    right = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on, how).drop(*names)


def few(df: DataFrame) -> bool:
    """Whether df has no more than FEW rows: partitions are looked at, a few at first, until there are more."""
    return df.select(F.lit(1))._jdf.takeAsList(FEW + 1).size() <= FEW


def _percentiles(df: DataFrame, key: str, n: int) -> tuple[list[float], int]:
    shares = F.lit([i / n for i in range(1, n)])
    got = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, F.lit(4 * n)).alias("q"), F.count(F.lit(1)).alias("n")).first()
    return list(got.q or []), got.n


def celled(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with name, a cell number that rises with key; null keys are in cell -1."""
    found, n = _percentiles(df, key, PROBE)
    cells = min(CELLS, max(1, math.isqrt(n)))
    if cells > PROBE:
        found, _ = _percentiles(df, key, cells)
    elif found:
        found = [found[i * len(found) // cells] for i in range(1, cells)]
    bounds = sorted({b for b in found if math.isfinite(b)})
    if not bounds:
        return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    number, cell = free(df, "_number"), free(df, "_cell")
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=number, outputCol=cell, handleInvalid="keep")
    placed = cut.transform(df.withColumn(number, F.col(key).cast("double")))
    return placed.withColumn(name, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col(cell).cast("int"))).drop(number, *({cell} - {name}))


def running(df: DataFrame, value: str, totals: dict[str, Column], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """by, value, each of totals (per distinct value) and <name>_before, its sum over the values that come first."""
    by = list(by)
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(k) for k, c in totals.items()])
    if few(df):
        return before(distinct, value, list(totals), by, descending, True)
    return before(saved(distinct, "running"), value, list(totals), by, descending)


def before(distinct: DataFrame, value: str, totals: Sequence[str], by: Sequence[str] = (), descending: bool = False, plain: bool | None = None) -> DataFrame:
    """by, value, totals and <name>_before of a saved frame with one row a value of by; plain: it has few rows."""
    by = list(by)
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    if few(distinct) if plain is None else plain:
        earlier = Window.partitionBy(*by).orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
        return distinct.select(*by, value, *totals, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in totals])
    cell = free(distinct, "_cell_of")
    distinct = celled(distinct, value, cell)
    up, own = ({k: free(distinct, f"{kind}_{k}") for k in totals} for kind in ("_up", "_in"))
    sums = distinct.groupBy(*by, cell).agg(*[F.sum(k).alias(up[k]) for k in totals])
    outer = Window.partitionBy(*by).orderBy(order(cell)).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, cell, *[F.coalesce(F.sum(up[k]).over(outer), F.lit(0)).alias(up[k]) for k in totals])
    inner = Window.partitionBy(*by, cell).orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    inside = distinct.select("*", *[F.coalesce(F.sum(k).over(inner), F.lit(0)).alias(own[k]) for k in totals])
    joined = null_safe_join(inside, sums.hint(MEET), [*by, cell])
    return joined.select(*by, value, *totals, *[(F.col(own[k]) + F.col(up[k])).alias(f"{k}_before") for k in totals])


def ordinals(df: DataFrame, value: str, id_: str, by: Sequence[str] = (), descending: bool = False, name: str = "ordinal") -> DataFrame:
    """df with its 1-based number by value, then id (a whole number), within by; rows without a value go."""
    by = list(by)
    n, ahead, earlier, at, place = (free(df, c) for c in ("_n", "_before", "_earlier", "_at", "_bin"))
    if few(df):
        order = F.desc(value) if descending else F.asc(value)
        return df.filter(F.col(value).isNotNull()).withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, F.asc(id_))).cast("bigint"))
    valued = df.filter(F.col(value).isNotNull())
    values = before(saved(valued.groupBy(*dict.fromkeys([*by, value])).agg(F.count(F.lit(1)).alias(n)), "values"), value, [n], by, descending).select(*by, value, F.col(f"{n}_before").alias(ahead))
    placed = celled(valued, id_, place)
    cells = placed.groupBy(*by, value, place).agg(F.count(F.lit(1)).alias(n))
    outer = Window.partitionBy(*by, value).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, value, place, F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(earlier))
    inner = Window.partitionBy(*by, value, place).orderBy(id_)
    cells = null_safe_join(cells, values.hint(MEET), [*by, value])  # before the rows, of which one value may have many
    numbered = null_safe_join(placed.withColumn(at, F.row_number().over(inner)), cells.hint(MEET), [*by, value, place])
    return numbered.withColumn(name, F.col(ahead) + F.col(earlier) + F.col(at)).drop(ahead, earlier, at, place)


def neighbours(df: DataFrame, value: str, id_: str, by: Sequence[str], before: str, after: str) -> DataFrame:
    """df with the values next before and after each row's in the order of value, then id, within by; null at the ends.

    Rows are ordered in blocks of FEW of their numbers in that order, so any number of them may share a value. The first and
    the last row of a block stand in the block beside it too.
    """
    by = list(by)
    if few(df):
        window = Window.partitionBy(*by).orderBy(value, id_)
        return df.withColumns({before: F.lag(value).over(window), after: F.lead(value).over(window)})
    place, block, own = (free(df, c) for c in ("_place", "_block", "_home"))
    numbered = saved(ordinals(df, value, id_, by, name=place), "numbered")
    at = lambda step: F.floor((F.col(place) + (step - 1)) / F.lit(FEW))
    blocks = numbered.withColumn(own, at(0)).withColumn(block, F.explode(F.array_distinct(F.array(at(-1), at(0), at(1)))))
    window = Window.partitionBy(*by, block).orderBy(place)
    return blocks.withColumns({before: F.lag(value).over(window), after: F.lead(value).over(window)}).filter(F.col(block) == F.col(own)).drop(place, block, own)


def latest(points: DataFrame, at: str, bounds: DataFrame, low: str, keep: Sequence[str]) -> DataFrame:
    """points with the columns keep of the last of bounds (by low) whose low is no greater than at; null where none is.

    Of bounds with the same low any may be taken. Both are merged by place, cut into cells, and a cell takes over the
    last bound before it.
    """
    pos, own, held, mine, cell = "_pos", "_own", "_held", "_mine", "_cell_of"
    bound, point = F.struct(*keep), F.struct(*points.columns)
    left = bounds.select(F.col(low).cast("double").alias(pos), F.lit(0).alias(own), bound.alias(held), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias(mine))
    right = points.select(F.col(at).cast("double").alias(pos), F.lit(1).alias(own), F.lit(None).cast(left.schema[held].dataType).alias(held), point.alias(mine))
    both = left.unionByName(right)
    inner = lambda *by: Window.partitionBy(*by).orderBy(pos, own).rowsBetween(Window.unboundedPreceding, 0)
    if few(both):
        both = both.withColumn(held, F.last(held, ignorenulls=True).over(inner()))
    else:
        both = celled(saved(both, "merged"), pos, cell)
        ends = both.filter(F.col(own) == 0).groupBy(cell).agg(F.max_by(held, pos).alias("_end"))
        cells = both.select(cell).distinct().join(ends, cell, "left")  # about sqrt(rows) of them
        carried = F.last("_end", ignorenulls=True).over(Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
        both = both.withColumn(held, F.last(held, ignorenulls=True).over(inner(cell))).join(cells.select(cell, carried.alias("_end")), cell)
        both = both.withColumn(held, F.coalesce(held, "_end"))
    return both.filter(F.col(own) == 1).select(f"{mine}.*", *[F.col(f"{held}.{c}").alias(c) for c in keep])


class _Bracket:
    """Ranks of a column that lie between two values, and what is known of these."""

    def __init__(self, column: str, lo: float, hi: float, ranks: list[int], below: int | None, inside: int | None, slack: int = 1) -> None:
        self.column, self.lo, self.hi, self.ranks, self.below, self.inside, self.slack = column, lo, hi, ranks, below, inside, slack

    def holds(self) -> Column:
        return (F.col(self.column) >= F.lit(self.lo)) & (F.col(self.column) <= F.lit(self.hi))


def _first_brackets(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> tuple[list[_Bracket], dict[str, int], dict[str, tuple[float, float]]]:
    """Brackets of all ranks, and the number and the ends of each column's values."""
    margin = 2 / ACCURACY
    shares = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-margin, margin)]
    aggregates = [f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    aggregates += [F.percentile_approx(c, F.lit(shares), F.lit(ACCURACY)).alias(f"q{i}") for i, c in enumerate(columns)]
    got, brackets, counts = df.agg(*aggregates).first(), [], {}
    for i, c in enumerate(columns):
        n = counts[c] = got[f"n{i}"]
        if not n:
            continue
        ranks = [sorted({math.floor(p * (n - 1)), math.ceil(p * (n - 1))}) for p in probabilities]
        if n <= LEAF:
            brackets.append(_Bracket(c, got[f"lo{i}"], got[f"hi{i}"], sorted({r for own in ranks for r in own}), 0, n))
        else:
            brackets += [_Bracket(c, got[f"q{i}"][2 * k], got[f"q{i}"][2 * k + 1], own, None, None) for k, own in enumerate(ranks)]
    return brackets, counts, {c: (got[f"lo{i}"], got[f"hi{i}"]) for i, c in enumerate(columns)}


def _narrowed(df: DataFrame, brackets: list[_Bracket], ends: dict[str, tuple[float, float]]) -> list[_Bracket]:
    """The brackets with counts; those that miss their ranks widened, those that hold too much narrowed."""
    counts = [c for i, b in enumerate(brackets) for c in (F.count_if(F.col(b.column) < F.lit(b.lo)).alias(f"b{i}"), F.count_if(b.holds()).alias(f"n{i}"))]
    got, out = df.agg(*counts).first(), []
    large = [i for i, b in enumerate(brackets) if got[f"n{i}"] > LEAF and b.lo != b.hi]
    parts = F.lit([j / 256 for j in range(257)])
    cuts = df.agg(*[F.percentile_approx(F.when(brackets[i].holds(), F.col(brackets[i].column)), parts, F.lit(ACCURACY)).alias(f"q{i}") for i in large]).first() if large else {}
    for i, b in enumerate(brackets):
        below, inside = got[f"b{i}"], got[f"n{i}"]
        missing = [r for r in b.ranks if not below <= r < below + inside]
        if missing:
            out.append(_Bracket(b.column, *ends[b.column], missing, None, None, 2 * b.slack))
        ranks = [r for r in b.ranks if r not in missing]
        if not ranks:
            continue
        if inside <= LEAF or b.lo == b.hi:
            out.append(_Bracket(b.column, b.lo, b.hi, ranks, below, inside))
            continue
        q = cuts[f"q{i}"]
        for r in ranks:  # one part in 256, and its neighbours for the error of the approximation
            at = (r - below) * 256 // inside
            lo, hi = q[max(0, at - b.slack)], q[min(256, at + 1 + b.slack)]
            out.append(_Bracket(b.column, lo, hi, [r], None, None, b.slack) if (lo, hi) != (b.lo, b.hi) else _Bracket(b.column, b.lo, b.hi, [r], below, inside))
    return out


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of numeric columns, nulls and NaN left out; None for no values."""
    df = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    out: dict[str, list[float | None]] = {}
    for a in range(0, len(columns), WIDE):  # so many columns an aggregation
        part = list(columns[a : a + WIDE])
        brackets, counts, ends = _first_brackets(df, part, probabilities)
        value: dict[tuple[str, int], float] = {}
        while any(b.below is None for b in brackets):
            known = [b for b in brackets if b.below is not None]
            brackets = known + _narrowed(df, [b for b in brackets if b.below is None], ends)
        if brackets:
            marked = F.array(*[F.when(b.holds(), F.struct(F.lit(i).alias("b"), F.col(b.column).alias("x"))) for i, b in enumerate(brackets)])
            cells = df.select(F.explode(F.filter(marked, lambda m: m.isNotNull())).alias("m")).groupBy("m.b", "m.x").agg(F.count(F.lit(1)).alias("n"))
            found: dict[int, list[tuple[float, int]]] = {}
            for r in cells.collect():  # at most LEAF distinct values a rank
                found.setdefault(r.b, []).append((r.x, r.n))
            for i, b in enumerate(brackets):
                below = b.below
                for x, n in sorted(found[i]):
                    value |= {(b.column, r): x for r in b.ranks if below <= r < below + n}
                    below += n
        for c in part:
            n, own = counts[c], []
            for p in probabilities:
                at = p * (n - 1)
                own.append(None if not n else value[c, math.floor(at)] + (value[c, math.ceil(at)] - value[c, math.floor(at)]) * (at - math.floor(at)))
            out[c] = own
    return out
