"""Search spaces: genes in [0, 1], in the order of their names, and their values.

A space is a dict of gene -> spec with kind discrete (low, high: whole numbers), continuous (low, high, scale
linear or log10) or categorical (values). Encoding and decoding are column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import uniform


@dataclass(frozen=True)
class Gene:
    kind: str
    low: float = 0.0
    high: float = 1.0
    scale: str = "linear"
    values: tuple[Any, ...] = field(default=())

    def encode(self, v: Column) -> Column:
        if self.kind == "categorical":
            at = F.array_position(F.array(*[F.lit(x) for x in self.values]), v) - 1
            return F.when(at < 0, F.raise_error(F.lit("unknown category"))).otherwise(at / F.lit(max(1, len(self.values) - 1))) if len(self.values) > 1 else F.lit(0.5)
        lo, hi, x = self.low, self.high, v.cast("double")
        if self.scale == "log10":
            lo, hi, x = math.log10(lo), math.log10(hi), F.log10(x)
        g = (x - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.5)
        return F.when((v < F.lit(self.low)) | (v > F.lit(self.high)), F.raise_error(F.lit("value out of range"))).otherwise(g)

    def decode(self, g: Column) -> Column:
        g = F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))
        if self.kind == "categorical":
            at = F.bround(g * F.lit(float(len(self.values) - 1))).cast("int")  # half to even, as Python rounds
            return F.element_at(F.array(*[F.lit(x) for x in self.values]), at + 1)
        if self.kind == "discrete":
            return F.bround(F.lit(float(self.low)) + g * F.lit(float(self.high - self.low))).cast("bigint")
        if self.scale == "log10":
            lo, hi = math.log10(self.low), math.log10(self.high)
            return F.pow(F.lit(10.0), F.lit(lo) + g * F.lit(hi - lo))
        return F.lit(float(self.low)) + g * F.lit(float(self.high - self.low))


Space = dict[str, Gene]


def gene_names(space: Space) -> list[str]:
    return sorted(space)


def encode(space: Space, values: dict[str, Column]) -> Column:
    return F.array(*[space[g].encode(values[g]).cast("double") for g in gene_names(space)])


def decode(space: Space, genes: Column) -> dict[str, Column]:
    return {g: space[g].decode(genes[i]) for i, g in enumerate(gene_names(space))}


def random_genes(space: Space, seed: int, *keys: Column) -> Column:
    return F.array(*[uniform(seed, *keys, F.lit(i)) for i in range(len(space))])


def valid(space: Space, genes: Column) -> Column:
    """Whether there is a number in [0, 1] for every gene."""
    inside = F.forall(genes, lambda g: F.coalesce((g >= 0) & (g <= 1), F.lit(False)))
    return F.coalesce((F.size(genes) == len(space)) & inside, F.lit(False))


def from_spec(spec: dict[str, dict], overrides: dict[str, dict] | None = None) -> Space:
    """A space from a JSON-like spec {name: {type, min, max, scale, values}}; overrides change single entries."""
    out = {}
    for name, s in spec.items():
        s = s | (overrides or {}).get(name, {})
        if s.get("values"):
            out[name] = Gene("categorical", values=tuple(s["values"]))
        elif s.get("min") is not None:
            out[name] = Gene(s["type"], s["min"], s["max"], s.get("scale", "linear"))
    return out


#: Search spaces of the models (fixed values: the choices that experiments draw from).
PREPARATION: Space = {
    "pca": Gene("categorical", values=(0.90, 0.95, 0.99)),
    "rebalance": Gene("categorical", values=("smote", "random_over")),
    "scaler": Gene("categorical", values=("standard", "minmax", "robust")),
}
SPACES: dict[str, Space] = {
    "random_forest": PREPARATION | {"max_depth": Gene("categorical", values=(5, 10, 15, 20, 25, 30)), "min_leaf": Gene("categorical", values=(1, 2, 4, 8)), "trees": Gene("categorical", values=(50, 100, 200, 300, 500)), "features": Gene("categorical", values=("sqrt", "log2", "all"))},
    "svm": PREPARATION | {"C": Gene("continuous", 0.1, 100.0), "degree": Gene("categorical", values=(2, 3, 4, 5)), "kernel": Gene("categorical", values=("linear", "rbf", "poly", "sigmoid"))},
    "knn": PREPARATION | {"k": Gene("categorical", values=(3, 5, 7, 9, 11, 15, 21)), "metric": Gene("categorical", values=("euclidean", "manhattan")), "weights": Gene("categorical", values=("uniform", "distance"))},
    "gbt": PREPARATION | {"max_depth": Gene("categorical", values=(3, 5, 7, 9, 11)), "rate": Gene("continuous", 0.01, 0.3), "subsample": Gene("continuous", 0.6, 1.0), "trees": Gene("categorical", values=(50, 100, 200, 300, 500))},
    "leafwise": PREPARATION | {"leaves": Gene("categorical", values=(15, 31, 63, 127)), "l1": Gene("continuous", 0.0, 1.0), "l2": Gene("continuous", 0.0, 2.0), "least": Gene("categorical", values=(5, 10, 20, 50)), "rate": Gene("continuous", 0.01, 0.3), "subsample": Gene("continuous", 0.6, 1.0), "trees": Gene("categorical", values=(50, 100, 200, 300, 500))},
    "mlp": PREPARATION | {"layer1": Gene("categorical", values=(16, 32, 64, 128, 256)), "layer2": Gene("categorical", values=(0, 16, 32, 64, 128)), "layer3": Gene("categorical", values=(0, 16, 32, 64)), "max_iter": Gene("categorical", values=(200, 300, 500))},
    "network": PREPARATION | {"activation": Gene("categorical", values=("relu", "tanh", "logistic")), "alpha": Gene("continuous", 0.0001, 0.1, "log10"), "layer1": Gene("categorical", values=(16, 32, 64, 128, 256)), "layer2": Gene("categorical", values=(0, 16, 32, 64, 128)), "layer3": Gene("categorical", values=(0, 16, 32, 64)), "max_iter": Gene("categorical", values=(200, 300, 500))},
    "logistic": PREPARATION | {"C": Gene("continuous", 0.001, 10.0, "log10"), "penalty": Gene("categorical", values=("l1", "l2"))},
}
#: Population and generations of the usual settings (fixed values that users know).
PRESETS: dict[str, tuple[int, int]] = {"quick": (10, 5), "standard": (20, 15), "thorough": (50, 30)}


def narrowed(space: Space, values: dict[str, tuple[Any, ...]]) -> Space:
    """space with the choices of some genes replaced; names that it lacks are an error."""
    if set(values) - set(space):
        raise ValueError(f"no such genes: {sorted(set(values) - set(space))}")
    return space | {n: Gene("categorical", values=tuple(v)) for n, v in values.items()}


#: Smaller models for first looks: fewer trees, lower ones, fewer steps.
QUICK: dict[str, Space] = SPACES | {
    "random_forest": narrowed(SPACES["random_forest"], {"trees": (10, 20, 50), "max_depth": (5, 10)}),
    "gbt": narrowed(SPACES["gbt"], {"trees": (5, 10, 20), "max_depth": (3, 5)}),
    "network": narrowed(SPACES["network"], {"max_iter": (10, 20), "layer1": (16, 32), "layer2": (0, 16), "layer3": (0,)}),
    "leafwise": narrowed(SPACES["leafwise"], {"trees": (3, 5), "leaves": (7, 15)}),
    "mlp": narrowed(SPACES["mlp"], {"max_iter": (20, 50), "layer1": (16, 32), "layer2": (0, 16), "layer3": (0,)}),
}
