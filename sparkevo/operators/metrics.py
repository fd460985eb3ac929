"""Classification metrics of a frame with label, prediction and score columns.

Counts come from one confusion table of classes by classes; ranking metrics from running totals over distinct
scores (:func:`sparkevo.functions.order.running`), exact and without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import running


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion(df: DataFrame) -> DataFrame:
    """label, prediction, n for every pair of classes that occur; zeros included."""
    counts = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("all"))  # distinct classes
    grid = classes.select(F.explode("all").alias("label"), "all").select("label", F.explode("all").alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and support of every class."""
    cells = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said")))).alias("s"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    sums = sides.groupBy(F.col("s.c").alias("label")).agg(F.sum("s.actual").alias("support"), F.sum("s.said").alias("_said"), (F.sum("hit") / 2).alias("_hit"))
    p, r = ratio(F.col("_hit"), F.col("_said")), ratio(F.col("_hit"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def averages(df: DataFrame) -> DataFrame:
    """kind (macro, weighted), precision, recall, f1, support."""
    out = None
    for kind in ("macro", "weighted"):
        w = F.lit(1) if kind == "macro" else F.col("support")
        row = per_class(df).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def report(df: DataFrame) -> DataFrame:
    """Rows of per_class and averages, and the accuracy, by name."""
    classes = per_class(df).withColumn("kind", F.col("label").cast("string")).drop("label")
    acc = accuracy(df).select(F.lit("accuracy").alias("kind"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), F.col("n").alias("support"))
    return classes.unionByName(averages(df)).unionByName(acc)


def binary(df: DataFrame, positive: int = 1) -> DataFrame:
    return per_class(df).filter(F.col("label") == positive).select("precision", "recall", "f1")


def balanced_accuracy(df: DataFrame) -> DataFrame:
    return per_class(df).filter("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def majority_baseline(df: DataFrame, close: float = 0.01, minority: int = 1) -> DataFrame:
    """accuracy, that of always saying the majority class, whether they are within close, and how the minority fares."""
    counts = per_class(df).agg(F.max("support").alias("most"), F.sum("support").alias("n"), F.sum(F.when(F.col("label") == minority, F.col("recall"))).alias("recall"))
    r = F.coalesce("recall", F.lit(0.0)) * 100
    out = counts.join(F.broadcast(accuracy(df).select("accuracy"))).withColumn("baseline", F.col("most") / F.col("n"))
    return out.select("accuracy", "baseline", (F.abs(F.col("accuracy") - F.col("baseline")) < close).alias("degenerate"), F.when(r < 10, "poor").when(r < 50, "partial").otherwise("good").alias("minority"))


def _by_score(df: DataFrame, score: str, positive: Column, by=(), descending: bool = True) -> DataFrame:
    return running(df.withColumn("_pos", positive.cast("bigint")), score, {"pos": F.sum("_pos"), "neg": F.sum(1 - F.col("_pos"))}, by, descending)


def roc_curve(df: DataFrame, score: str = "prob", positive: int = 1) -> DataFrame:
    """threshold, fpr, tpr at every distinct score, from the greatest, and the start (threshold null: above all)."""
    steps = _by_score(df, score, F.col("label") == positive)
    whole = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = steps.join(F.broadcast(whole)).select(F.col(score).alias("threshold"), ratio(F.col("neg") + F.col("neg_before"), F.col("n")).alias("fpr"), ratio(F.col("pos") + F.col("pos_before"), F.col("p")).alias("tpr"))
    return points.unionByName(whole.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def roc_auc(df: DataFrame, score: str = "prob", positive: int = 1) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; 0 where a class is absent."""
    steps = _by_score(df, score, F.col("label") == positive)
    below = F.col("pos_before") * F.col("neg") + F.col("pos") * F.col("neg") / 2  # positives above each negative
    return steps.agg(ratio(F.sum(below.cast("double")), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, scores: str = "probs", label: str = "label") -> DataFrame:
    """One-versus-rest areas by class, weighted by support; scores is an array with one entry a class, in order."""
    long = df.select(F.posexplode(scores).alias("c", "s"), F.col(label).alias("_l"))
    long = long.withColumn("_is", F.col("c") == F.col("_l"))
    steps = _by_score(long, "s", F.col("_is"), ["c"])
    below = F.col("pos_before") * F.col("neg") + F.col("pos") * F.col("neg") / 2
    areas = steps.groupBy("c").agg(ratio(F.sum(below.cast("double")), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("support"))
    return areas.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "prob", positive: int = 1) -> DataFrame:
    steps = _by_score(df, score, F.col("label") == positive)
    hits = F.col("pos") + F.col("pos_before")
    gain = F.col("pos") * hits / (hits + F.col("neg") + F.col("neg_before"))
    return steps.agg(ratio(F.sum(gain), F.sum("pos")).alias("average_precision"))


def summary(df: DataFrame, score: str = "prob") -> DataFrame:
    """One row: accuracy, weighted precision, recall and f1, roc_auc."""
    weighted = averages(df).filter("kind = 'weighted'").select("precision", "recall", "f1")
    return accuracy(df).select("accuracy").join(F.broadcast(weighted)).join(F.broadcast(roc_auc(df, score)))


def macro_f1(df: DataFrame) -> DataFrame:
    return averages(df).filter("kind = 'macro'").select(F.col("f1").alias("macro_f1"))


METRICS = {"macro_f1": macro_f1, "accuracy": accuracy, "balanced_accuracy": balanced_accuracy, "binary": binary, "averages": averages, "roc_auc": roc_auc, "average_precision": average_precision}


#: What from_counts gives.
COUNTED = {"accuracy", "balanced_accuracy", "macro_f1"}


def from_counts(counts: dict[tuple[int, int], int]) -> dict[str, float]:
    """accuracy, balanced_accuracy and macro_f1 from rows counted by label and prediction, as the frames above give them."""
    classes = sorted({c for pair in counts for c in pair})
    hit = {c: counts.get((c, c), 0) for c in classes}
    true, said = ({c: sum(n for pair, n in counts.items() if pair[k] == c) for c in classes} for k in (0, 1))
    part = lambda a, b: a / b if b else 0.0
    recall, precision = ({c: part(hit[c], whole[c]) for c in classes} for whole in (true, said))
    there, every = [c for c in classes if true[c]], sum(true.values())
    f1 = [part(2 * precision[c] * recall[c], precision[c] + recall[c]) for c in classes]
    return {"accuracy": part(sum(hit.values()), every), "balanced_accuracy": part(sum(recall[c] for c in there), len(there)), "macro_f1": part(sum(f1), len(classes))}
