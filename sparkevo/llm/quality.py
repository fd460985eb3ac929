"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes.

Features of a text are indicators, hashed to ``BUCKETS``, of its byte 4-grams, its words and the patterns of
n-grams that repeat a word. Over *all* labelled
training rows Spark counts, per class, the texts with each feature; r = log of the ratio of the two smoothed
and normalised counts. Texts become r times their indicators, scaled to unit length by the number of indicators,
and a hinge-loss model is fitted by dual coordinate descent on at most ``FIT_ROWS`` labelled documents, a text for
each doc_id, half of them of each class (one with fewer leaves room for the other), the first in the order of a
seeded hash; of each class, those whose features pass half of ``FIT_BYTES`` together are left out. A logistic curve, with weights that restore the shares of the classes, through the margins of a fifth of these, which the model
for it has not seen, turns margins into probabilities.

Scoring is one pass over the texts with one weight a feature; nothing is shuffled for it. The counts are
BUCKETS * 2 numbers a task, summed in Spark by block. Defined cases: null and empty texts have no features and
get the curve's value at the intercept; a doc_id with several labels counts with the least, one with none or a
null label not at all; with one class only, or no labelled rows, every text gets the share of label 1 (or 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from . import common

BUCKETS, BLOCK = 1 << 18, 1 << 12
#: Bounds of what the driver fits on: rows (about 1,200 features of four bytes each), and bytes of features.
FIT_ROWS, FIT_BYTES = 6_000, 128 << 20
PENALTY, ROUNDS, SMOOTH, SEED = 1.0, 12, 1.0, 42
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every distinct feature of concatenated texts, by text."""
    n = len(offsets) - 1
    grams = np.zeros(max(0, len(data) - 3), np.uint32)
    if len(grams):
        wide = data.astype(np.uint32)
        grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    inside = rows[: len(grams)] == rows[3:] if len(grams) else np.zeros(0, bool)
    gram_rows = rows[: len(grams)][inside]
    gram_at = (common.mix(grams[inside].astype(np.uint64), 11) & np.uint64(BUCKETS - 1)).astype(np.int64)
    begin, _, words, first = common.word_hashes(data, offsets)
    word_rows = np.repeat(np.arange(n), np.diff(first))
    word_at = (common.mix(words, 23) & np.uint64(BUCKETS - 1)).astype(np.int64)
    keys = [gram_rows * BUCKETS + gram_at, word_rows * BUCKETS + word_at]
    for gap in (1, 2, 3):  # the pattern of an n-gram that ends as it begins, once and twice running
        same = (words[gap:] == words[:-gap]) & (word_rows[gap:] == word_rows[:-gap])
        again = same[1:] & same[:-1] & (word_rows[gap + 1 :] == word_rows[gap:-1])
        for kind, own in enumerate((word_rows[gap:][same], word_rows[gap + 1 :][again])):
            keys.append(np.unique(own) * BUCKETS + int(common.mix(np.array([gap + 10 * kind], np.uint64), 37)[0] & np.uint64(BUCKETS - 1)))
    key = np.unique(np.concatenate(keys))
    return key // BUCKETS, key % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, some = np.zeros((2, BUCKETS), np.int32), False
    for batch in batches:
        for rows, data, offsets in common.text_slices(batch):
            label = rows.column("label").to_numpy(zero_copy_only=False)
            at, bucket = features(data, offsets)
            for k in (0, 1):
                counts[k] += np.bincount(bucket[label[at] == k], minlength=BUCKETS).astype(np.int32)
            some = True
    if some:
        n = BUCKETS // BLOCK
        body = [common.pack(counts[k, b * BLOCK : (b + 1) * BLOCK]) for b in range(n) for k in (0, 1)]
        yield pa.RecordBatch.from_pydict({"block": [b for b in range(n) for _ in (0, 1)], "label": [0, 1] * n, "body": body}, schema=_COUNTS)


_COUNTS = pa.schema([("block", pa.int32()), ("label", pa.int32()), ("body", pa.binary())])


def _add(rows: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for b in rows.column("body"):
        total += common.unpack(b.as_py(), np.int32)
    return pa.Table.from_pydict({"block": rows.column("block")[:1], "label": rows.column("label")[:1], "body": [total.tobytes()]}, schema=_COUNTS)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in common.text_slices(batch):
            at, bucket = features(data, offsets)
            cut = np.searchsorted(at, np.arange(len(offsets)))
            own = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("turn"), rows.column("label"), pa.array(own, pa.binary())], names=["turn", "label", "own"])


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Weights, the last an intercept, that minimise half their square plus penalty times the hinge losses.

    Row i has the value r[f] / sqrt(len(rows[i])) at its features f, and 1 for the intercept; y is 1 or -1.
    """
    w, alpha, random = np.zeros(len(r) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    values = [r[x] / np.sqrt(max(1, len(x))) for x in rows]
    squares = np.array([v @ v + 1.0 for v in values])
    caps = penalty * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        for i in random.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), caps[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[x] += step * v
                w[-1] += step
    return w


def _margins(rows: list[np.ndarray], w: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.array([(w[x] * r[x]).sum() / np.sqrt(max(1, len(x))) + w[-1] for x in rows])


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a m + b))) for weighted rows, by Newton steps with targets drawn in as Platt does."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        e = weight * (p - t)
        g = np.array([(e * m).sum() + 1e-6 * a, e.sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    """weight: of each feature, divided by sqrt(features of the text) when summed; then intercept, a and b."""

    def __init__(self, weight: np.ndarray, intercept: float, a: float, b: float) -> None:
        self.weight, self.intercept, self.a, self.b = weight, intercept, a, b

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, bucket = features(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(at, self.weight[bucket], n) / np.sqrt(np.maximum(1, np.bincount(at, minlength=n)))
        return 1 / (1 + np.exp(-np.clip(self.a * (total + self.intercept) + self.b, -30, 30)))


def class_counts(known: DataFrame) -> np.ndarray:
    """For labels 0 and 1 and each bucket: the rows of known (text, label) with that feature."""
    counted = known.mapInArrow(_count, "block int, label int, body binary").groupBy("block", "label").applyInArrow(_add, "block int, label int, body binary")
    counts = np.zeros((2, BUCKETS))
    for r in counted.collect():  # BUCKETS numbers a class, whatever the input
        counts[r.label, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.body, np.int64)
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log of the ratio of the smoothed and normalised counts of label 1 and label 0."""
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_sample(docs: DataFrame, met: DataFrame, take: list[int], fit_bytes: int) -> pa.Table:
    """turn, label and own (features): at most take[k] rows of label k, and fit_bytes bytes, of the labelled ids met."""
    turned = met.withColumn("turn", F.xxhash64("doc_id", F.lit(SEED)))
    first = [turned.filter(F.col("label") == k).orderBy("turn", "doc_id").limit(take[k]) for k in (0, 1)]
    # As many rows of three numbers as the parameter says: broadcasting them is bounded.
    chosen = docs.select("doc_id", "text").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    one = chosen.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("turn").alias("turn"), F.first("label").alias("label"))
    found = common.saved(one.select("text", "turn", "label").mapInArrow(_sample, "turn bigint, label int, own binary"), "sample")
    # A window over these few rows' sizes, which decides which of them come to the driver.
    before = F.sum(F.octet_length("own")).over(Window.partitionBy("label").orderBy("turn"))
    small = found.select("turn", "label", before.alias("bytes")).filter(F.col("bytes") <= fit_bytes // 2).select("turn", "label")
    return found.join(F.broadcast(small), ["turn", "label"]).toArrow().sort_by("turn")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", use: Column | None = None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit on rows of docs (doc_id, text) that labels (doc_id and the label column, 0 or 1) marks and use keeps."""
    common.prepare(docs.sparkSession)
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if use is not None:
        marks, docs = marks.filter(use), docs.filter(use)
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    # A sort-merge join at every size: labels grow with the corpus, so their broadcast would end somewhere.
    counts = class_counts(docs.select("doc_id", "text").join(marks.hint("shuffle_merge"), "doc_id").select("text", "label"))
    met = common.saved(marks.join(docs.select("doc_id").hint("shuffle_merge"), "doc_id", "left_semi"), "labelled")
    n = [0, 0]
    for r in met.groupBy("label").count().collect():
        n[r.label] = r["count"]
    if not all(n):
        share = n[1] / sum(n) if sum(n) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    half = max(1, fit_rows // 2)
    rows = fit_sample(docs, met, [min(n[k], max(half, fit_rows - n[1 - k])) for k in (0, 1)], fit_bytes)
    y = np.where(rows.column("label").to_numpy() == 1, 1.0, -1.0)
    own = [np.frombuffer(b.as_py(), np.int32) for b in rows.column("own")]
    ratio = log_ratios(counts)
    weight = np.where(y > 0, n[1] / max(1, (y > 0).sum()), n[0] / max(1, (y < 0).sum()))
    held = np.zeros(len(y), bool)
    for k in (1, -1):
        held[np.flatnonzero(y == k)[4::5]] = True
    if len(set(y[held])) == 2 and len(set(y[~held])) == 2:
        part = descend([x for x, h in zip(own, held) if not h], y[~held], ratio)
        a, b = logistic(_margins([x for x, h in zip(own, held) if h], part, ratio), y[held], weight[held])
    else:
        a, b = 2.0, 0.0
    w = descend(own, y, ratio)
    return Model(w[:-1] * ratio, float(w[-1]), a, b)


def _score(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for rows, data, offsets in common.text_slices(batch):
                score = own.score(data, offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, name])

    return run


def score(docs: DataFrame, fitted: Model, name: str = "score") -> DataFrame:
    """docs with name, the probability of label 1; its other columns stay, one of that name gives way."""
    common.prepare(docs.sparkSession)
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # BUCKETS weights
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_score(held, name), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def filter_quality(docs: DataFrame, fitted: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose score is at least threshold."""
    name = common.free(docs, "score")
    return score(docs, fitted, name).filter(F.col(name) >= threshold).drop(name)
