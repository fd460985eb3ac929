"""Importance resampling of documents towards a target text, by hashed n-grams.

A 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes of a text, ``bytes.split`` yields its
words, and crc32 of a run of words is continued from that of the run one shorter, so an n-gram costs one call. Counters
hold how often each of a fixed number of buckets occurs; a task adds up its own, Spark adds those of tasks. The gain of
a bucket is 1000 times the logarithm of its smoothed share in the target over that in the documents; a document weighs
the mean gain of its n-grams, and the draw is without replacement: the greatest sums of weight and seeded Gumbel noise.

Counts and gains have one entry a bucket, whatever the input; texts are read twice (counts, then weights) and never
shuffled or kept; a text is split piece by piece, so a long one is never a list of all its words. Rows are ranked by
``ordinals``, cell by cell.

Defined cases: a null text has no words, weight 0, and is drawn only where ``least_words`` is 0 or less; a null doc_id
has the noise of an empty one and comes before others of its score; rows that are equal may change ranks with each
other; no documents or an empty target give no rows or gains from smoothing alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordinals
from . import common

#: Length of runs, number of buckets, seed of the noise, least words of a candidate, part drawn.
RUNS, BUCKETS, SEED, LEAST_WORDS, PART = 2, 10_000, 7, 20, (25, 100)
#: Bytes of one text that are split at a time.
PIECE = 1 << 20

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Digits, letters in lower case and all bytes of other characters stay; the rest is blank.
_TABLE = bytes(b if b in _WORD or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    plain, at = text.translate(_TABLE), 0
    while len(plain) - at > PIECE and (to := plain.find(b" ", at + PIECE)) >= 0:
        yield plain[at:to].split()
        at = to
    yield (plain[at:] if at else plain).split()


def ngrams(text: bytes, runs: int = RUNS) -> Iterator[tuple[int, list[int]]]:
    """Number of new words, and crc32 of every run of 1 to `runs` words that ends in them, piece by piece."""
    tail: list[bytes] = []
    for new in pieces(text):
        words, old = tail + new, len(tail)
        spaced = [b" " + w for w in words]
        own = list(map(crc32, words))
        found = own[old:]
        for k in range(1, runs):
            own = list(map(crc32, spaced[k:], own))  # own[i] is now the run of k + 1 words from i on
            found += own[max(0, old - k) :]
        yield len(new), found
        tail = words[-(runs - 1) :] if runs > 1 else []


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.large_binary()):
        yield text.as_py() or b""


def bucket_counts(df: DataFrame, column: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how often n-grams of the texts fall into each bucket that holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for batch in batches:
            for text in _texts(batch):
                for _, found in ngrams(text, runs):
                    held.update([c % buckets for c in found])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(held.keys()), pa.int32()), "n": pa.array(list(held.values()), pa.int64())})

    common.prepare(df.sparkSession)
    own = df.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from counts of documents and of the target; one number a bucket comes to the driver."""
    s, t = ({r.bucket: r.n for r in d.collect()} for d in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * (all_s + buckets) / (float(s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)]


def weighed(docs: DataFrame, gains: list[int], runs: int = RUNS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight and, in the struct `row`, the columns to carry."""
    buckets = len(gains)
    told = docs.sparkSession.sparkContext.broadcast(gains)
    kept = [F.struct(*carry).alias("row")] if carry else []
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = told.value.__getitem__
        for batch in batches:
            words, features, weights = [], [], []
            for text in _texts(batch):
                n = n_found = total = 0
                for new, found in ngrams(text, runs):
                    n, n_found = n + new, n_found + len(found)
                    total += sum(map(gain, [c % buckets for c in found]))
                words.append(n)
                features.append(n_found)
                weights.append(total // n_found if n_found else 0)
            numbers = [pa.array(x, pa.int64()) for x in (words, features, weights)]
            rest = [batch.column("row")] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *rest], names=["doc_id", "n_words", "n_features", "weight", *(["row"] if carry else [])])

    common.prepare(docs.sparkSession)
    schema = own.select("doc_id", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_features"), F.lit(0).cast("bigint").alias("weight"), *(["row"] if carry else [])).schema
    return own.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, part: tuple[int, int] = PART, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) and `row` (columns to carry) of every document.

    docs needs doc_id and text, target needs text. part[0] of part[1] candidates are drawn, rounded down.
    """
    gains = bucket_gains(bucket_counts(docs, "text", runs, buckets), bucket_counts(target, "text", runs, buckets), buckets)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    scored = common.saved(weighed(docs, gains, runs, carry).withColumn("score", (F.col("weight") + noise).cast("bigint")), "weights")
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count() * part[0] // part[1]
    ranked = ordinals(scored.filter(able), "score", "doc_id", descending=True, name="rank")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank").cast("bigint")))
    return drawn.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    return resample(docs, target, carry=tuple(docs.columns), **options).filter(F.col("rank").isNotNull()).select("row.*")
