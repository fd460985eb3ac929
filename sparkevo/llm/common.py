"""Shared helpers: settings, vocabularies, packed arrays, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import discard, free, saved, scratch, shared_dir  # noqa: F401

#: Rows in one Arrow batch; texts of a megabyte each still fit in a Python worker.
ARROW_ROWS = 500
#: Bytes of text that the vectorised helpers take at a time (one longer text is taken whole).
SLICE_BYTES = 1 << 21
#: Bytes of files that a shuffle partition is meant for, and the partitions that are asked for at most.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def vocabulary(name: str) -> str:
    """The file of a public vocabulary by its name, where this runs; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that df reads; None where it reads other sources too, whose sizes are guesses."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    if any(leaf.getClass().getSimpleName() != "LogicalRelation" for leaf in leaves):
        return None
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in leaves)


def shuffle_partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """spark.sql.shuffle.partitions, or more where the files that df reads hold over PARTITION_BYTES for each of them."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = None if df is None else file_bytes(df)
    return n if size is None else max(n, min(MOST_PARTITIONS, -(-size // PARTITION_BYTES)))


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, float(n))))))


# --- packed integer arrays -------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, so that zero planes vanish in Spark's shuffle compression."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


# --- words and hashes ------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
#: Odd multipliers that are 5 mod 8, so that powers of them keep the longest period modulo 2**64.
_BASES = {"word": 0x9E3779B97F4A7C15, "window": 0xD1342543DE82EF95, "check": 0xF1357AEA2E62A9C5}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = power_of_two(max(n, 1 << 16))
        b = _BASES[base]
        steps = np.full(size, b, np.uint64), np.full(size, pow(b, -1, 1 << 64), np.uint64)
        for s in steps:
            s[0] = 1
        have = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
        if size <= SLICE_BYTES * 2:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all of x."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def rolling(z: np.ndarray, width: int, base: str) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every run of `width` items of z (from prefix sums)."""
    n = len(z) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(z) + 1)
    sums = np.zeros(len(z) + 1, np.uint64)
    np.cumsum(z * up[: len(z)], dtype=np.uint64, out=sums[1:])
    return (sums[width:] - sums[:n]) * down[:n]


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in a row made one, up to about size bytes each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of about size bytes: (rows, bytes of their texts, offsets of each row); null is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 9-13 and 32) of concatenated texts.

    Returns their first and end byte, a 64-bit hash of each, and for every text the index of its first
    word (one more entry than texts). Words never reach over the end of a text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~_SPACE[data]
    first = np.ones(n, bool)
    first[1:] = ~letter[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = True
    last = np.ones(n, bool)
    last[:-1] = first[1:] | ~letter[1:]
    begin, end = np.flatnonzero(first & letter), np.flatnonzero(last & letter) + 1
    up, down = powers("word", n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64, out=sums[1:])
    return begin, end, mix((sums[end] - sums[begin]) * down[begin]), np.searchsorted(begin, offsets)


def pack_rows(a: np.ndarray) -> bytes:
    """Bytes of a two-dimensional byte array, column by column."""
    return np.ascontiguousarray(a.T).tobytes()


def unpack_rows(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(width, -1).T
