"""Substring dedup: Rabin-Karp hashes of every window of words, counted by hash, merged into removal intervals.

Every window of ``width`` consecutive words of a document gets a 64-bit rolling hash and 16 bits or more of a
second, independent one. Hashes are dealt by value to buckets; in a bucket each sequence keeps its first
window (smallest doc_id, then text's hash, then start) and the starts of all others go back to their documents,
where overlapping windows merge into maximal intervals and the words they cover are removed.

Only hashes and starts are shuffled, packed by bucket (about ten bytes a window), and each task sends a
repeated sequence at most once per chunk, so a passage that a third of all rows share is no hot key.
Texts are shuffled once, compressed. For each byte of the first hash that the
bucket tells, a byte more of the second is shipped: 80 bits up to 65,536 buckets, 88 and at last 96 beyond. Two
different windows of n are taken as equal with a chance of about n**2 / 2**81, and n**2 / 2**97 from 1e13 windows on
(50 TB; 0.002 at 100 TB).

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; rows with a null
doc_id count as the smallest; rows that repeat a doc_id and text get the same result each, and windows of
rows that share a doc_id but differ in text rank by doc_id, then the text's xxhash64, then start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 20
#: Windows that a task sorts and sends at a time, and windows that a bucket holds on average at most.
CHUNK, BUCKET = 1 << 19, 1 << 19

_PACKED = "part int, kind tinyint, doc_id bigint, sub bigint, body binary, docs binary, subs binary, counts binary, starts binary"
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("sub", pa.int64())]
    + [(c, pa.binary()) for c in ("body", "docs", "subs", "counts", "starts")]
)
_HASHES, _STARTS, _TEXT = 0, 1, 2


def _home(doc: np.ndarray, sub: np.ndarray, parts: int) -> np.ndarray:
    return (common.mix(doc.astype(np.uint64) + sub.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), 77) % np.uint64(parts)).astype(np.int64)


def _rows(kind: int, part: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, body: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per part: runs of equal (doc, sub) with the starts of each; body has bytes for each start."""
    order = np.argsort(part.astype(np.uint16 if len(part) == 0 or part.max() < 1 << 16 else np.uint32), kind="stable")
    part, doc, sub, start = part[order], doc[order], sub[order], start[order]
    body = None if body is None else body[order]
    cuts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1)) if len(part) else np.zeros(0, int)
    out: dict[str, list] = {c: [] for c in _SCHEMA.names}
    for a, b in zip(cuts, np.append(cuts[1:], len(part))):
        d, s, t = doc[a:b], sub[a:b], start[a:b]
        run = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (t[1:] < t[:-1])))
        step = np.diff(t, prepend=0)
        step[run] = t[run]
        for c, v in zip(_SCHEMA.names, (int(part[a]), kind, None, None, None if body is None else common.pack_rows(body[a:b]), common.pack(np.diff(d[run], prepend=0)), common.pack(s[run]), common.pack(np.diff(np.append(run, b - a)).astype(np.uint32)), common.pack(step.astype(np.uint32)))):
            out[c].append(v)
    return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


def _unrow(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = common.unpack(row["counts"], np.uint32).astype(np.int64)
    step = common.unpack(row["starts"], np.uint32).astype(np.int64)
    first = np.cumsum(counts) - counts
    total = np.cumsum(step)
    start = total - np.repeat(total[first] - step[first], counts)
    doc = np.cumsum(common.unpack(row["docs"], np.int64))
    return np.repeat(doc, counts), np.repeat(common.unpack(row["subs"], np.int64), counts), start


def _later(h: np.ndarray, check: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks windows whose sequence also has an earlier one here."""
    order = np.argsort(h)
    same = np.zeros(len(h), bool)
    hs = h[order]
    same[1:] = hs[1:] == hs[:-1]
    twin = same.copy()
    twin[:-1] |= same[1:]
    at = order[twin]  # only those with a twin need the full order
    at = at[np.lexsort((start[at], sub[at], doc[at], check[at], h[at]))]
    later = np.zeros(len(h), bool)
    if len(at):
        begins = np.append(True, (h[at[1:]] != h[at[:-1]]) | (check[at[1:]] != check[at[:-1]]))
        first = at[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        later[at] = (doc[at] != doc[first]) | (sub[at] != sub[first]) | (start[at] != start[first])
    return later


def _shipped(buckets: int) -> list[int]:
    """Bytes of a window's two hashes, eight and four, that are sent: nine, without those that the bucket (bits 40 and up) tells."""
    told = min(3, buckets.bit_length() - 1 >> 3)
    return [i for i in range(9 + told) if not 5 <= i < 5 + told]


def _hash_windows(width: int, buckets: int, parts: int):
    def send(chunk: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, check, doc, sub, start = (np.concatenate(x) for x in zip(*chunk))
        chunk.clear()
        later = _later(h, check, doc, sub, start)
        if later.any():
            yield _starts([(doc[later], sub[later], start[later])], parts)
        h, check, doc, sub, start = (x[~later] for x in (h, check, doc, sub, start))
        body = np.empty((len(h), 12), np.uint8)
        body[:, :8] = h.view(np.uint8).reshape(-1, 8)
        body[:, 8:] = check.view(np.uint8).reshape(-1, 4)
        yield _rows(_HASHES, ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), doc, sub, start, body[:, _shipped(buckets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for rows, data, offsets in common.text_slices(batch):
                _, _, words, first = common.word_hashes(data, offsets)
                n = np.maximum(np.diff(first) - width + 1, 0)
                if not n.sum():
                    continue
                row = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = first[row] + start
                doc, sub = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.column("sub").to_numpy(zero_copy_only=False)
                h = common.rolling(words, width, "window")[at]
                check = (common.rolling(common.mix(words, 0x5DEECE66D), width, "check")[at] >> np.uint64(32)).astype(np.uint32)
                chunk.append((common.mix(h), check, doc[row], sub[row], start))
                held += len(at)
                if held >= CHUNK:
                    yield from send(chunk)
                    chunk, held = [], 0
        if chunk:
            yield from send(chunk)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows, which come sorted by part, as one iterator for each part."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    return ((part, own) for part, own in groupby(rows, lambda r: r["part"]))


def _count_buckets(parts: int, buckets: int):
    shipped = _shipped(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for _, rows in _groups(batches):
            bodies, places = [], []
            for row in rows:
                if row["kind"] == _STARTS:
                    yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)
                else:
                    bodies.append(common.unpack_rows(row["body"], len(shipped)))
                    places.append(_unrow(row))
            if not bodies:
                continue
            body = np.zeros((sum(map(len, bodies)), 12), np.uint8)
            body[:, shipped] = np.concatenate(bodies)
            bodies.clear()
            doc, sub, start = (np.concatenate(x) for x in zip(*places))
            later = _later(np.ascontiguousarray(body[:, :8]).view(np.uint64).ravel(), np.ascontiguousarray(body[:, 8:]).view(np.uint32).ravel(), doc, sub, start)
            found.append((doc[later], sub[later], start[later]))
            held += int(later.sum())
            if held >= CHUNK:
                yield _starts(found, parts)
                found, held = [], 0
        if held:
            yield _starts(found, parts)

    return run


def _starts(found: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    """Rows for the home of each document with the starts of its later windows."""
    doc, sub, start = (np.concatenate(x) for x in zip(*found))
    return _rows(_STARTS, _home(doc, sub, parts), doc, sub, start)


def _send_texts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sub = batch.column("sub").to_numpy(zero_copy_only=False)
            body = [pressed.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            nothing = pa.nulls(len(doc), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_home(doc, sub, parts), pa.int32()), pa.array([_TEXT] * len(doc), pa.int8()), pa.array(doc), pa.array(sub, pa.int64()), pa.array(body, pa.binary()), nothing, nothing, nothing, nothing], schema=_SCHEMA)

    return run


def intervals(starts: np.ndarray, width: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [begin, end) of words that windows at `starts` cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.cumsum(edge)[:n_words] > 0
    turns = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        out, size = [], 0
        for _, rows in _groups(batches):  # starts come before the texts of their part
            held: dict[tuple[int, int], list[np.ndarray]] = {}
            for row in rows:
                if row["kind"] == _STARTS:
                    doc, sub, start = _unrow(row)
                    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])))
                    for a, b in zip(cut, np.append(cut[1:], len(doc))):
                        held.setdefault((int(doc[a]), int(sub[a])), []).append(start[a:b])
                    continue
                words = plain.decompress(row["body"]).split()
                begin = end = np.zeros(0, np.int64)
                if own := held.get((row["doc_id"], row["sub"])):
                    begin, end = intervals(np.concatenate(own), width, len(words))
                gone = int((end - begin).sum())
                if gone:
                    keep = np.ones(len(words), bool)
                    for a, b in zip(begin, end):
                        keep[a:b] = False
                    words = list(compress(words, keep))
                text = b" ".join(words)
                out.append({"doc_id": row["doc_id"], "n_words": len(words) + gone, "n_removed": gone, "begins": begin, "ends": end, "kept": text.decode() if with_text else None, "kept_sha256": hashlib.sha256(text).hexdigest()})
                size += len(text) if with_text else 300
                if size > common.SLICE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_RESULT)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, begins and ends of the removed word intervals, kept text, kept_sha256.

    docs needs doc_id bigint and text string; other columns are ignored. ``with_text=False`` leaves kept null.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("own"), "text").withColumn("doc_id", F.coalesce("own", F.lit(-(2**63))))
    # Only where doc_ids repeat do rows need a number of their own; finding out shuffles ids alone.
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    repeats = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    sub = F.xxhash64(F.coalesce("text", F.lit(""))) if repeats else F.lit(0).cast("bigint")
    docs = docs.select("doc_id", "text", sub.alias("sub"))
    n = max(common.shuffle_partitions(spark), size // common.PARTITION_BYTES)
    buckets = common.power_of_two(max(256, 4 * n, size / 6 / BUCKET))
    homes = max(n, buckets // 16)
    found = (
        docs.mapInArrow(_hash_windows(width, buckets, homes), _PACKED)
        .repartition(n, "part")
        .sortWithinPartitions("part")
        .mapInArrow(_count_buckets(homes, buckets), _PACKED)
    )
    kept = (
        docs.mapInArrow(_send_texts(homes), _PACKED)
        .unionByName(found)
        .repartition(n, "part")
        .sortWithinPartitions("part", "kind")
        .mapInArrow(_cut(width, with_text), "doc_id bigint, n_words bigint, n_removed bigint, begins array<int>, ends array<int>, kept string, kept_sha256 string")
    )
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
