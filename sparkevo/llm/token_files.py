"""Token-ID output: Parquet list columns with dictionary and delta encoding, small row groups and page indexes.

Documents are range-partitioned by doc_id, encoded where they land, and written by Spark's Parquet writer:
token ids as a dictionary-encoded list (16 bits or less an id for usual vocabularies), doc_id, row and length
delta-encoded, row groups of ``ROW_GROUP`` bytes and pages of ``PAGE_ROWS`` rows whose min and max stand in the
page index. A reader that wants a range of documents, or only lengths, skips the rest.

Files follow each other in doc_id order, so the offset of a document is the sum of the files before its own
plus a running sum inside its file; no task sees more than one file.

Encoding cuts texts where the tokenizer cuts them whatever stands around: at white space, and between known
characters (ASCII and the letters of Latin-1) of different kinds. Arrow numbers the distinct parts of some
megabytes of text, a worker encodes those that it has not met, and ids are gathered by number; the result is
the tokenizer's on the whole text. (Tokenizers with other rules than NFC, white space and lower case get whole
texts.) Defined cases: a null or empty text is the end id alone; rows with a null
doc_id come first; rows that share a doc_id follow each other in the order of their texts.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

END_ID = 2
ROW_GROUP, PAGE_ROWS = 16 << 20, 1000
#: Bytes of text encoded at a time, and parts and their ids that a worker remembers; beyond them it begins anew.
PORTION, CACHE, POOL, JOINED = 8 << 20, 1 << 20, 16 << 20, 200

_SPACE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _QUOTE
#: Whether a part ends between two kinds: digits stand alone, letters and marks in runs, but a quote may belong
#: to the letters after it ('s), and beside unknown characters nothing is certain.
_CUT = np.zeros((8, 8), bool)
_CUT[_SPACE] = _CUT[_DIGIT, :_OTHER] = _CUT[:_OTHER, _DIGIT] = True
_CUT[_LETTER, [_MARK, _QUOTE]] = _CUT[_MARK, _LETTER] = True
_LOWER = bytes(range(256)).lower()
_KINDS, _CUTS = _KIND.tobytes(), _CUT.tobytes().ljust(256, b"\0")


def _translated(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(data).translate(table), np.uint8)


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of concatenated texts whose ids follow each other: their bytes, the offsets of each, each text's first part.

    Parts of known characters alone are in lower case where they are ASCII; others stay as they are, as composing
    characters comes before lowering them. A word that may hold a special token is one part, unchanged.
    """
    kind = _translated(data, _KINDS)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.ones(len(data), bool)
    cut[1:] = _translated((kind[:-1] << 3) | kind[1:], _CUTS)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    solid = kind != _SPACE
    own = kind == _OTHER
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(special):
        edge = ~solid
        edge[1:] |= edge[:-1]
        edge[0] = True
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        word = np.cumsum(edge)
        marked = np.zeros(word[-1] + 1, bool)
        marked[word[special]] = True
        raw = marked[word]
        cut &= edge | ~raw
        own |= raw
    cut &= solid
    first = np.cumsum([0] + [np.count_nonzero(cut[a:b]) for a, b in zip(offsets, offsets[1:])])
    body = data[solid]
    begin = np.flatnonzero(cut[solid])
    low = _translated(body, _LOWER)
    if own.any():
        keep = np.repeat(np.logical_or.reduceat(own[solid], begin), np.diff(begin, append=len(body)))
        low[keep] = body[keep]
    return low, np.append(begin, len(body)), first


class Encoder:
    """A tokenizer with the ids of the parts that it has met, in one array."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(common.vocabulary(name))
        made = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        self.by_parts = steps == ["NFC", "Replace", "Lowercase"] and bool(made["model"].get("end_of_word_suffix"))
        if self.by_parts:
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for t, i in made["model"]["vocab"].items() if t.endswith(made["model"]["end_of_word_suffix"])]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.begin, self.n = (np.zeros(0, np.int32) for _ in range(3))

    def learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for w in new:  # runs of Latin-1 letters are one word each, so its last token is the one that ends a word
            t = w.decode()
            (plain if t.isalpha() and max(t) < "\u0100" else other).append(t)
        joined = [" ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(joined + other, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        n = np.fromiter(map(len, found), np.int32, len(found))
        words = int(n[: len(joined)].sum())
        last = np.flatnonzero(self.closing[flat[:words]]) + 1
        assert len(last) == len(plain)
        n = np.concatenate((np.diff(last, prepend=0), n[len(joined) :])).astype(np.int32)
        self.begin = np.append(self.begin, len(self.pool) + np.cumsum(n, dtype=np.int32) - n)
        self.n = np.append(self.n, n)
        self.pool = np.append(self.pool, flat)
        self.known.update(zip((t.encode() for t in chain(plain, other)), range(len(self.known), len(self.known) + len(new))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each."""
        if len(self.known) > CACHE or len(self.pool) > POOL:
            self.forget()
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if not self.by_parts:
            found = self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])], add_special_tokens=False)
            ids = [np.array(e.ids, np.int32) for e in found]
            return np.concatenate(ids), np.cumsum([0] + [len(x) for x in ids])
        body, at, first = parts(data, offsets)
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        own = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        begin, n = self.begin[own], self.n[own]
        which = coded.indices.to_numpy()
        n = n[which]
        end = np.cumsum(n, dtype=np.int32)
        at = np.repeat(begin[which] - (end - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at], np.concatenate(([0], end))[first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encode_texts(texts: list[str], name: str) -> list[list[int]]:
    """Token ids of each text, without special tokens added."""
    plain = [t.encode() for t in texts]
    flat, at = encoder(name).encode(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0] + [len(p) for p in plain]))
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


_TOKENS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(name), 0
        for batch in common.joined(batches, PORTION):
            for rows, data, offsets in common.text_slices(batch, size=PORTION):
                flat, at = own.encode(data, offsets)
                closed = at + np.arange(len(at))  # every text gets one id more
                ids = np.full(closed[-1], end_id, np.int32)
                inner = np.ones(len(ids), bool)
                inner[closed[1:] - 1] = False
                ids[inner] = flat
                lists = pa.ListArray.from_arrays(pa.array(closed, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.arange(row, row + len(at) - 1)), pa.array(np.diff(closed)), lists], schema=_TOKENS)
                row += len(at) - 1

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, row_group: int = ROW_GROUP, page_rows: int = PAGE_ROWS) -> None:
    """Write doc_id, row (number in the file), n_tokens and ids of every row of docs in ascending doc_id order.

    docs needs doc_id and text; tokenizer is a name of the public vocabularies, or a path that every executor has.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(common.shuffle_partitions(spark, docs), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, end_id), "doc_id bigint, row bigint, n_tokens bigint, ids array<int>")
        .write.option("parquet.block.size", row_group)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
        .parquet(out)
    )


def read_tokens(spark, path: str) -> DataFrame:
    """The table at path with file, the name of each row's file; names ascend as doc_ids do."""
    stored = spark.read.schema("doc_id bigint, row bigint, n_tokens bigint, ids array<int>").parquet(path)
    return stored.withColumn("file", F.col("_metadata.file_name"))


def offsets(stored: DataFrame, *columns: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and further columns of stored."""
    files = stored.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", *columns)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.diff(at).astype(np.int64)), batch.column("file"), pa.array(crc, pa.int64())], names=["doc_id", "row", "n_tokens", "file", "ids_crc32"])


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, row, n_tokens (counted), file and ids_crc32 from the ids that the files hold."""
    common.prepare(stored.sparkSession)
    return stored.select("doc_id", "row", "ids", "file").mapInArrow(_sum, "doc_id bigint, row bigint, n_tokens bigint, file string, ids_crc32 bigint")
