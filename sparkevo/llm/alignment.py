"""Cross-tokenizer alignment: groups between common token ends, and how often token pairs are linked in the corpus.

A (a ``tokenizers`` file with byte-level pieces) reads a space and the text, B (a SentencePiece model that adds the
space) the text, so both cut the same bytes. Every task runs an Arrow pipeline over some megabytes of documents: token
lists are flattened, with the parent index of each token; byte lengths are summed up per document; an Acero hash join on
(document, end) finds the ends that both have, which cut the tokens into groups; pairs of a group are counted per
document, then documents per pair, by ``Table.group_by``.

Partial counts of a portion of documents are what is shuffled: one row a pair and portion, merged by Spark, so that a
frequent pair is one row a portion. Merged counts, and whether they are the greatest of their A id, return to the pairs
of the portions by a join, and a portion's documents, which were kept as lists of its pairs, meet them in one task: no
table of all pairs is broadcast, and no text is shuffled or tokenized twice.

Texts are tokenized by distinct words: both cut before a single space that a safe character follows, whatever stands
around, so a worker encodes each word that it has not met once; ids are those of the whole text.

Defined cases: documents whose text is null or empty, or whose joined bytes of A or B differ from space and text, have
no tokens: all columns are 0 and groups_sha256 is the empty string; an id without links is no document's; rows that
share a doc_id are documents of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text in one run of the pipeline, and in a portion; words remembered, and new ones encoded together.
SLICE, PORTION, CACHE, POOL, JOINED = 2 << 20, 32 << 20, 1 << 19, 4 << 20, 256
#: Pairs in one row of the portions' counts, and pairs of a large group expanded at once.
ROW_PAIRS, EXPANDED = 1 << 16, 1 << 22

_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xE1] = _AFTER[0xE4:0xF5] = True  # characters that begin with these bytes are no white space


def byte_pieces() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """A tokenizer: `encode` texts to ids, and the bytes of each id."""

    def __init__(self, name: str) -> None:
        path = common.vocabulary(name)
        self.pieces_model = path.endswith(".model")
        if self.pieces_model:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes = [self._piece(i) for i in range(self.model.get_piece_size())]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            byte = byte_pieces()
            vocab = json.loads(self.model.to_str())["model"]["vocab"]
            self.bytes = [b""] * self.model.get_vocab_size()
            for piece, i in vocab.items():
                self.bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int32)

    def _piece(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[1:-1], 16)])
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        if self.pieces_model:
            return self.model.encode([t[1:] for t in texts], num_threads=1)
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def told(self, runs: list[list[bytes]]) -> list[np.ndarray | None]:
        """Ids of each word of runs that may be read together; None where their bytes are not the word's."""
        out: list[np.ndarray | None] = []
        texts = [b"".join(own) for own in runs]
        for own, text, ids in zip(runs, texts, self.encode([t.decode() for t in texts])):
            if b"".join(map(self.bytes.__getitem__, ids)) == text:
                flat = np.array(ids, np.int32)
                cuts = np.searchsorted(np.cumsum(self.length[flat]), np.cumsum([len(w) for w in own]))
                out += np.split(flat, cuts[:-1] + 1)
            else:  # some word is read as other bytes
                for w, ids in zip(own, self.encode([w.decode() for w in own])):
                    out.append(np.array(ids, np.int32) if b"".join(map(self.bytes.__getitem__, ids)) == w else None)
        return out


class Encoder:
    """Both tokenizers, with the ids of the words that they have met."""

    def __init__(self, a: str, b: str) -> None:
        self.sides = _Side(a), _Side(b)
        self.forget()
        # Decimal ids with the mark that follows them in a document's groups.
        texts = [f"{i}{mark}" for side, marks in zip(self.sides, (",|", ",;")) for mark in marks for i in range(len(side.bytes))]
        self.decimal, self.base = pa.array(texts, pa.large_binary()), np.cumsum([0] + [len(s.bytes) for s in self.sides for _ in (0, 1)])

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.wrong = np.zeros(0, bool)
        self.pool = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.begin = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def learn(self, new: list[bytes]) -> None:
        plain, alone = [], []
        for w in new:  # the first and last word of a text may begin or end as no cut does
            (plain if len(w) > 1 and _AFTER[w[1]] and w[-1] != 32 else alone).append(w)
        runs = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)] + [[w] for w in alone]
        new = plain + alone
        told = [side.told(runs) for side in self.sides]
        wrong = np.array([a is None or b is None for a, b in zip(*told)], bool)
        self.wrong = np.append(self.wrong, wrong)
        empty = np.zeros(0, np.int32)
        for k in (0, 1):
            ids = [empty if bad else x for bad, x in zip(wrong, told[k])]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin[k] = np.append(self.begin[k], len(self.pool[k]) + np.cumsum(n) - n)
            self.n[k] = np.append(self.n[k], n)
            self.pool[k] = np.concatenate([self.pool[k], *ids])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def lists(self, data: np.ndarray, offsets: np.ndarray, none: np.ndarray) -> tuple[list[pa.ListArray], np.ndarray]:
        """Token lists of both sides of concatenated texts, each with its space, and which texts have tokens."""
        if len(self.known) > CACHE or max(map(len, self.pool)) > POOL:
            self.forget()
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & _AFTER[data[2:]]
        cut[offsets[:-1]] = True
        at = np.append(np.flatnonzero(cut), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.known])
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        which = own[words.indices.to_numpy()]
        first = np.searchsorted(at, offsets)
        wrong = np.concatenate(([0], np.cumsum(self.wrong[which])))
        told = (wrong[first[1:]] == wrong[first[:-1]]) & ~none
        which = which[np.repeat(told, np.diff(first))]
        first = np.concatenate(([0], np.cumsum(np.where(told, np.diff(first), 0))))
        out = []
        for k in (0, 1):
            n = self.n[k][which]
            end = np.concatenate(([0], np.cumsum(n)))
            flat = self.pool[k][np.repeat(self.begin[k][which] - end[:-1], n) + np.arange(end[-1])]
            out.append(pa.ListArray.from_arrays(pa.array(end[first], pa.int32()), pa.array(flat, pa.int32())))
        return out, told


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(a: str, b: str) -> Encoder:
    if (a, b) not in _ENCODERS:
        _ENCODERS[a, b] = Encoder(a, b)
    return _ENCODERS[a, b]


def _ends(lists: pa.ListArray, length: np.ndarray, name: str) -> pa.Table:
    """document, end (in bytes of the document) and number of every token."""
    document = pc.list_parent_indices(lists)
    run = pc.cumulative_sum(pa.array(length).take(pc.list_flatten(lists)).cast(pa.int64()))
    starts = lists.offsets.to_numpy()[:-1]
    before = np.concatenate(([0], run.to_numpy()))[starts]  # what the documents before a list sum up to
    end = pc.subtract(run, pa.array(before).take(document))
    return pa.table({"document": document, "end": end, name: pa.array(np.arange(len(run), dtype=np.int64))})


def groups(a: pa.ListArray, b: pa.ListArray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One past the last A and the last B token of every group, in order."""
    both = _ends(a, length_a, "a").join(_ends(b, length_b, "b"), ["document", "end"], join_type="inner", use_threads=False)
    at, to = (np.sort(both.column(n).to_numpy()) + 1 for n in "ab")  # ends of a document rise on both sides
    return at, to


def _counted(document: np.ndarray, pair: np.ndarray, links: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """document, pair and links of every distinct (document, pair), by Table.group_by."""
    t = pa.table({"document": document, "pair": pair} | ({} if links is None else {"links": links}))
    n = "pair_count" if links is None else "links_sum"
    t = t.group_by(["document", "pair"], use_threads=False).aggregate([("pair", "count") if links is None else ("links", "sum")])
    return tuple(t.column(c).to_numpy() for c in ("document", "pair", n))


def linked(flat: list[np.ndarray], ends: tuple[np.ndarray, np.ndarray], document: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """document, pair (a * width + b) and links of every distinct pair that a document links; document is that of each group.

    Groups of many pairs are first reduced to their distinct ids.
    """
    begin = [np.concatenate(([0], e[:-1])) for e in ends]
    n = [e - s for e, s in zip(ends, begin)]
    size = n[0] * n[1]
    large = np.flatnonzero(size > 4096)
    found = []
    for g in large:
        (ua, ca), (ub, cb) = (np.unique(f[s[g] : e[g]], return_counts=True) for f, s, e in zip(flat, begin, ends))
        step = max(1, EXPANDED // len(ub))
        for i in range(0, len(ua), step):
            pair = (ua[i : i + step, None].astype(np.int64) * width + ub).ravel()
            found.append((np.full(len(pair), document[g]), pair, np.outer(ca[i : i + step], cb).ravel().astype(np.int64)))
    small = np.where(size > 4096, 0, 1)
    group = np.repeat(np.arange(len(size)), n[0] * small)
    one = np.arange(len(group)) - np.repeat(np.cumsum(n[0] * small) - n[0] * small, n[0] * small) + begin[0][group]
    times = n[1][group]
    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[1][group], times)
    pair = np.repeat(flat[0][one].astype(np.int64) * width, times) + flat[1][other]
    own = _counted(np.repeat(document[group], times), pair, None)
    if not found:
        return own
    whole = [np.concatenate([x, *(f[i] for f in found)]) for i, x in enumerate(own)]
    return _counted(*whole)


def texts_of_groups(flat: list[np.ndarray], ends: tuple[np.ndarray, np.ndarray], base: np.ndarray, decimal: pa.Array) -> tuple[memoryview, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups in a row, and one past the last byte of each group."""
    n = [np.diff(e, prepend=0) for e in ends]
    which = np.empty(len(flat[0]) + len(flat[1]), np.int64)
    begin = np.cumsum(n[0] + n[1]) - n[0] - n[1]
    for k, shift in ((0, begin - (ends[0] - n[0])), (1, begin + n[0] - (ends[1] - n[1]))):
        place = np.arange(len(flat[k])) + np.repeat(shift, n[k])
        which[place] = flat[k] + base[2 * k]
        which[place[ends[k] - 1]] += base[2 * k + 1] - base[2 * k]
    said = decimal.take(pa.array(which))
    offsets = np.frombuffer(said.buffers()[1], np.int64)
    return memoryview(said.buffers()[2] or b""), offsets[np.cumsum(n[0] + n[1])]


_PORTION = "portion bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, links binary, at int, a array<int>, b array<int>, docs array<bigint>"
_NAMES = [c.split()[0] for c in _PORTION.split(", ")]


class _Portion:
    """Documents so far, with their pairs by number in the slice that held them, and the pairs of each slice."""

    def __init__(self, number: int, width: int) -> None:
        self.number, self.width, self.size, self.rows, self.keys, self.counts = number, width, 0, [], [], []

    def add(self, own: Encoder, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        a, b = own.sides
        lists, _ = own.lists(data, offsets, rows.column("none").to_numpy(zero_copy_only=False))
        flat = [x.flatten().to_numpy() for x in lists]
        ends = groups(*lists, a.length, b.length)
        tokens = [x.offsets.to_numpy() for x in lists]
        per = np.searchsorted(ends[0], tokens[0], "right")  # groups up to each document
        n_groups = np.diff(per)
        document = np.repeat(np.arange(len(rows)), n_groups)
        sizes = np.concatenate(([0], np.cumsum(np.diff(ends[0], prepend=0) * np.diff(ends[1], prepend=0))))
        told, byte = texts_of_groups(flat, ends, own.base, own.decimal)
        byte = np.concatenate(([0], byte))[per]
        of, pair, links = linked(flat, ends, document, len(b.bytes))
        order = np.lexsort((pair, of))
        of, pair, links = of[order], pair[order], links[order]
        t = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
        key, count = t.column("pair").to_numpy(), t.column("pair_count").to_numpy()
        order = np.argsort(key)
        key, count = key[order], count[order]
        at = np.searchsorted(of, np.arange(len(rows) + 1))
        number = np.searchsorted(key, pair).astype(np.int32)
        for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
            said = hashlib.sha256(told[byte[i] : byte[i + 1] - 1]).hexdigest() if n_groups[i] else ""
            mine = slice(at[i], at[i + 1])
            totals = tokens[0][i + 1] - tokens[0][i], tokens[1][i + 1] - tokens[1][i], n_groups[i], sizes[per[i + 1]] - sizes[per[i]]
            self.rows.append((len(self.keys), doc_id, *map(int, totals), said, number[mine], _sparse(links[mine])))
        self.keys.append(key)
        self.counts.append(count)
        self.size += len(data)
        pa.default_memory_pool().release_unused()

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The documents with their pairs by number in the portion, then the portion's pairs."""
        key, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([np.zeros(0), *self.counts]), len(key)).astype(np.int64)
        place = np.split(inverse.astype(np.int32), np.cumsum([len(k) for k in self.keys])[:-1])
        for i in range(0, len(self.rows), common.ARROW_ROWS):
            part, columns = self.rows[i : i + common.ARROW_ROWS], {}
            for c, name in enumerate(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), 1):
                columns[name] = [r[c] for r in part]
            columns["pairs"] = [common.pack(np.diff(place[r[0]][r[7]], prepend=0).astype(np.int32)) if len(r[7]) else b"" for r in part]
            # how often a document links each of its pairs: mostly once, so only the others are listed
            columns["links"] = [r[8] for r in part]
            yield self._batch(columns, len(part))
        for i in range(0, len(key), ROW_PAIRS):
            own = key[i : i + ROW_PAIRS]
            yield self._batch({"at": [i], "a": [(own // self.width).astype(np.int32)], "b": [(own % self.width).astype(np.int32)], "docs": [count[i : i + ROW_PAIRS]]}, 1)

    def _batch(self, columns: dict[str, list], n: int) -> pa.RecordBatch:
        types = {"groups_sha256": pa.string(), "pairs": pa.binary(), "links": pa.binary(), "at": pa.int32(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "docs": pa.list_(pa.int64())}
        columns = {"portion": [self.number] * n} | columns
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), types.get(c, pa.int64())) for c in _NAMES], names=_NAMES)


def _sparse(links: np.ndarray) -> bytes:
    more = np.flatnonzero(links > 1)
    return common.pack(np.concatenate((more, links[more])).astype(np.int64)) if len(more) else b""


def _dense(b: bytes, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    if b:
        more, links = np.split(common.unpack(b, np.int64), 2)
        out[more] = links
    return out


def _align(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = encoder(a, b), TaskContext.get().partitionId() << 32
        width = len(own.sides[1].bytes)
        portion = _Portion(number, width)
        for batch in common.joined(batches, SLICE):
            for rows, data, offsets in common.text_slices(batch, size=SLICE):
                portion.add(own, rows, data, offsets)
                if portion.size >= PORTION:
                    yield from portion.batches()
                    number += 1
                    portion = _Portion(number, width)
        if portion.rows:
            yield from portion.batches()

    return run


def _judge(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of one portion, from the merged counts of its pairs."""
    at = pairs.column("at").to_numpy()
    count, best = (np.zeros(len(at), np.int64) for _ in (0, 1))
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for packed, links in zip(documents.column("pairs").to_pylist(), documents.column("links").to_pylist()):
        own = np.cumsum(common.unpack(packed, np.int32))
        times = _dense(links, len(own))
        sums.append(int(count[own] @ times))
        bests.append(int(best[own] @ times))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.table([*(documents.column(c) for c in names), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*names, "n_best", "count_sum"])


def _partial(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Documents and pairs of all portions, kept in the shared folder."""
    common.prepare(docs.sparkSession)
    none = F.coalesce(F.octet_length("text"), F.lit(0)) == 0
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.concat(F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"), none.alias("none"))
    return common.saved(own.mapInArrow(_align(a, b), _PORTION), "portions")


def _pairs(partial: DataFrame) -> DataFrame:
    """portion, at, a, b and docs of every pair of every portion."""
    each = F.explode(F.arrays_zip(F.sequence(F.col("at"), F.col("at") + F.size("a") - 1).alias("at"), "a", "b", "docs"))
    return partial.filter(F.col("a").isNotNull()).select("portion", each.alias("p")).select("portion", "p.at", "p.a", "p.b", "p.docs")


def _merged(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that link them) and best (the greatest of the A id)."""
    totals = common.saved(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
    most = totals.groupBy("a").agg(F.max("count").alias("most"))
    return totals.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, count and best of every pair of token ids that some document links: a vocabulary map from A to B."""
    return _merged(_pairs(_partial(docs, a, b)))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    a is a byte-level vocabulary of the tokenizers library, b a SentencePiece model: names of public ones, or paths.
    """
    partial = _partial(docs, a, b)
    pairs = _pairs(partial)
    judged = pairs.join(_merged(pairs), ["a", "b"]).select(F.col("portion").alias("of_pair"), "at", "count", "best")
    documents = partial.filter(F.col("a").isNull())
    documents = documents.select(F.col("portion").alias("of_document"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    n = common.shuffle_partitions(docs.sparkSession, docs)
    if n > common.shuffle_partitions(docs.sparkSession):  # a task is meant for a portion or two, however many there are
        documents, judged = documents.repartition(n, "of_document"), judged.repartition(n, "of_pair")
    out = documents.groupBy("of_document").cogroup(judged.groupBy("of_pair")).applyInArrow(_judge, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
