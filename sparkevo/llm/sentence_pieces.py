"""SentencePiece encoding and decoding: the segmentation of greatest total score, by a max-plus scan.

A text, with one space put in front, is cut into vocabulary pieces so that the sum of their scores is greatest;
characters that no piece has score 10 less than the worst piece and are written as bytes. Among cuts of equal
score each piece, from the end, begins as early as it can. This reads a model as a unigram model whatever it
was trained as, so for a BPE model ids differ from the merges of the library while decoding gives the same
text. All scores of the public models are whole numbers, so sums are exact at any length.

Most texts are cut at words, which no piece spans, and the best cuts of words are remembered. (The library's own
search is not used: read as unigram, it misses the best cut of about one word in 200.) Giant texts are split into
chunks of fixed length, in parallel: (1) every chunk yields its transfer matrix, best score by entry and exit state,
where a state is how far a piece reaches over the boundary; (2) a scan of the matrices in max-plus algebra gives the
scores at each boundary: products of ``RADIX`` neighbours are formed level by level up, and states go level by level
down, so no task holds more than RADIX items of a text; (3) every chunk keeps its back steps and its map of exit to
entry states; (4) a scan of the maps from the end gives each chunk's exit; (5) every chunk is traced back on its own.

Decoding is exact: spaces, U+2581, control characters and the empty text come back as they were. Defined
cases: a null text has null ids; rows that repeat a doc_id and text give a row each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters beyond which a text is giant, and of a chunk of one.
GIANT, CHUNK = 49_152, 8_192
#: Neighbours that a step of a scan brings together.
RADIX = 8
#: Words that a worker remembers at most.
CACHE = 500_000
_NONE = -(1 << 62)
_MODELS: dict[str, Model] = {}


class _Cuts(dict):
    """Best cuts of words, as bytes of 32-bit ids, remembered up to CACHE words."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.model.cut(word)).tobytes()
        if len(self) < CACHE and len(word) < 100:
            self[word] = ids
        return ids


class Model:
    """Pieces of a model file, and best cuts of strings."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        with open(common.vocabulary(path), "rb") as f:
            raw = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = self.lib.vocab_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        text = {i: self.lib.id_to_piece(i).replace("▁", " ") for i in plain}
        self.ids = {t: i for i, t in text.items()}
        self.score = {t: round(self.lib.get_score(i)) for t, i in self.ids.items()}
        self.reach = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - 10
        self.single = {t for t in self.ids if len(t) == 1}
        self.byte = {int(self.lib.id_to_piece(i)[3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.bytes = [b""] * n
        for t, i in self.ids.items():
            self.bytes[i] = t.encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.find = ahocorasick.Automaton()
        for t in self.ids:
            self.find.add_word(t, (len(t), self.score[t], self.ids[t]))
        self.find.make_automaton()
        # No piece has a space after another character, or a line end beside one: texts may be cut there.
        assert not any(" " in t.lstrip(" ") or ("\n" in t and len(t) > 1) for t in self.ids), "pieces span words"
        letter = "[a-z\u00df-\u00f6\u00f8-\u00ff]"
        stops = any(re.search(f"{letter}[.,]", t) for t in self.ids)  # else texts may be cut before such a mark too
        self.words = re.compile(" +[^ \n]*|\n|[^ \n]+" if stops else f" *(?:[^ \n.,]*{letter}(?=[.,])|[^ \n]+)|\n| +")
        self.known = _Cuts(self)
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def matches(self, s: str, own: int) -> list[tuple[int, int, int]]:
        """(end, begin, score) of pieces and unknown characters in s that begin before own, by end, then begin."""
        found = [(end + 1, end + 1 - n, score) for end, (n, score, _) in self.find.iter(s) if end + 1 - n < own]
        lone = [(i + 1, i, self.unknown) for i, c in enumerate(s[:own]) if c not in self.single]
        found += lone
        found.sort()
        return found

    def best(self, s: str, own: int, entry: np.ndarray | list[int]) -> tuple[list[int], bytearray]:
        """Best score to each place of s, from scores of the first places, and the length of the last piece (0: entry)."""
        score = [_NONE] * (len(s) + 1)
        back = bytearray(len(s) + 1)
        for i, v in enumerate(entry):
            if i <= len(s):
                score[i] = int(v)
        for end, begin, gain in self.matches(s, own):
            had = score[begin]
            if had > _NONE and had + gain > score[end]:
                score[end] = had + gain
                back[end] = end - begin
        return score, back

    def transfer(self, s: str, own: int) -> np.ndarray:
        """The matrix of best scores from entry state a (begin at place a) to exit state b (end at place own + b)."""
        r = self.reach
        out = np.full((r, r), _NONE, np.int64)
        found = self.matches(s, own)
        base = [_NONE] * (len(s) + r + 1)
        base[0] = 0
        for end, begin, gain in found:
            if base[begin] > _NONE and base[begin] + gain > base[end]:
                base[end] = base[begin] + gain
        out[0] = base[own : own + r]
        for a in range(1, min(r, own + 1)):
            # Once the difference to `base` holds at r places running, it holds for good.
            score = [_NONE] * (len(s) + r + 1)
            score[a] = 0
            last, same, shift = a, 0, None
            for end, begin, gain in found:
                if end != last:
                    now = score[last] - base[last] if score[last] > _NONE and base[last] > _NONE else None
                    same = same + 1 if now is not None and now == shift else 1
                    shift = now
                    last = end
                    if same > r and end < own:
                        break
                if score[begin] > _NONE and score[begin] + gain > score[end]:
                    score[end] = score[begin] + gain
            else:
                shift = None
            if shift is not None and same > r:
                out[a] = np.where(out[0] > _NONE, out[0] + shift, _NONE)
            else:
                out[a] = score[own : own + r]
        return out

    def trace(self, s: str, back: bytes, end: int) -> tuple[int, list[int]]:
        """Place of entry and ids of the pieces that lead to place end."""
        pieces = []
        while back[end]:
            pieces.append(s[end - back[end] : end])
            end -= back[end]
        ids: list[int] = []
        for t in reversed(pieces):
            i = self.ids.get(t)
            ids.extend([i] if i is not None else [self.byte[b] for b in t.encode()])
        return end, ids

    def cut(self, s: str) -> list[int]:
        """Ids of the best cut of s, alone."""
        if not self.single.issuperset(s):
            return self.trace(s, self.best(s, len(s), [0])[1], len(s))[1]
        score: list[int | None] = [None] * (len(s) + 1)
        back: list[tuple[int, int, int] | None] = [None] * (len(s) + 1)
        score[0] = 0
        for last, piece in self.find.iter(s):  # by end, the longest first
            had = score[last + 1 - piece[0]]
            if had is not None:
                had += piece[1]
                if score[last + 1] is None or had > score[last + 1]:
                    score[last + 1] = had
                    back[last + 1] = piece
        ids, end = [], len(s)
        while end:
            n, _, i = back[end]
            ids.append(i)
            end -= n
        ids.reverse()
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of text as 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.words.findall(" " + text))) if text else b""

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each."""
        parts = [self.encode_bytes(t) for t in texts]
        return np.frombuffer(b"".join(parts), np.int32), np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for."""
        n = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n)
        return self.flat[at + np.arange(len(at))].tobytes()[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, each of about SLICE_BYTES by weight(row)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > common.SLICE_BYTES:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held)))), schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held)))), schema=schema)


_IDS = "doc_id bigint, sha string, n_chunks bigint, ids array<int>"
_IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_chunks", pa.int64()), ("ids", pa.list_(pa.int32()))])
_CHUNKS = "sha string, no bigint, own int, body string, matrix binary"
_CHUNKS_SCHEMA = pa.schema([("sha", pa.string()), ("no", pa.int64()), ("own", pa.int32()), ("body", pa.string()), ("matrix", pa.binary())])
_ITEM_SCHEMA = pa.schema([("sha", pa.string()), ("no", pa.int64()), ("item", pa.binary())])
_STATE_SCHEMA = pa.schema([("sha", pa.string()), ("no", pa.int64()), ("state", pa.binary())])
_BACK_SCHEMA = pa.schema([("sha", pa.string()), ("no", pa.int64()), ("own", pa.int32()), ("body", pa.string()), ("back", pa.binary()), ("item", pa.binary())])
_PART_SCHEMA = pa.schema([("sha", pa.string()), ("no", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _lists(flat: np.ndarray, offsets: np.ndarray, null: list[bool]) -> pa.ListArray:
    """A list column; lists are null where told so."""
    marked = pa.array([None if gone else int(o) for o, gone in zip(offsets, [*null, False])], pa.int32())
    return pa.ListArray.from_arrays(marked, pa.array(flat, pa.int32()))


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for rows, _, _ in common.text_slices(batch):
                texts = rows.column("text").to_pylist()
                flat, offsets = own.encode_all([t or "" for t in texts])
                ids = _lists(flat, offsets, [t is None for t in texts])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("sha"), pa.array([0] * len(texts), pa.int64()), ids], schema=_IDS_SCHEMA)

    return run


def _split(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model(path).reach

        def rows():
            for b in batches:
                for sha, text in zip(b.column("sha").to_pylist(), b.column("text").to_pylist()):
                    s = " " + text
                    for no in range(-(-len(s) // chunk)):
                        at = no * chunk
                        yield sha, no, min(chunk, len(s) - at), s[at : at + chunk + reach - 1], None

        yield from _batches(rows(), _CHUNKS_SCHEMA, lambda r: 100 + len(r[3]))

    return run


def _transfer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        rows = ((r["sha"], r["no"], r["own"], r["body"], own.transfer(r["body"], r["own"]).tobytes()) for b in batches for r in b.to_pylist())
        yield from _batches(rows, _CHUNKS_SCHEMA, lambda r: 100 + len(r[3]) + len(r[4]))

    return run


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of a vector or matrix and a matrix."""
    return np.maximum((a[..., :, None] + b).max(-2), _NONE)


class Scores:
    """Vectors of scores and transfer matrices, from the start of a text."""

    def __init__(self, reach: int) -> None:
        self.reach, self.backwards = reach, False
        first = np.full(reach, _NONE, np.int64)
        first[0] = 0
        self.first = first.tobytes()

    def combine(self, a: bytes, b: bytes) -> bytes:
        """The state or the item that b makes of a."""
        left, right = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64).reshape(self.reach, self.reach)
        return times(left if len(left) == self.reach else left.reshape(self.reach, self.reach), right).tobytes()


class Exits:
    """Exit states and maps of exit to entry states (-1: none), from the end of a text."""

    def __init__(self, reach: int) -> None:
        self.backwards, self.first = True, np.zeros(1, np.int32).tobytes()

    def combine(self, a: bytes, b: bytes) -> bytes:
        at, entry = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
        return np.where(at < 0, -1, entry[at]).astype(np.int32).tobytes()


def _in_order(rows: pa.Table, backwards: bool) -> pa.Table:
    return rows.sort_by([("no", "descending" if backwards else "ascending")])


def _product(kind: type, path: str):
    def run(rows: pa.Table) -> pa.Table:
        """The item that the items of one block amount to."""
        own, total = kind(model(path).reach), None
        rows = _in_order(rows, own.backwards)
        for item in rows.column("item").to_pylist():
            total = item if total is None else own.combine(total, item)
        return pa.Table.from_pydict({"sha": rows.column("sha")[:1], "no": rows.column("block")[:1], "item": [total]}, schema=_ITEM_SCHEMA)

    return run


def _states(kind: type, path: str):
    def run(rows: pa.Table) -> pa.Table:
        """The state before each item of one block, from the state before the block (null: a text's first)."""
        own, out = kind(model(path).reach), []
        rows = _in_order(rows, own.backwards)
        state = rows.column("state")[0].as_py() or own.first
        for item in rows.column("item").to_pylist():
            out.append(state)
            state = own.combine(state, item)
        return pa.Table.from_pydict({"sha": rows.column("sha"), "no": rows.column("no"), "state": out}, schema=_STATE_SCHEMA)

    return run


def scan(items: DataFrame, kind: type, path: str, radix: int | None = None) -> DataFrame:
    """sha, no, state: what the items (sha, no, item) before each one in its text make of the first state."""
    radix = radix or RADIX
    block = F.floor(F.col("no") / radix)
    levels, n = [items.select("sha", "no", "item")], (items.agg(F.max("no")).first()[0] or 0) + 1
    while n > radix:
        up = levels[-1].withColumn("block", block).groupBy("sha", "block").applyInArrow(_product(kind, path), "sha string, no bigint, item binary")
        levels.append(common.saved(up, "scan"))
        n = -(-n // radix)
    states = None
    for level in reversed(levels):
        level = level.withColumn("block", block)
        before = level.withColumn("state", F.lit(None).cast("binary")) if states is None else level.join(states.withColumnRenamed("no", "block"), ["sha", "block"])
        states = before.groupBy("sha", "block").applyInArrow(_states(kind, path), "sha string, no bigint, state binary")
    return states


def _steps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    score, back = own.best(r["body"], r["own"], np.frombuffer(r["state"], np.int64))
                    ends = [own.trace(r["body"], back, r["own"] + x)[0] if r["own"] + x < len(score) and score[r["own"] + x] > _NONE // 2 else -1 for x in range(own.reach)]
                    yield r["sha"], r["no"], r["own"], r["body"], bytes(back), np.array(ends, np.int32).tobytes()

        yield from _batches(rows(), _BACK_SCHEMA, lambda r: 200 + 2 * len(r[3]))

    return run


def _traced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        rows = ((r["sha"], r["no"], own.trace(r["body"], r["back"], r["own"] + int(np.frombuffer(r["state"], np.int32)[0]))[1]) for b in batches for r in b.to_pylist())
        yield from _batches(rows, _PART_SCHEMA, lambda r: 100 + 4 * len(r[2]))

    return run


def _encode_giant(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    texts = docs.select("sha", "text")
    pieces = texts.mapInArrow(_split(path, chunk), _CHUNKS).drop("matrix")
    # Chunks of one text go to different tasks; equal texts share chunks, which are kept once.
    pieces = pieces.withColumn("matrix", F.lit(None).cast("binary")).repartition(common.shuffle_partitions(docs.sparkSession, docs), "sha", "no").dropDuplicates(["sha", "no"])
    chunks = common.saved(pieces.mapInArrow(_transfer(path), _CHUNKS), "chunks")
    entries = scan(chunks.select("sha", "no", F.col("matrix").alias("item")), Scores, path)
    steps = common.saved(
        chunks.drop("matrix").join(entries, ["sha", "no"]).select("sha", "no", "own", "body", "state").mapInArrow(_steps(path), "sha string, no bigint, own int, body string, back binary, item binary"),
        "steps",
    )
    exits = scan(steps.select("sha", "no", "item"), Exits, path)
    parts = steps.drop("item").join(exits, ["sha", "no"]).mapInArrow(_traced(path), "sha string, no bigint, ids array<int>")
    whole = parts.groupBy("sha").agg(F.count(F.lit(1)).alias("n_chunks"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda p: p["ids"])).alias("ids"))
    return docs.select("doc_id", "sha").join(whole, "sha").select("doc_id", "sha", "n_chunks", "ids")


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, sha (of the text), n_chunks (0 where a text was not split) and ids of every row of docs.

    docs needs doc_id and text; path is a name of the public vocabularies, or a model file that every executor has.
    """
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.sha2(F.col("text"), 256).alias("sha"))
    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))
    short = docs.filter(~is_giant).mapInArrow(_encode_short(path), _IDS)
    return short.unionByName(_encode_giant(docs.filter(is_giant), path, chunk))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            rest = b.drop_columns(["ids"])
            text = pa.array([None if x is None else own.decode_bytes(x).decode() for x in _id_arrays(b.column("ids"))], pa.string())
            yield pa.RecordBatch.from_arrays([*rest.columns, text], names=[*rest.schema.names, "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with text in place of ids."""
    common.prepare(encoded.sparkSession)
    rest = [f for f in encoded.schema.fields if f.name != "ids"]
    order = encoded.select(*[f.name for f in rest], "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string"
    return order.mapInArrow(_decode(path), schema)


def _id_arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if v else None for a, b, v in zip(at, at[1:], column.is_valid().to_pylist())]


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            ids = _id_arrays(b.column("ids"))
            crc = [None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            sha = [None if x is None else hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in ids]
            n = [None if x is None else len(x) for x in ids]
            same = [a == c for a, c in zip(sha, b.column("sha").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_chunks"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_chunks", "n_pieces", "ids_crc32", "decoded_sha256", "exact"],
            )

    return run


def round_trip(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chunks, n_pieces, ids_crc32, decoded_sha256 and exact: whether the decoded text is the encoded one."""
    return encoded.select("doc_id", "sha", "n_chunks", "ids").mapInArrow(_round_trip(path), "doc_id bigint, n_chunks bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean")
