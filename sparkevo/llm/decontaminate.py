"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items become sequences of words (runs of letters, digits and _, in lower case). A window of as many
words as an item has, or up to k more or fewer, contaminates a text if their edit distance in words is at most k,
which is ``RATE`` of the item's words.

The CGK embedding walks a sequence: output j is the word at the pointer, which then advances by a random bit
that depends on j and the word. Two sequences that an edit separates fall into step again soon, so a small
edit distance becomes a small Hamming distance. Each of ``ROUNDS`` independent walks is sampled at ``SAMPLES``
output places; a window and an item that agree at all places of any walk are candidates, and the edit distance
is then computed exactly. Copies always agree. The chance that a walk agrees falls with the number of edits
allowed, so ``plan`` tries the walks on made pairs at the limit and takes, for each length, fewer places and then
more sets of them until ``TARGET`` of the pairs of each kind of edit agree; where none does, every window is verified.

Candidates are windows of the item's length; from where they begin, the distance is the least over all ends.

Only windows near a shared run of words are embedded: n words with k edits keep a run of (n - k) / (k + 1)
words, so this leaves out no window within the limit.

A benchmark of at most ``BLOCK`` bytes is one index, broadcast; texts are then not shuffled. A larger one is cut into
blocks of about that size, and texts go to the blocks that they share a run of words with: a bitmap of all items' runs,
of ``MOST_BITS`` bits at most, is broadcast and tells the texts that may; their runs join those of the items by shuffle;
and tasks of a block and a portion of its texts build the block's index and stream the texts past it. The driver sees
the bitmap alone, texts are read as often for ten blocks as for two, and equal texts are looked at once. Defined cases: null and empty texts and items have no words and match nothing; items too short for an
edit match exactly, so an item of one word meets every text that has it; repeated rows give a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import common

RATE, LEAST = 0.15, 1
ROUNDS, SAMPLES, SEED = 16, 3, 42
#: Share of windows exactly at the limit that must become candidates, and the made pairs of each kind that it is measured on.
TARGET, TRIALS = 0.995, 300
BLOCK = 8 << 20
#: Bits a run of the items' bitmap, its bits at most and the bits looked up for each run; bytes of texts that one build of a block's index serves.
SEED_BITS, MOST_BITS, PROBES, PORTION = 16, 1 << 28, 5, 128 << 20
_OTHER = re.compile(r"\W+")


def _texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts and the index of each text's first word (one more entry than texts)."""
    plain = [_OTHER.sub(" ", (t or "").lower()).encode() for t in texts]
    offsets = np.cumsum([0] + [len(p) for p in plain])
    _, _, words, first = common.word_hashes(np.frombuffer(b"".join(plain), np.uint8), offsets)
    return words | np.uint64(1 << 63), first  # never 0, which stands for the end


def limit(n: int, rate: float = RATE) -> int:
    return int(rate * n + 1e-9)


def seed_run(n: int, most: int) -> int:
    """Words of a run that any window within the limit of an item of n words must share with it (five are enough)."""
    return min(5, (n - most) // (most + 1))


def cgk_keys(windows: np.ndarray, rounds: int = ROUNDS, samples: int = SAMPLES, seed: int = SEED, sets: int = 1) -> np.ndarray:
    """A key for each row of words, each round and each of its sets of samples: the hash of the outputs there of the round's walk."""
    rows, n = windows.shape
    out = np.zeros((rows, rounds * sets), np.uint64)
    padded = np.concatenate((windows, np.zeros((rows, 1), np.uint64)), axis=1)
    every = np.arange(rows)
    for r in range(rounds):
        random = np.random.default_rng((seed, r))  # the same walks at every length, so that a plan holds for those near it
        taken = (random.random((sets, samples)) * 2 * n).astype(np.int64)  # a walk is past its n-th word after about 2n steps
        bits = random.integers(0, 2**63, 2 * n + 1, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        at = np.zeros(rows, np.int64)
        step = 0
        for place in np.argsort(taken, axis=None, kind="stable"):
            while step < taken.flat[place]:
                word = padded[every, at]
                at = np.minimum(at + (common.mix(word * bits[step]) >> np.uint64(63)).astype(np.int64), n)
                step += 1
            own = r * sets + place // samples
            out[:, own] = common.mix(out[:, own] * np.uint64(31) + padded[every, at], int(own))
    return out


def made_pairs(n: int, k: int, trials: int = TRIALS, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray]]:
    """Items of n different words, and for each kind of edit (substituted, deleted, inserted, mixed) windows k edits away."""
    random = np.random.default_rng((seed, n, k))
    items = random.integers(1, 2**63, (trials, n), dtype=np.int64).astype(np.uint64)
    kinds = []
    for weights in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)):
        windows = random.integers(1, 2**63, (trials, n), dtype=np.int64).astype(np.uint64)  # what follows is other text
        for row, item in zip(windows, items):
            kind = np.zeros(n, np.int64)
            kind[random.choice(n, k, replace=False)] = 1 + random.choice(3, k, p=np.array(weights) / sum(weights))
            new = np.repeat(item, np.array([1, 1, 0, 2])[kind])
            first = np.cumsum(np.array([1, 1, 0, 2])[kind]) - np.array([1, 1, 0, 2])[kind]
            changed = first[(kind == 1) | (kind == 3)]
            new[changed] = random.integers(1, 2**63, len(changed), dtype=np.int64).astype(np.uint64)
            row[: len(new)] = new[:n]
        kinds.append(windows)
    return items, kinds


@lru_cache(maxsize=4096)
def _planned(n: int, k: int, rounds: int, samples: int, seed: int) -> tuple[int, int]:
    items, kinds = made_pairs(n, k, seed=seed)
    for places, sets in [(p, 1) for p in range(samples, 0, -1)] + [(1, 1 << i) for i in range(1, 8)]:
        keys = cgk_keys(np.concatenate([items, *kinds]), rounds, places, seed, sets).reshape(len(kinds) + 1, len(items), -1)
        if ((keys[1:] == keys[0]).any(axis=2).mean(axis=1) >= TARGET).all():
            return places, sets
    return 0, 0


def plan(n: int, rate: float = RATE, rounds: int = ROUNDS, samples: int = SAMPLES, seed: int = SEED) -> tuple[int, int]:
    """Places (at most samples) and sets of them a walk with which TARGET of windows at the limit agree; (0, 0) if none do.

    Tried at the next of a few lengths, which allows at least as many edits.
    """
    if not limit(n, rate):
        return samples, 1
    step = 20 * common.power_of_two(n / 160)
    up = -(-n // step) * step
    return _planned(up, max(limit(up, rate), limit(n, rate)), rounds, samples, seed)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = [j if j <= most else most + 1 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, most + 1)
        row = new
        if min(row) > most:
            return most + 1
    return row[len(b)]


def free_end_distances(windows: np.ndarray, items: np.ndarray, most: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of items: its least edit distance to a beginning of the row of windows, and that beginning's words.

    Rows of windows have most more words than those of items; only beginnings of at most room words, and of at most
    most words more or fewer than the item, count. A distance over most may be any number over it. Ties go to the
    length nearest to the item's, then to the shorter.
    """
    rows, n = items.shape
    shift = np.arange(-most, most + 1)
    far = np.int32(n + 2 * most + 2)
    padded = np.concatenate((np.zeros((rows, most + 1), np.uint64), windows), axis=1)
    d = np.broadcast_to(np.where(shift >= 0, shift, far).astype(np.int32), (rows, len(shift))).copy()
    end = np.full((rows, 1), far)
    for i in range(1, n + 1):
        at = i + shift  # words of the window so far
        through = d + (padded[:, i : i + len(shift)] != items[:, i - 1 : i])
        through[:, at <= 0] = far
        d = np.minimum(through, np.concatenate((d[:, 1:], end), axis=1) + 1)
        d[:, at < 0] = far
        d = (np.minimum.accumulate(d - shift, axis=1) + shift).astype(np.int32)
    d[n + shift > room[:, None]] = far
    order = np.argsort(np.abs(shift), kind="stable")
    best = order[np.argmin(d[:, order], axis=1)]
    return d[np.arange(rows), best], n + shift[best]


class Index:
    """Items' words, seeds (runs of words with their places) and keys; bounded by the block of items it is made of."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float, rounds: int, samples: int, seed: int) -> None:
        words, first = _texts([t for _, t in items])
        self.rate, self.rounds, self.plans, self.seed = rate, rounds, {}, seed
        self.ids = [i for i, _ in items]
        self.words = [words[a:b] for a, b in zip(first, first[1:])]
        self.most = np.array([limit(len(w), rate) for w in self.words], np.int64)
        size = np.array([len(w) for w in self.words], np.int64)
        self.size = size
        by_run: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(self.words):
            if len(w) >= LEAST:
                run = seed_run(len(w), int(self.most[k]))
                h = common.rolling(w, run, "window")
                by_run.setdefault(run, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.seeds = {}
        for run, found in by_run.items():
            h, item, place = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            quick = np.zeros(1 << 20, bool)
            quick[h >> np.uint64(44)] = True
            self.seeds[run] = h[order], item[order], place[order], quick
        self.keys, self.matrix = {}, {}
        for n in sorted({int(s) for s in size if s >= LEAST}):
            own = np.flatnonzero(size == n)
            self.plans[n] = plan(n, rate, rounds, samples, seed)
            places, sets = self.plans[n]
            self.matrix[n] = np.stack([self.words[k] for k in own])
            self.keys[n] = own, cgk_keys(self.matrix[n], rounds, places, seed, sets)

    def near(self, words: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By size: places in words where windows begin that share a seed with an item of that size, and the item."""
        found: dict[int, list[np.ndarray]] = {}
        for run, (seeds, item, place, quick) in self.seeds.items():
            h = common.rolling(words, run, "window")
            at = np.flatnonzero(quick[h >> np.uint64(44)])
            lo, hi = np.searchsorted(seeds, h[at], "left"), np.searchsorted(seeds, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            row = np.searchsorted(first, at, "right") - 1
            whole = at + run <= first[row + 1]
            at, which, row = at[whole], which[whole], row[whole]
            base, k = at - place[which], item[which]
            for d in range(-int(self.most[k].max(initial=0)), int(self.most[k].max(initial=0)) + 1):
                begin = base + d
                good = (abs(d) <= self.most[k]) & (begin >= first[row]) & (begin + self.size[k] - self.most[k] <= first[row + 1])
                for s in np.unique(self.size[k[good]]):
                    own = good & (self.size[k] == s)
                    found.setdefault(int(s), []).append(begin[own] * len(self.ids) + k[own])
        return {s: np.divmod(np.unique(np.concatenate(b)), len(self.ids)) for s, b in found.items()}

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) -> (distance, first word, words) of its best window within the limit."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, (begins, items) in self.near(words, first).items():
            most = limit(n, self.rate)
            own, keys = self.keys[n]
            places, sets = self.plans[n]
            step = max(1, (1 << 21) // (n + most))
            for a in range(0, len(begins), step):
                begin, item = begins[a : a + step], items[a : a + step]
                row = np.searchsorted(first, begin, "right") - 1
                room = first[row + 1] - begin
                ahead = np.arange(n + most)
                windows = np.where(ahead < room[:, None], words[np.minimum(begin[:, None] + ahead, len(words) - 1)], np.uint64(0))
                if most and sets:
                    once, back = np.unique(begin, return_index=True, return_inverse=True)[1:]
                    got = cgk_keys(windows[once, :n], self.rounds, places, self.seed, sets)
                    held = np.searchsorted(own, item)
                    alike = np.zeros(len(begin), bool)
                    for r in range(got.shape[1]):
                        alike |= got[back, r] == keys[held, r]
                    windows, begin, item, row, room = (x[alike] for x in (windows, begin, item, row, room))
                for b in range(0, len(begin), 2048):
                    part = slice(b, b + 2048)
                    d, length = free_end_distances(windows[part], self.matrix[n][np.searchsorted(own, item[part])], most, room[part])
                    good = np.flatnonzero(d <= most)
                    r, k, start = row[part][good], item[part][good], begin[part][good] - first[row[part][good]]
                    order = np.lexsort((start, d[good], k, r))
                    new = np.ones(len(order), bool)
                    new[1:] = (np.diff(r[order]) != 0) | (np.diff(k[order]) != 0)
                    for i in order[new]:
                        key, value = (int(r[i]), int(k[i])), (int(d[good[i]]), int(start[i]), int(length[good[i]]))
                        out[key] = min(out.get(key, value), value)
        return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())])


def _find(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            out = []
            for rows, lo in _portions(batch.column("text").to_pylist()):
                words, first = _texts(rows)
                for (row, k), (d, at, length) in sorted(index.matches(words, first).items()):
                    out.append((doc[lo + row], index.ids[k], at, length, d))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(_FOUND.names, map(list, zip(*out)))), schema=_FOUND)

    return run


def _portions(texts: list[str | None]) -> Iterator[tuple[list[str | None], int]]:
    """Runs of texts of about SLICE_BYTES characters, with the place of the first."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= common.SLICE_BYTES or i == len(texts) - 1:
            yield texts[lo : i + 1], lo
            lo, size = i + 1, 0


def _size(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0


def _index(benchmark: DataFrame, rate: float, rounds: int, samples: int, seed: int):
    """The broadcast index of a benchmark of at most BLOCK bytes."""
    rows = benchmark.select("item_id", "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], rate, rounds, samples, seed))


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, rounds: int = ROUNDS, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id, item_id, start_word, n_words and distance: the best window of each text for each item within the limit."""
    common.prepare(docs.sparkSession)
    if _size(benchmark) > BLOCK:
        blocks = _Blocks(benchmark, rate, rounds, samples, seed)
        near = blocks.suspects(docs)
        return near.select("doc_id", "key").join(blocks.find(near), "key").select(*_FOUND.names)
    index = _index(benchmark, rate, rounds, samples, seed)
    return docs.select("doc_id", "text").mapInArrow(_find(index), "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance bigint")


def _clean(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for rows, lo in _portions(batch.column("text").to_pylist()):
                for row, _ in index.matches(*_texts(rows)):
                    keep[lo + row] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, rounds: int = ROUNDS, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Rows of docs, all columns, with no window within the limit of any item."""
    common.prepare(docs.sparkSession)
    if _size(benchmark) > BLOCK:
        blocks = _Blocks(benchmark, rate, rounds, samples, seed)
        texts = docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
        bad = common.saved(blocks.find(blocks.suspects(texts)).select("key").distinct(), "contaminated")
        mark, key = common.free(docs, "marked"), common.free(docs, "key")
        marked = docs.mapInArrow(_mark(blocks.near, mark, False), StructType([*docs.schema, StructField(mark, BooleanType())]))
        kept = marked.filter(mark).withColumn(key, F.md5("text")).join(bad.withColumnRenamed("key", key), key, "left_anti")
        return marked.filter(~F.col(mark)).select(*docs.columns).unionByName(kept.select(*docs.columns))
    return docs.mapInArrow(_clean(_index(benchmark, rate, rounds, samples, seed)), docs.schema)


# --- benchmarks over one block ---------------------------------------------------------------


def _runs(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words inside texts, and the text of each."""
    h = common.rolling(words, width, "window")
    row = np.searchsorted(first, np.arange(len(h)), "right") - 1
    whole = np.arange(len(h)) + width <= first[row + 1]
    return common.mix(h[whole], width), row[whole]


def _item_runs(rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_pylist()
            for rows, lo in _portions(batch.column("text").to_pylist()):
                words, first = _texts(rows)
                for k, n in enumerate(np.diff(first)):
                    if n >= LEAST:
                        width = seed_run(int(n), limit(int(n), rate))
                        h = np.unique(_runs(words[first[k] : first[k + 1]], np.array([0, n]), width)[0])
                        yield pa.RecordBatch.from_pydict({"run": np.full(len(h), width, np.int32), "seed": h.view(np.int64), "block": np.full(len(h), block[lo + k], np.int64)})

    return run


def _place(seeds: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """A place of each seed in a bitmap of bits, a power of two."""
    return common.mix(seeds, probe + 1) & np.uint64(bits - 1)


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            at = np.concatenate([_place(seeds, i, bits) for i in range(PROBES)])
            yield pa.RecordBatch.from_pydict({"place": (at >> np.uint64(6)).view(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    return run


class _Near:
    """A broadcast bitmap of the items' runs; tells, for texts, the runs that items may have."""

    def __init__(self, held, widths: list[int], bits: int) -> None:
        self.held, self.widths, self.bits = held, widths, bits

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Seeds that may be an item's, and the text of each."""
        words, first = _texts(texts)
        found = []
        for width in self.widths:
            seeds, row = _runs(words, first, width)
            for i in range(PROBES):
                at = _place(seeds, i, self.bits)
                held = (self.held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                seeds, row = seeds[held], row[held]
            found.append((seeds, row))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _mark(near: _Near, name: str, only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = np.zeros(batch.num_rows, bool)
            for rows, lo in _portions(batch.column("text").to_pylist()):
                marked[lo + near(rows)[1]] = True
            yield batch.filter(pa.array(marked)) if only else batch.append_column(name, pa.array(marked))

    return run


def _text_runs(near: _Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key")
            for rows, lo in _portions(batch.column("text").to_pylist()):
                seeds, row = near(rows)
                once = np.unique(np.stack([row, seeds.view(np.int64)]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_pydict({"key": key.take(pa.array(lo + once[0])), "seed": once[1]})

    return run


def _verify(rate: float, rounds: int, samples: int, seed: int):
    """Streams rows of (block, portion), items before texts, and looks for the items in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, index = None, [], None
        for batch in batches:
            out = []
            block, portion, key, item, copies, text = (batch.column(c).to_pylist() for c in ("block", "portion", "key", "item_id", "copies", "text"))
            held: list[int] = []
            for i in range(batch.num_rows + 1):
                here = (block[i], portion[i]) if i < batch.num_rows else None
                if held and (here != at or key[i] is None):  # the texts of a portion end
                    index = index or Index(items, rate, rounds, samples, seed)
                    for rows, lo in _portions([text[h] for h in held]):
                        for (row, k), (d, start, length) in sorted(index.matches(*_texts(rows)).items()):
                            own, times = index.ids[k]
                            out += [(key[held[lo + row]], own, start, length, d)] * times
                    held = []
                if here is None:
                    break
                if here != at:
                    at, items, index = here, [], None
                if key[i] is None:
                    items.append(((item[i], copies[i]), text[i]))
                else:
                    held.append(i)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(_FOUND_BY_KEY.names, map(list, zip(*out)))), schema=_FOUND_BY_KEY)

    return run


_FOUND_BY_KEY = _FOUND.set(0, pa.field("key", pa.string()))


class _Blocks:
    """The items of a benchmark in blocks of about BLOCK bytes, their runs, and the bitmap of these."""

    def __init__(self, benchmark: DataFrame, rate: float, rounds: int, samples: int, seed: int) -> None:
        self.settings = rate, rounds, samples, seed
        spark = benchmark.sparkSession
        items = benchmark.filter("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
        blocks = -(-_size(items) // BLOCK)
        self.items = common.saved(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))), "items")
        runs = self.items.select("block", "text").mapInArrow(_item_runs(rate), "run int, seed bigint, block bigint")
        self.runs = common.saved(runs.groupBy("run", "seed").agg(F.collect_set("block").alias("blocks")), "runs")
        bits = min(MOST_BITS, common.power_of_two(SEED_BITS * max(4096, self.runs.count())))
        places = self.runs.select("seed").mapInArrow(_bits(bits), "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        bitmap = np.zeros(bits >> 6, np.uint64)
        bitmap[places["place"].to_numpy()] = places["bits"].to_numpy().view(np.uint64)
        widths = sorted(r.run for r in self.runs.select("run").distinct().collect())  # five at most
        self.near = _Near(spark.sparkContext.broadcast(bitmap), widths, bits)

    def suspects(self, docs: DataFrame) -> DataFrame:
        """doc_id, key and text of the texts that may share a run with an item; equal texts have one key."""
        found = docs.select("doc_id", "text").mapInArrow(_mark(self.near, "", True), docs.select("doc_id", "text").schema)
        return common.saved(found.withColumn("key", F.md5("text")), "suspects")

    def find(self, suspects: DataFrame) -> DataFrame:
        """key, item_id, start_word, n_words and distance."""
        texts = suspects.groupBy("key").agg(F.first("text").alias("text"))
        seeds = suspects.select("key", "text").dropDuplicates(["key"]).mapInArrow(_text_runs(self.near), "key string, seed bigint")
        routes = seeds.join(self.runs, "seed").select("key", F.explode("blocks").alias("block")).distinct()
        routed = common.saved(texts.join(routes, "key"), "routed")
        portions = routed.groupBy("block").agg(F.ceil(F.sum(F.octet_length("text")) / PORTION).alias("portions"))  # a row a block
        to = self.items.join(portions, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("portions").cast("int") - 1)).alias("portion"), F.lit(None).cast("string").alias("key"), F.col("item_id").cast("bigint").alias("item_id"), "copies", "text")
        own = routed.join(portions, "block").select("block", F.pmod(F.xxhash64("key"), F.col("portions")).cast("int").alias("portion"), "key", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("bigint").alias("copies"), "text")
        n = max(int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions")), portions.agg(F.sum("portions")).first()[0] or 0)
        met = to.unionByName(own).repartition(n, "block", "portion").sortWithinPartitions("block", "portion", F.asc_nulls_first("key"))
        return met.mapInArrow(_verify(*self.settings), "key string, item_id bigint, start_word bigint, n_words bigint, distance bigint")
