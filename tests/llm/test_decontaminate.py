import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkevo.llm import decontaminate as D
from sparkevo.llm import queries as q


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(docs, items, rate=D.RATE):
    """(doc, item) -> least distance over all item-sized windows (up to k words may be missing at the end)."""
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, own in items:
            v = words(own)
            k = D.limit(len(v), rate)
            if len(v) < D.LEAST or len(set(w) & set(v)) < (len(set(v)) - k):
                continue
            for s in range(0, max(0, len(w) - len(v) + k + 1)):
                d = plain_distance(w[s : s + len(v)], v)
                if d <= k:
                    out[doc, item] = min(out.get((doc, item), d), d)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 5))
def test_edit_distance(a, b, most):
    assert D.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in q.op2_decontamination(spark, sf).collect()}
    assert got and got == brute(docs, items)


def test_recall_of_edited_items():
    random = np.random.default_rng(3)
    items = [(i, " ".join(f"w{random.integers(3000)}" for _ in range(random.integers(16, 60)))) for i in range(60)]
    index = D.Index(items, D.RATE, D.ROUNDS, D.SAMPLES, D.SEED)
    due = met = 0
    for i, text in items:
        own = text.split()
        for _ in range(6):
            new = list(own)
            for _ in range(D.limit(len(own)) // 2):
                at = int(random.integers(len(new)))
                kind = random.integers(3)
                new[at : at + (kind != 1)] = [] if kind == 2 else ["other"]
            doc = ["x"] * 30 + new + ["y"] * 30
            if (0, i) in brute([(0, " ".join(doc))], [(i, text)]):
                due += 1
                met += (0, i) in index.matches(*D._texts([" ".join(doc)]))
    assert due > 100 and met >= 0.97 * due


def free_end(text, item, k):
    """Least distance over all windows of n - k to n + k words."""
    n = len(item)
    return min((plain_distance(text[s : s + m], item) for s in range(len(text)) for m in range(n - k, n + k + 1) if s + m <= len(text)), default=k + 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=8), st.lists(st.integers(1, 3), max_size=12), st.integers(0, 3))
def test_free_end_distances(item, text, most):
    most, n = min(most, len(item) - 1), len(item)
    window = np.array((text + [0] * 20)[: n + most], np.uint64)[None]
    due = [(plain_distance(text[:m], item), abs(m - n), m) for m in range(n - most, min(len(text), n + most) + 1)]
    d, length = D.free_end_distances(window, np.array([item], np.uint64), most, np.array([len(text)]))
    if due and min(due)[0] <= most:
        assert (d[0], length[0]) == (min(due)[0], min(due)[2])
    else:
        assert d[0] > most


@pytest.mark.parametrize("kind", ["deleted", "inserted"])
@pytest.mark.parametrize("n", [20, 40, 100])
def test_recall_of_drift_at_the_limit(n, kind):
    random = np.random.default_rng(n)
    items = [(i, " ".join(f"w{random.integers(10**6)}" for _ in range(n))) for i in range(30)]
    index = D.Index(items, D.RATE, D.ROUNDS, D.SAMPLES, D.SEED)
    docs, k = [], D.limit(n)
    for _, text in items:
        new = text.split()
        for at in sorted(random.choice(np.arange(1, n - 1), k, replace=False))[::-1]:
            new[at : at + (kind == "deleted")] = [] if kind == "deleted" else [f"other{at}"]
        docs.append(" ".join(["x"] * 30 + new + ["y"] * 30))
    found = index.matches(*D._texts(docs))
    assert sum((i, i) in found for i in range(30)) >= 29
    if n == 20:
        for i, text in items:
            assert found[i, i][0] == free_end(docs[i].split(), text.split(), k)


def test_short_items_match_exactly():
    index = D.Index([(1, "red fox"), (2, "four words are here"), (3, "fox")], D.RATE, D.ROUNDS, D.SAMPLES, D.SEED)
    found = index.matches(*D._texts(["a red fox", "red", "Four words are here", "four words were here", "fox"]))
    assert found == {(0, 0): (0, 1, 2), (0, 2): (0, 2, 1), (2, 1): (0, 0, 4), (4, 2): (0, 0, 1)}


@pytest.mark.parametrize("n", [20, 60, 100, 200, 300])
def test_recall_of_substitutions_at_the_limit(n):
    random = np.random.default_rng(n)
    items = [(i, " ".join(f"w{random.integers(10**6)}" for _ in range(n))) for i in range(60)]
    index = D.Index(items, D.RATE, D.ROUNDS, D.SAMPLES, D.SEED)
    docs = []
    for _, text in items:
        new = text.split()
        for at in random.choice(n, D.limit(n), replace=False):
            new[at] = f"other{at}"
        docs.append(" ".join(["x"] * 30 + new + ["y"] * 30))
    found = index.matches(*D._texts(docs))
    assert sum((i, i) in found for i in range(60)) >= 59


def test_odd(spark, odd_docs, no_docs):
    item = " ".join(f"common{i}" for i in range(45))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "and"), (None, "also an item with six words")], "item_id bigint, text string")
    found = D.find_contamination(odd_docs, bench).collect()
    assert sorted({(str(r.doc_id), r.item_id, r.distance) for r in found}) == [("1", 1, 0), ("2", 1, 0), ("None", 1, 0)]
    clean = D.decontaminate(odd_docs, bench)
    assert clean.columns == odd_docs.columns and {r.doc_id for r in clean.collect()} == {2, 3, 4, 5, 6, 7, 8, 9}
    assert D.find_contamination(no_docs, bench).count() == 0
    assert D.decontaminate(odd_docs, bench.filter("false")).count() == odd_docs.count()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks and portions so small that a benchmark takes many."""
    monkeypatch.setattr(D, "BLOCK", 3000)
    monkeypatch.setattr(D, "PORTION", 20_000)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_blocks_find_what_one_index_finds(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0"))  # repeated rows
    items = items.unionByName(items.filter("item_id % 5 = 0"))
    want, clean = rows(D.find_contamination(docs, items)), rows(D.decontaminate(docs, items))
    monkeypatch.setattr(D, "BLOCK", 3000)
    monkeypatch.setattr(D, "PORTION", 20_000)
    assert -(-D._size(items) // D.BLOCK) > 3
    assert rows(D.find_contamination(docs, items)) == want != []
    assert rows(D.decontaminate(docs, items)) == clean != []


def test_blocks_odd(spark, odd_docs, no_docs, small_blocks):
    item = " ".join(f"common{i}" for i in range(45))
    filler = [(10 + i, " ".join(f"f{i}x{j}" for j in range(40))) for i in range(60)]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "and"), (None, "also an item with six words"), *filler], "item_id bigint, text string")
    found = D.find_contamination(odd_docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in found if r.item_id == 1 and r.doc_id == 1)[:2] == [("1", 1, 0)] * 2
    assert sorted({(str(r.doc_id), r.item_id, r.distance) for r in found}) == [("1", 1, 0), ("2", 1, 0), ("None", 1, 0)]
    clean = D.decontaminate(odd_docs, bench)
    assert clean.columns == odd_docs.columns and {r.doc_id for r in clean.collect()} == {2, 3, 4, 5, 6, 7, 8, 9}
    assert D.find_contamination(no_docs, bench).count() == 0 and D.decontaminate(no_docs, bench).count() == 0


def test_bitmap_lets_every_run_through(spark, small_blocks):
    bench = spark.createDataFrame([(i, " ".join(f"w{i * 7 + j}" for j in range(3 + i % 40))) for i in range(200)], "item_id bigint, text string")
    blocks = D._Blocks(bench, D.RATE, D.ROUNDS, D.SAMPLES, D.SEED)
    texts = [r.text for r in bench.collect()]
    assert set(blocks.near(texts)[1]) == set(range(200))
    assert len(blocks.near([" ".join(f"other{i}" for i in range(5000))])[1]) < 5
