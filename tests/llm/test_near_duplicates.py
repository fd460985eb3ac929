from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkevo.llm import near_duplicates as N
from sparkevo.llm import queries as q


def sets(text, width=5):
    w = [x for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([(len(w), *w)])


def brute(docs, threshold=0.8):
    """Multiset of (doc_id, class_id, n_links, n_copies)."""
    by_set = {}
    for d, t in docs:
        by_set.setdefault(sets(t), []).append(d)
    keys = list(by_set)
    near = {k: [] for k in range(len(keys))}
    holders = {}
    for k, s in enumerate(keys):
        for g in s:
            holders.setdefault(g, []).append(k)
    both = Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                both[b, a] += 1
    for (a, b), n in both.items():
        if n >= threshold * (len(keys[a]) + len(keys[b]) - n) - 1e-9:
            near[a].append(b)
            near[b].append(a)
    label, out = {}, Counter()
    for k in near:
        if k not in label:
            todo, seen = [k], {k}
            while todo:
                for x in near[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            ids = [d for x in seen for d in by_set[keys[x]] if d is not None]
            for x in seen:
                label[x] = min(ids, default=None)
    for k, s in enumerate(keys):
        for d in by_set[s]:
            out[d, label[k], len(near[k]), len(by_set[s])] += 1
    return out


def rows_of(df):
    return Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect())


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(q.op6_jaccard_join(spark, sf))
    assert got == brute(docs) and any(k[2] for k in got)


@pytest.fixture(scope="module")
def crowd(spark):
    """A chain of edits and a crowd of near copies that fills several blocks."""
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    out = []
    for i in range(120):
        w = list(base)
        for at in random.integers(0, 300, int(random.integers(1, 9))):
            w[at] = f"x{random.integers(10**6)}"
        out.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):
        chain[i * 16] = f"y{i}"
        chain = chain[3:] + [f"z{i}{k}" for k in range(3)]
        out.append((500 + i, " ".join(chain)))
    return out + [(900, out[0][1]), (901, out[0][1])]


def test_blocks_and_chains(spark, crowd, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    docs = spark.createDataFrame(crowd, "doc_id bigint, text string")
    assert rows_of(N.near_duplicates(docs)) == brute(crowd)
    kept = N.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k[1] for k in brute(crowd)})


def test_crowds_part_by_longer_prefixes(spark, crowd, monkeypatch):
    """Texts that share a boilerplate part but are no copies crowd at short prefixes; families in it are still found."""
    random = np.random.default_rng(8)
    plate = " ".join(f"b{i}" for i in range(90))
    rows = [(2000 + i, f"{plate} " + " ".join(f"o{i}x{k}" for k in range(40))) for i in range(150)]
    for i in range(0, 150, 3):  # a near copy of every third
        w = rows[i][1].split()
        w[int(random.integers(90, 130))] = "changed"
        rows.append((3000 + i, " ".join(w)))
    docs = spark.createDataFrame(crowd + rows, "doc_id bigint, text string")
    monkeypatch.setattr(N, "CROWD", 12)
    sketched = N.sketch(docs).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("signature").alias("signature"))
    standing = N.forest(docs, sketched, N.SHINGLE, N.THRESHOLD, N.TREES, N.RECALL, N.SEED).collect()
    assert {len(r["keys"]) for r in standing} == {N.TREES, N.TREES + N.FURTHER}
    monkeypatch.setattr(N, "BLOCK", 16)
    assert rows_of(N.near_duplicates(docs)) == brute(crowd + rows)


def test_recall_of_prefixes():
    """Pairs at the threshold meet as often as the formula says at every length, and far beyond 0.9 where prefixes stop."""
    random = np.random.default_rng(3)
    own, met, trials = N.Forest(N.TREES, N.SEED), np.zeros(N.LONGEST + 1), 400
    for _ in range(trials):
        x = random.integers(0, 2**63, 540).astype(np.uint64)
        a, b = x[:486], x[54:]  # 432 of 540 in common: similarity 0.8
        sa, sb = (own.signature(v).reshape(2, N.TREES).T for v in (a, b))
        values = [np.ascontiguousarray(v).astype(">i8").view(">u2").reshape(N.TREES, N.LONGEST) for v in (sa, sb)]
        same = np.logical_and.accumulate(values[0] == values[1], axis=1)
        met[1:] += same.any(0)
    for d in range(1, N.LONGEST + 1):
        assert abs(met[d] / trials - (1 - (1 - 0.8**d) ** N.TREES)) < 0.05
    assert met[N.depth()] / trials > 0.99 and 1 - (1 - 0.8**N.LONGEST) ** (N.TREES + N.FURTHER) > N.RECALL


def test_odd(spark, odd_docs, no_docs):
    assert rows_of(N.near_duplicates(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    kept = N.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "7", "8", "9"]  # the first text of 2 and the one without id are near copies of 1
    assert N.near_duplicates(no_docs).count() == 0 and N.deduplicate(no_docs).count() == 0


def test_depth_keeps_recall():
    assert N.depth() == 4
    for t in (0.5, 0.8, 0.95):
        d = N.depth(t, 32, 0.99)
        assert 1 - (1 - t**d) ** 32 >= 0.99 or d == 1


def test_common_counts():
    random = np.random.default_rng(2)
    left, right = ([np.unique(random.integers(0, 500, n)).astype(np.uint64) for n in random.integers(1, 300, 9)] for _ in range(2))
    got = N.common_counts(left, right, tile=64)
    assert (got == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()
