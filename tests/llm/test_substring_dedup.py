import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkevo.llm import queries as q
from sparkevo.llm import substring_dedup as S
from sparkevo.llm.substring_dedup import substring_dedup


def brute(docs, width=20):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (d["text"] or "").encode()) for d in docs]
    # texts that share a doc_id rank by Spark's xxhash64
    rank = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64 - 2**63
    key = [(-(2**63) if d["doc_id"] is None else d["doc_id"], rank(d["text"] or "")) for d in docs]
    first = {}
    for k, w in sorted(zip(key, words), key=lambda x: x[0]):
        for i in range(len(w) - width + 1):
            at = first.setdefault(tuple(w[i : i + width]), (*k, i))
            first[tuple(w[i : i + width])] = min(at, (*k, i))
    out = Counter()
    for d, k, w in zip(docs, key, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (*k, i):
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d["doc_id"], len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def rows(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_documents(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows(q.op1_substring_dedup(spark, sf))
    assert got == brute(docs)
    assert sum(k[2] for k in got) > 0


@pytest.mark.parametrize("width", [3, 20])
def test_odd(odd_docs, width):
    want = brute([r.asDict() for r in odd_docs.collect()], width)
    assert rows(substring_dedup(odd_docs, width)) == want


def test_intervals_and_text(odd_docs):
    for r in substring_dedup(odd_docs).filter("doc_id = 2 and n_removed > 0").collect():
        assert list(zip(r.begins, r.ends)) == [(1, 46), (47, 92)]
        assert r.kept == "delta epsilon"


def test_empty(no_docs):
    assert substring_dedup(no_docs).count() == 0


def test_bytes_that_the_bucket_tells():
    h = np.random.default_rng(0).integers(0, 2**63, 10_000).astype(np.uint64)
    for buckets, last in ((128, 8), (256, 9), (1 << 16, 10), (1 << 24, 11), (1 << 30, 11)):
        shipped = S._shipped(buckets)
        assert len(shipped) == 9 and shipped[-1] == last
        bucket = (h >> np.uint64(40)) % np.uint64(buckets)
        body = h.view(np.uint8).reshape(-1, 8)[:, [i for i in shipped if i < 8]]
        assert len({(b, bytes(x)) for b, x in zip(bucket.tolist(), body)}) == len(set(h.tolist()))


def test_many_buckets(odd_docs, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 4)
    assert rows(substring_dedup(odd_docs)) == brute([r.asDict() for r in odd_docs.collect()])
