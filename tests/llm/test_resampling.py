"""Importance resampling against a plain reading of its rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sparkevo.llm import queries as q
from sparkevo.llm import resampling


def features(text, runs=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [" ".join(words[i : i + k]).encode() for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, runs=2, buckets=10_000, seed=7, least=20, part=(25, 100)):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t, runs)[1])
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, own = features(x, runs)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * part[0] // part[1]], 1)}
    return [(*r, rank.get(id(r))) for r in rows]


def same(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_against_plain_python(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = q.op13_importance_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same(got, [(r[0], *r[2:]) for r in plain(docs, target)])


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_odd_rows(spark, odd_docs, runs):
    target = spark.createDataFrame([("Alpha beta, common1 common2 Àé",), (None,), ("",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for least in (0, 20):
        got = resampling.resample(odd_docs, target, runs=runs, least_words=least, part=(1, 2)).collect()
        same(got, plain(docs, [r.text for r in target.collect()], runs=runs, least=least, part=(1, 2)))


def test_drawn_rows_keep_their_columns(spark, odd_docs):
    target = odd_docs.filter("doc_id = 1").select("text")
    got = resampling.drawn(odd_docs, target, part=(1, 1), least_words=1)
    assert got.columns == odd_docs.columns
    assert got.count() == odd_docs.filter("doc_id is null or doc_id not in (3, 4, 6)").count()


def test_empty_tables(spark, no_docs, odd_docs):
    assert resampling.resample(no_docs, odd_docs.select("text")).count() == 0
    assert resampling.resample(odd_docs, no_docs.select("text")).count() == odd_docs.count()


def test_pieces_of_long_texts(monkeypatch):
    text = ("Abc déf,ghi\n" * 500 + "x" * 3000 + " end ").encode()
    whole = [sorted(found) for _, found in resampling.ngrams(text, 3)]
    monkeypatch.setattr(resampling, "PIECE", 64)
    parts = list(resampling.ngrams(text, 3))
    assert len(parts) > 50 and sorted(c for _, found in parts for c in found) == sorted(c for f in whole for c in f)
    assert sum(n for n, _ in parts) == len(features(text.decode())[0])


def test_draw_follows_the_target(spark):
    rows = [(i, ("red green blue " if i % 2 else "one two three ") * 10) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([("red green blue " * 2000,)], "text string")
    drawn = [r.doc_id for r in resampling.resample(docs, target).filter("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 85
