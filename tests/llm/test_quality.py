import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkevo.llm import quality as Q
from sparkevo.llm import queries as q


def test_features_are_those_of_each_text():
    texts = ["abcd abcd x", "", "abc", "a b c a b c", "é é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    row, bucket = Q.features(data, offsets)
    for i, t in enumerate(texts):
        alone = np.frombuffer(t.encode(), np.uint8)
        assert bucket[row == i].tolist() == Q.features(alone, np.array([0, len(alone)]))[1].tolist()


def test_descent_reaches_the_optimum():
    """Duality: the weights' loss is near that of a long subgradient search on a small problem."""
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, 30, 8)) for _ in range(80)]
    y = np.where([x.min() < 2 or 17 in x for x in rows], 1.0, -1.0)
    r = random.normal(size=30)
    w = Q.descend(rows, y, r, 1.0, 400)
    caps = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def loss(v):
        m = np.array([(v[x] * r[x]).sum() / np.sqrt(len(x)) + v[-1] for x in rows])
        return v @ v / 2 + (caps * np.maximum(0, 1 - y * m)).sum()

    best = loss(w)
    for _ in range(300):
        assert loss(w + random.normal(size=31) * 0.02) >= best - 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.op5_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


@pytest.mark.parametrize("kind", ["both", "one", "none"])
def test_odd(spark, odd_docs, no_docs, kind):
    rows = {"both": [(1, 1), (2, 0), (2, 1), (5, None), (None, 1), (3, 0), (77, 1)], "one": [(1, 1)], "none": []}[kind]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int").withColumn("text", F.lit("other"))
    fitted = Q.train(odd_docs, labels)
    scored = Q.score(odd_docs.withColumn("score", F.lit(9.0)), fitted)
    got = scored.collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} and len({round(r.score, 12) for r in got if not r.text}) == 1
    if kind != "both":
        assert len({r.score for r in got}) == 1
    assert Q.filter_quality(odd_docs, fitted).columns == odd_docs.columns
    assert Q.score(no_docs, Q.train(no_docs, labels)).count() == 0


def test_unequal_labels_and_labels_without_a_document(spark):
    rows = [(i, "good words in a fine long text" if i % 40 == 0 else f"bad stuff number {i % 7} spam") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(800)] + [(10**6 + i, 0) for i in range(3000)], "doc_id bigint, quality int")
    fitted = Q.train(docs, labels, fit_rows=8)
    got = {r.doc_id: r.score for r in Q.score(docs, fitted).collect()}
    assert min(got[i] for i in range(0, 800, 40)) > max(got[i] for i in range(800) if i % 40)


def test_class_counts_and_log_ratios(spark, sf):
    """Features of each text alone, from its bytes and words, counted by class."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    known = [(r.text, r.label) for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("text", F.col("quality").alias("label")).collect()]
    want = np.zeros((2, Q.BUCKETS))
    for text, label in known:
        raw = np.frombuffer(text.encode(), np.uint8)
        grams = {bytes(raw[i : i + 4]) for i in range(len(raw) - 3)}
        _, bucket = Q.features(raw, np.array([0, len(raw)]))
        assert len(grams) * 0.9 <= len(bucket) <= len(grams) + len(set(text.split())) + 6
        want[label, bucket] += 1
    got = Q.class_counts(spark.createDataFrame(known, "text string, label int").repartition(5))
    assert (got == want).all()
    total = [want[k].sum() + Q.BUCKETS for k in (0, 1)]
    for f in (0, 17, int(want.sum(0).argmax())):
        assert abs(Q.log_ratios(want)[f] - np.log((want[1, f] + 1) / total[1]) + np.log((want[0, f] + 1) / total[0])) < 1e-12


def test_fit_sample_is_bounded(spark):
    rows = [(1, f"copy number {i} of one id") for i in range(3000)] + [(i, f"text {i} " * 20) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    met = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, label int")
    assert Q.fit_sample(docs, met, [20, 10], 1 << 30).num_rows == 30
    few = Q.fit_sample(docs, met, [20, 30], 1_500)
    assert 1 < few.num_rows < 50 and sum(len(b.as_py()) for b in few.column("own")) <= 1_500
