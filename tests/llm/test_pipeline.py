import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkevo.llm import common, sentence_pieces
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_native import base_spans
from tests.llm.test_near_duplicates import brute as near


@pytest.fixture(scope="module")
def steps(spark):
    sf, out = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        out.append((docs, docs := common.saved(stage(spark, docs, sf), name)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    names = steps[0][0].columns
    assert all(after.columns == names for _, after in steps[:-1])
    assert "doc_id" in steps[-1][1].columns


def test_quality(spark, steps):
    before, after = map(rows, steps[0])
    good = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    right = [(d in after) == good[d] for d in before if d in good]
    assert sum(right) / len(right) > 0.9


def test_near_duplicates(steps):
    before, after = map(rows, steps[1])
    assert set(after) == {k[1] for k in near([(r.doc_id, r.text) for r in before.values()])} and len(after) < len(before)


def test_decontamination(spark, steps):
    before, after = map(rows, steps[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert set(before) - set(after) == {d for d, _ in leaks([(r.doc_id, r.text) for r in before.values()], items)}


def test_secrets(steps):
    before, after = map(rows, steps[3])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not [s for s in base_spans(r.text) if "[SECRET]" not in r.text[s[0] : s[2] + 9]]
        if not base_spans(before[d].text):
            assert r.text == before[d].text


def test_tokens(steps):
    before, after = map(rows, steps[4])
    m = sentence_pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    assert {d: m.decode(r.ids) for d, r in after.items()} == {d: r.text for d, r in before.items()}


def test_every_stage_takes_odd_and_empty_input(spark, odd_docs):
    clash = ["_id", "score", "cls_", "own_", "number_", "base", "bare", "row", "cls", "keys", "owner", "sha", "spans"]
    plain = odd_docs.withColumns({c: F.lit(f"my {c}") for c in clash})
    for docs in (plain, plain.filter("false")):
        for _, stage in P.STAGES[:-1]:
            after = stage(spark, docs, "/root/testdata/sf0.001")
            assert after.columns == docs.columns
            assert all(r[c] == f"my {c}" for r in after.collect() for c in clash)
        assert P.encode(spark, docs, "").count() == docs.count()
