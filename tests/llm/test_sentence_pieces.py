import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkevo.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def viterbi(m, text):
    """Plain sequential cut of a whole text."""
    s = " " + text if text else ""
    best, back = [0] + [None] * len(s), [0] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for begin in range(max(0, end - m.reach), end):
            piece = s[begin:end]
            gain = m.score.get(piece, m.unknown if len(piece) == 1 else None)
            if gain is not None and best[begin] is not None and (best[end] is None or best[begin] + gain > best[end]):
                best[end], back[end] = best[begin] + gain, end - begin
    ids, end = [], len(s)
    while end:
        piece = s[end - back[end] : end]
        ids[:0] = [m.ids[piece]] if piece in m.ids else [m.byte[b] for b in piece.encode()]
        end -= back[end]
    return ids


def chunked(m, text, chunk):
    """The scan's steps, without Spark."""
    s = " " + text if text else ""
    parts = [(s[a : a + chunk + m.reach - 1], min(chunk, len(s) - a)) for a in range(0, len(s), chunk)]
    v = np.full(m.reach, sp._NONE, np.int64)
    v[0] = 0
    steps = []
    for body, own in parts:
        steps.append(m.best(body, own, v))
        v = sp.times(v, m.transfer(body, own))
    state, ids = 0, []
    for (body, own), (_, back) in zip(reversed(parts), reversed(steps)):
        state, got = m.trace(body, back, own + state)
        ids[:0] = got
    return ids


TEXTS = st.text(st.sampled_from("aaabbthe  ing\n\té▁日x"), max_size=120)


@settings(max_examples=150, deadline=None, phases=(Phase.generate,))
@given(TEXTS, st.integers(16, 40))
def test_scan_is_sequential(text, chunk):
    m = sp.model(PATH)
    want = viterbi(m, text)
    assert m.encode(text) == want
    assert chunked(m, text, chunk) == want
    assert m.decode(want) == text


def test_no_library_cut_is_better():
    """The library's BPE cuts of common words use the same pieces and never score more."""
    m = sp.model(PATH)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("Hello world of pieces", "Éréier enqueeau de", "and the rest", "the theahawh onereand"):
        score = [sum(m.score[m.bytes[i].decode()] for i in ids) for ids in (m.encode(text), lib.encode(text))]
        assert score[0] >= score[1] and lib.decode(m.encode(text)) == text


def test_documents(spark, sf):
    from sparkevo.llm import queries as q

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op10_sentence_pieces(spark, sf).collect()
    assert len(got) == len(docs) and all(r.exact for r in got)


def sequential(m, text):
    """The cut of a whole text by the operator's search, in one piece (the plain one above is slow on long texts)."""
    s = " " + text if text else ""
    return m.trace(s, m.best(s, len(s), [0])[1], len(s))[1]


def test_giant_documents(spark, sf):
    """Whole texts over GIANT, through the scan, against one search over each."""
    m = sp.model(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.length("text") > sp.GIANT // 4)
    texts = {r.doc_id: r.text * 4 for r in docs.limit(2).collect()}
    long = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = sp.encode(long, PATH).collect()
    assert rows and all(r.n_chunks > 5 for r in rows)
    for r in rows:
        assert r.ids == sequential(m, texts[r.doc_id])
    few = texts[rows[0].doc_id][:3000]
    assert sequential(m, few) == viterbi(m, few)


@pytest.mark.parametrize("radix", [2, 3, 8])
def test_scan_levels(spark, radix):
    """Scans of several levels against folds from one end."""
    random, reach = np.random.default_rng(7), sp.model(PATH).reach
    for kind in (sp.Scores, sp.Exits):
        own, rows, want = kind(reach), [], {}
        for sha, n in (("a", 29), ("b", 1), ("c", 9)):
            items = [random.integers(-50, 0, (reach, reach)).astype(np.int64).tobytes() if kind is sp.Scores else random.integers(0, reach, reach).astype(np.int32).tobytes() for _ in range(n)]
            rows += [(sha, i, x) for i, x in enumerate(items)]
            state = own.first
            for i in reversed(range(n)) if own.backwards else range(n):
                want[sha, i] = state
                state = own.combine(state, items[i])
        got = sp.scan(spark.createDataFrame(rows, "sha string, no bigint, item binary").repartition(3), kind, PATH, radix)
        assert {(r.sha, r.no): bytes(r.state) for r in got.collect()} == want


@pytest.mark.parametrize("giant", [50, 10**9])
def test_odd(odd_docs, no_docs, giant):
    m = sp.model(PATH)
    docs = odd_docs
    coded = sp.encode(docs, PATH, giant=giant, chunk=32 if giant < 10**9 else sp.CHUNK)
    rows = coded.collect()
    texts = {r.doc_id: r.text for r in docs.filter("doc_id <> 2").collect()}
    assert len(rows) == docs.count()
    assert any(r.n_chunks > 1 for r in rows) == (giant == 50)
    for r in rows:
        if r.doc_id in texts and r.doc_id is not None:
            assert r.ids == (None if texts[r.doc_id] is None else sequential(m, texts[r.doc_id]))
    back = sorted((str(r.doc_id), str(r.text)) for r in sp.decode(coded, PATH).collect())
    assert back == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    assert sp.encode(no_docs, PATH).count() == 0
