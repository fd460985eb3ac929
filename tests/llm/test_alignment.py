"""Token alignment against whole-text tokenizers and plain loops."""

import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sparkevo.llm import alignment
from sparkevo.llm import queries as q


@pytest.fixture(scope="module")
def plain_align():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.byte_pieces()

    def tokens(text):
        if not text:
            return [], []
        own = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        return (own, pieces) if all(b"".join(x for _, x in side) == want for side in (own, pieces)) else ([], [])

    def run(docs):
        out, count = [], Counter()
        for doc_id, text in docs:
            sides = tokens(text)
            ends = []
            for side in sides:
                at, own = 0, []
                for _, x in side:
                    at += len(x)
                    own.append(at)
                ends.append(own)
            both = sorted(set(ends[0]) & set(ends[1]))
            groups, i, j = [], 0, 0
            for e in both:
                to = [own.index(e, k) + 1 for own, k in zip(ends, (i, j))]
                groups.append(([x for x, _ in sides[0][i : to[0]]], [x for x, _ in sides[1][j : to[1]]]))
                i, j = to
            links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
            count.update(links.keys())
            said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
            out.append((doc_id, len(sides[0]), len(sides[1]), groups, links, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
        most = {}
        for (x, _), n in count.items():
            most[x] = max(n, most.get(x, 0))
        return [(d, na, nb, len(g), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(count[p] * n for p, n in links.items()), said) for d, na, nb, g, links, said in out]

    return run


def same(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_against_plain_loops(spark, sf, plain_align):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(q.op12_token_alignment(spark, sf).collect(), plain_align(docs))


PARTS = ["the", " ", "  ", "\n", "\t", " ", "　", " ", " ", "\u0085", "é", "日本語", "😀", "👩‍👩‍👧", "▁", "<0x41>", "<s>", "</s>", "<|endoftext|>", "'s", " 's", "don't", "123", "a1b2", "===", "====", "....", "\0", "\x1c", "़", "ß", "İ", "é", "x" * 40, "Straße", "﻿", "\r\n", "—", "ÿ", "\U0001f1e9\U0001f1ea"]


def test_random_texts(spark, plain_align):
    r = random.Random(11)
    docs = [(i, "".join(r.choice(PARTS[:10] + PARTS if i % 3 else PARTS[:3] + PARTS[10:12]) for _ in range(r.randint(0, 30)))) for i in range(900)]
    docs += [(i, "".join(r.choice(PARTS[:2] + PARTS[10:14] + PARTS[16:30]) for _ in range(60)).replace("▁", " ")) for i in range(900, 1200)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    same(alignment.align(frame, q.BYTES, q.PIECES).collect(), plain_align(docs))


def test_odd_rows(spark, odd_docs, no_docs, plain_align):
    same(alignment.align(odd_docs, q.BYTES, q.PIECES).collect(), plain_align([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert alignment.align(no_docs, q.BYTES, q.PIECES).count() == 0


def test_small_portions(plain_align):
    """Portions and slices of a few rows, in this process: numbers of pairs are the portion's."""
    import numpy as np
    import pyarrow as pa

    own = alignment.encoder(q.BYTES, q.PIECES)
    portion = alignment._Portion(3, len(own.sides[1].bytes))
    docs = [(i, f"the quick brown fox {i} naïve the quick " * (1 + i % 3)) for i in range(20)]
    for i in range(0, 20, 4):
        part = [(" " + t).encode() for _, t in docs[i : i + 4]]
        rows = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs[i : i + 4]], "none": [False] * 4})
        portion.add(own, rows, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(p) for p in part]))
    t = pa.Table.from_batches(portion.batches())
    count = {}
    for row in t.filter(pa.compute.is_valid(t["a"])).to_pylist():
        count |= {row["at"] + k: (n, a) for k, (a, n) in enumerate(zip(row["a"], row["docs"]))}
    most = {}
    for n, a in count.values():
        most[a] = max(n, most.get(a, 0))
    pairs = pa.table({"at": list(count), "count": [n for n, _ in count.values()], "best": [n == most[a] for n, a in count.values()]})
    got = alignment._judge(t.filter(pa.compute.is_valid(t["pairs"])), pairs).to_pylist()
    same([tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got], plain_align(docs))


def test_large_groups():
    import numpy as np

    r = np.random.default_rng(1)
    flat = [r.integers(0, 50, 300).astype(np.int32), r.integers(0, 60, 280).astype(np.int32)]
    ends = np.array([2, 250, 300]), np.array([3, 240, 280])
    document = np.array([0, 0, 1])
    want = Counter()
    for g in range(3):
        (s, e), (u, v) = ((int(x[g - 1]) if g else 0, int(x[g])) for x in ends)
        for x in flat[0][s:e]:
            for y in flat[1][u:v]:
                want[int(document[g]), int(x) * 60 + int(y)] += 1
    for limit in (1 << 22, 100):
        alignment.EXPANDED = limit
        of, pair, links = alignment.linked(flat, ends, document, 60)
        assert dict(zip(zip(of.tolist(), pair.tolist()), links.tolist())) == want and len(of) == len(want)
    alignment.EXPANDED = 1 << 22
