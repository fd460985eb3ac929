import hashlib
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparkevo.llm import queries as q
from sparkevo.llm.secrets import redact, scan_secrets, digest
from sparkevo.llm.sharding import interleaved_shards

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def joined(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'owned')[k]}:{s}:{e}" for s, k, e in spans)


def expected_secrets(docs):
    """The whole scan in plain Python: rows as sorted tuples."""
    bare, owners, repos = {}, {}, {}
    for i, d in enumerate(docs):
        text, own = d["text"] or "", base_spans(d["text"])
        bare[i] = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(s < m.end() and m.start() < e for s, _, e in own)]
        for s, k, e in own + bare[i]:
            value = next(m[2] for m in ASSIGN.finditer(text) if m.start() == s) if k == 0 else text[s:e]
            owners.setdefault(value, set()).add(d["source"])
            repos.setdefault(value, set()).add((d["source"], d["lang"]))
    out = []
    for i, d in enumerate(docs):
        own = base_spans(d["text"])
        live = [x for x in bare[i] if len(owners[(d["text"])[x[0] : x[2]]]) <= 2 and len(repos[(d["text"])[x[0] : x[2]]]) <= 6]
        n = Counter(k for _, k, _ in own)
        out.append((str(d["doc_id"]), n[0], n[1], n[2], hashlib.sha256(joined(own).encode()).hexdigest(), joined(sorted(own + live))))
    return sorted(out)


def got_secrets(df):
    return sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in df.collect())


def test_secrets_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got_secrets(q.op4_secret_scan(spark, sf)) == expected_secrets([r.asDict() for r in docs])


def test_secrets_odd(odd_docs, no_docs):
    scan = lambda d: digest(scan_secrets(d, F.col("source"), F.concat_ws("/", "source", "lang")))
    got = got_secrets(scan(odd_docs))
    assert got == expected_secrets([r.asDict() for r in odd_docs.collect()])
    assert any("owned" in r[5] for r in got)
    assert scan(no_docs).count() == 0


def test_many_repositories_of_one_owner_are_copies(spark):
    token = "aZ3" + "q7" * 12
    rows = [(i, f"bare {token} here", "one", f"r{i}") for i in range(8)] + [(20 + i, "bare bQ4" + "x9" * 12, "one", f"r{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, owner string, repo string")
    got = {r.doc_id: (len(r.spans), r.live, r.copied) for r in scan_secrets(docs, F.col("owner"), F.col("repo")).collect()}
    assert set(got.values()) == {(0, 0, 1), (1, 1, 0)} and got[0] == (0, 0, 1) and got[20] == (1, 1, 0)


def test_redact(odd_docs):
    out = redact(odd_docs, F.col("source"), F.col("source"))
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[8].startswith("Àé password: [SECRET] apikey=abc API_KEY='[SECRET]' [SECRET]")
    assert "q7q7" not in text[9] and "24be" not in text[7] and text[4] is None
    assert text[5] == odd_docs.filter("doc_id = 5").first().text


def check_shards(rows, docs, shards=16):
    assert len(rows) == len(docs)
    n = Counter(r.shard for r in rows)
    if len(rows) >= shards:
        assert set(n) == set(range(shards)) and max(n.values()) - min(n.values()) <= 1
    for s, k in n.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))
    mix, by = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    for source, k in mix.items():
        for s in n:
            assert abs(by[s, source] - k / shards) <= 2
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_sharding_documents(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_shards(q.op8_sharding(spark, sf).collect(), docs)


def test_sharding_follows_definition(spark, sf):
    """The exact order: fractional rank of the seeded hash within each source."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    u = {d.doc_id: hashlib.md5(f"42:{d.doc_id}".encode()).hexdigest() for d in docs}
    n, rank = Counter(d.source for d in docs), {}
    for s in n:
        for i, d in enumerate(sorted((d for d in docs if d.source == s), key=lambda d: u[d.doc_id]), 1):
            rank[d.doc_id] = (2 * i - 1) / (2 * n[s])
    order = sorted(docs, key=lambda d: (rank[d.doc_id], u[d.doc_id]))
    want = {d.doc_id: p * 16 // len(docs) for p, d in enumerate(order)}
    assert {r.doc_id: r.shard for r in q.op8_sharding(spark, sf).collect()} == want


def test_sharding_odd(odd_docs, no_docs):
    check_shards(interleaved_shards(odd_docs, 3).collect(), [r.asDict() for r in odd_docs.collect()], 3)
    assert interleaved_shards(no_docs).count() == 0


def test_a_source_named_like_nothing_is_no_null(spark):
    docs = spark.createDataFrame([(k, "x", (None, "\0none", "", "=")[k % 4]) for k in range(40)], "doc_id bigint, text string, source string")
    got = interleaved_shards(docs, 4).collect()
    want = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: r.source for r in got} == want and len(got) == 40
    for shard in range(4):
        assert all(sum(r.shard == shard and r.source == s for r in got) in (2, 3) for s in want.values())
