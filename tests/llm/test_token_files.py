import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkevo.llm import queries as q
from sparkevo.llm import token_files
from sparkevo.llm.common import scratch
from sparkevo.llm.token_files import checksums, encode_texts, offsets, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(docs):
    """Contract columns of (doc_id, text) pairs in ascending order of both, nulls first."""
    lib, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


LIB = Tokenizer.from_file(PATH)


def test_parts_are_encoded_as_texts():
    texts = ["", " ", "It's  A\tTest\n<|endoftext|>x İstanbul ΑΣ ΑΣ. é a ́b", "İ x 1234 'll don't\x1c.!?", "日本語 text em", "J̌ T̈ W̊ Y̊ H̱ É̌a 'sure .'s x<|endoftext|>Y.<|a|>B."]
    assert encode_texts(texts, PATH) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


PIECES = st.sampled_from([*"aAbzJTWYHé ÉßÇ×÷'.,!-_0159ǰ日가가½²ſKΣİ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u030c", "\u0308", "\u030a", "\u0331", "\u0301", "'s", "'RE", "'ll", "<|", "|>", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(PIECES, max_size=15).map("".join), st.text(max_size=12)), max_size=8))
def test_random_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode_texts(texts, PATH) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 3)
    own = token_files.Encoder(PATH)
    for texts in (["one two three four"], ["five six", "one seven"], ["one"]):
        plain = [t.encode() for t in texts]
        flat, at = own.encode(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0] + [len(p) for p in plain]))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts():
    name = "byte_bpe_50k.json"
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["It's  A\tTest", "", " x"]
    assert encode_texts(texts, name) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in q.op7_token_files(spark, sf).collect())
    assert got == brute(docs)


def test_odd_and_files(spark, odd_docs, no_docs):
    out = scratch(spark, "tokens")
    write_tokens(odd_docs, out, PATH)
    got = offsets(checksums(read_tokens(spark, out)), "ids_crc32").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, n, c) for d, _, n, c in brute(rows))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [d for d, _ in rows]
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered[:-1]]))
    out = scratch(spark, "tokens")
    write_tokens(no_docs, out, PATH)
    assert offsets(read_tokens(spark, out)).count() == 0


def test_file_layout(spark, sf):
    out = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), out, PATH)
    for file in ds.dataset(out.removeprefix("file:"), format="parquet").files:
        chunk = pq.ParquetFile(file).metadata.row_group(0)
        own = {chunk.column(i).path_in_schema: chunk.column(i) for i in range(chunk.num_columns)}
        assert own["ids.list.element"].has_dictionary_page
        assert own["doc_id"].has_column_index and own["doc_id"].has_offset_index
        assert "DELTA_BINARY_PACKED" in own["n_tokens"].encodings


def scanned(df):
    """Rows that the file scan of a query hands on, and the columns it reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), leaf.requiredSchema().fieldNames()


def test_selective_reads(spark, sf):
    """A range of documents reads some pages only, and lengths alone read no ids."""
    out = scratch(spark, "tokens")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("more", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((F.col("doc_id") + F.col("more") * 1000).cast("int").alias("doc_id"), F.substring("text", 1, 500).alias("text"))
    write_tokens(docs, out, PATH, page_rows=100)
    n = docs.count()
    some = spark.read.parquet(out).filter(F.col("doc_id").between(40, 55))
    read, columns = scanned(some.select("doc_id", "ids"))
    assert 16 <= read <= 200 and "n_tokens" not in columns
    assert sorted(r.doc_id for r in some.collect()) == sorted(r.doc_id for r in docs.filter(F.col("doc_id").between(40, 55)).collect())
    read, columns = scanned(spark.read.parquet(out).select("n_tokens"))
    assert read == n and list(columns) == ["n_tokens"]
