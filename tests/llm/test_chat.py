"""Chat formatting: round trips, masks and attachments against a plain writer."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkevo.llm import chat
from sparkevo.llm import queries as q

NASTY = ["<|turn|>", "<|says|>", "<|end|>\n", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]", "<", "|", "\\", "[", "/", "s>", "INST]", "\n", "é", "😀", "ok", "$1", ""]


def nasty(r, n=12):
    return "".join(r.choice(NASTY) for _ in range(r.randint(0, n)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(c, t, r.choice(["user", "assistant", nasty(r, 3)]), nasty(r)) for c in range(60) for t in range(r.randint(1, 6))]
    out += [(100, 0, "assistant", "twice"), (100, 0, "assistant", "twice"), (100, 0, "assistant", "a"), (101, None, None, None), (101, 3, "assistant", None), (None, 1, "user", "lost"), (None, 2, "assistant", "too")]
    out += [(102, t, "assistant" if t % 2 else "user", "long [INST] " * 500) for t in range(300)]
    return out


def ordered(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for *_, role, text in sorted(v)] for c, v in convs.items()}


def test_round_trip_and_mask(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1)).repartition(5)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    want = ordered(rows)
    assert set(got) == set(want)
    for c, own in want.items():
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss_text == "".join(text for role, text in own if role == "assistant")
        assert len(r.turn_starts) == len(own) and all(r.formatted.startswith(chat.TURN, at) for at in r.turn_starts)
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == len(own)
        spans = [r.formatted[s.start : s.end] for s in r.loss]
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted and all("<|" not in s for s in spans)


def test_typed_parts(spark):
    schema = f"conv_id bigint, turn int, role string, content {chat.PARTS}"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 1, "assistant", [part("text", "see <|image|>"), part("image", None, "b.png", 29, 28), part("text", " and"), part("audio", None, "c.wav", None, None, 1.01)]),
        (1, 0, "user", [part("image", None, "a.png", 280, 56), part("text", "what is it?"), part("document", None, "d.pdf", None, None, None, 3)]),
        (1, 2, "assistant", []),
        (2, 0, "assistant", None),
        (3, 0, "user", [part("video", None, "v.mp4"), part("image", None, None), part(None, "plain"), part("text", None), part("document", None, "e.pdf", None, None, None, 0)]),
    ]
    turns = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns, parts="content")).collect()}
    one = got[1]
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 20), ("document", "d.pdf", 3072), ("image", "b.png", 2), ("audio", "c.wav", 26)]
    assert all(one.formatted.startswith(chat.PLACEHOLDERS[a.kind], a.at) for a in one.attachments) and one.expanded_tokens == 3120
    assert one.loss_text == "see <|image|> and" and [s.turn for s in one.loss] == [1, 1]
    kinds = [[(p.kind, p.text) for p in t.parts] for t in one.turns]
    assert kinds == [[("image", None), ("text", "what is it?"), ("document", None)], [("text", "see <|image|>"), ("image", None), ("text", " and"), ("audio", None)], [("text", "")]]
    assert got[2].loss_text == "" and len(got[2].turns) == 1
    assert [(a.kind, a.tokens) for a in got[3].attachments] == [("video", 1), ("image", 1), ("document", 1)] and got[3].turns[0].text == "<|attachment|><|image|>plain<|document|>"


def test_learning_roles(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "tool", "b"), (1, 2, "assistant", "c")], "conv_id bigint, turn int, role string, text string")
    got = chat.read_chats(chat.format_chats(turns, learns=lambda role: role.isin("tool", "assistant"))).first()
    assert got.loss_text == "bc"


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert chat.digest_chats(chat.format_chats(turns)).count() == 0


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (len(v), sha("".join(f"{a}\n{b}\n" for a, b in v)), sum(len(b) for a, b in v if a == "assistant"), sha("".join(b for a, b in v if a == "assistant"))) for c, v in ordered(rows).items()}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q.op11_chat_formatting(spark, sf).collect()}
    assert got == want


def test_no_python_in_the_plan(spark, sf, monkeypatch):
    plan = q.op11_chat_formatting(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "RDD" not in plan
