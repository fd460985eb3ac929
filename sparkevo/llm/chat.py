r"""Chat formatting of typed content parts, with DataFrame functions only.

A turn holds a text, or a list of parts: text, image, audio, document or anything else. A visitor (one column
expression a kind) flattens each part into a piece of the output: a text is escaped, an attachment becomes its
placeholder. Placeholders stand in the order of the parts; the k-th of a conversation belongs to the k-th entry of
`attachments`, which keeps its place, kind, reference and the number of tokens that a model expands it to. A turn is

    <|turn|>role<|says|>body<|end|> and a line feed

Escaping puts one more backslash between the first and second character of every control string in a text or role
(`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, with any number of backslashes there already), and reading takes one away, so
no text can open or close a turn or stand for a placeholder, and every text comes back as it was.

The loss mask is a list of ranges of code points of the formatted text: the text parts of the turns whose role learns.
Placeholders and marks are never in it. Pieces are made where the rows are read; rows of a conversation meet only to
be numbered, added up by a running sum and joined, in linear time.

Defined cases: turns follow each other by turn, then role, then text; nulls come first, equal rows are all kept; a null
role or text is empty; null parts, or none, are one empty text; turns without a conv_id are one conversation; a
conversation is one row of the output, so it must fit into one (2 GB). An attachment of unknown size counts one token.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: What may follow the first character and any backslashes of a control string.
CONTROL = r"(\||/?s>|/?INST\])"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
_PLACED = r"<\|(?:image|audio|document|attachment)\|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """Tokens of attachments: one a patch of an image, so many a second of audio and a page of a document."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def _tokens(part: Column, e: Expansion) -> dict[str, Column]:
    side = lambda n: F.ceil(part[n] / F.lit(e.patch))
    return {"image": side("width") * side("height"), "audio": F.ceil(part["seconds"] * F.lit(e.per_second)), "document": part["pages"].cast("bigint") * F.lit(e.per_page)}


def visited(part: Column, expansion: Expansion = Expansion()) -> Column:
    """The piece of one part: body, kind (text, image, audio, document or another), ref and tokens (null for texts)."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    body, tokens = F.when(kind == "text", escaped(F.coalesce(part["text"], F.lit("")))), F.lit(None).cast("bigint")
    for name, count in _tokens(part, expansion).items():
        body = body.when(kind == name, F.lit(PLACEHOLDERS[name]))
        tokens = F.when(kind == name, F.greatest(F.coalesce(count, F.lit(1)), F.lit(1))).otherwise(tokens)
    tokens = F.when(kind.isin("text", *PLACEHOLDERS), tokens).otherwise(F.lit(1)).cast("bigint")
    return F.struct(body.otherwise(F.lit(OTHER)).alias("body"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def _pieces(turns: DataFrame, parts: str | None, learns: Column, expansion: Expansion) -> DataFrame:
    """A row a part: conv_id, pos (number of the turn), part, piece, chars, and where the body stands in the piece."""
    own = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(learns, F.lit(False)).alias("learns"),
        (F.coalesce(F.col("text"), F.lit("")) if parts is None else F.to_json(F.col(parts))).alias("tie"),
        *([] if parts is None else [F.col(parts).cast(PARTS).alias("parts")]),
    )
    rows = own.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "tie")) - 1)
    if parts is None:
        rows = rows.select("*", F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.struct(escaped(F.col("tie")).alias("body"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")).alias("seen"))
    else:
        rows = rows.withColumn("n_parts", F.greatest(F.coalesce(F.size("parts"), F.lit(0)), F.lit(1)))
        rows = rows.select("*", F.posexplode_outer("parts").alias("part", "one")).withColumn("part", F.coalesce("part", F.lit(0)))
        rows = rows.withColumn("seen", visited(F.col("one"), expansion))
    head = F.when(F.col("part") == 0, F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))).otherwise(F.lit(""))
    tail = F.when(F.col("part") == F.col("n_parts") - 1, F.lit(END)).otherwise(F.lit(""))
    rows = rows.select("conv_id", "pos", "part", "learns", "seen", F.concat(head, F.col("seen.body"), tail).alias("piece"), F.length(head).alias("lead"), F.length(F.col("seen.body")).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("pos", "part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("bigint"))


def format_chats(turns: DataFrame, parts: str | None = None, learns: Callable[[Column], Column] = lambda role: role == "assistant", expansion: Expansion = Expansion()) -> DataFrame:
    """A row a conversation of turns (conv_id, turn, role, and text or the column `parts` of PARTS).

    conv_id; formatted; turn_starts; loss (turn, start and end of each range to learn); attachments (at, kind, ref,
    tokens); expanded_tokens, the sum of the latter.
    """
    rows = _pieces(turns, parts, learns(F.col("role")), expansion)
    start = F.col("at") + F.col("lead")
    one = F.struct("pos", "part", "at", "piece", "learns", start.alias("start"), (start + F.col("size")).alias("end"), "seen.kind", "seen.ref", "seen.tokens")
    all_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))
    loss = F.filter("pieces", lambda p: p["learns"] & (p["kind"] == "text") & (p["end"] > p["start"]))
    placed = F.filter("pieces", lambda p: p["kind"] != "text")
    return all_.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p["part"] == 0), lambda p: p["at"]).alias("turn_starts"),
        F.transform(loss, lambda p: F.struct(p["pos"].alias("turn"), p["start"].alias("start"), p["end"].alias("end"))).alias("loss"),
        F.transform(placed, lambda p: F.struct(p["start"].alias("at"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(placed, F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"]).alias("expanded_tokens"),
    )


def _segments() -> Column:
    """Each turn of `formatted` with its marks; no text holds an unescaped mark."""
    return F.filter(F.split("formatted", r"(?=<\|turn\|>)", -1), lambda s: s != "")


def _turn(segment: Column) -> Column:
    head = F.substring_index(segment, SAYS, 1)
    body = F.substr(segment, F.length(head) + len(SAYS) + 1, F.length(segment) - F.length(head) - len(SAYS) - len(END))
    return F.struct(unescaped(F.substr(head, F.lit(len(TURN) + 1))).alias("role"), body.alias("body"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text with placeholders, parts: kind and text) and loss_text, read back from formatted rows.

    Parts read back are the placeholders, by kind, and the texts between them.
    """
    placed = F.create_map(*[F.lit(x) for name, mark in {**PLACEHOLDERS, "attachment": OTHER}.items() for x in (mark, name)])
    cut = lambda body: F.when(body == "", F.array(F.lit(""))).otherwise(F.filter(F.split(body, f"(?={_PLACED})|(?<={_PLACED})", -1), lambda p: p != ""))
    part = lambda p: F.struct(F.coalesce(placed[p], F.lit("text")).alias("kind"), F.when(placed[p].isNull(), unescaped(p)).alias("text"))
    turns = F.transform(F.transform("segments", _turn), lambda t: F.struct(t["role"].alias("role"), unescaped(t["body"]).alias("text"), F.transform(cut(t["body"]), part).alias("parts")))
    masked = F.transform("loss", lambda r: unescaped(F.substr(F.get("segments", r["turn"]), (r["start"] - F.get("turn_starts", r["turn"]) + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))
    return chats.withColumn("segments", _segments()).select(*[c for c in chats.columns if c not in ("turns", "loss_text")], turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digest_chats(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens of formatted rows."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"),
        "expanded_tokens",
    )
