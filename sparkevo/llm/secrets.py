"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Base patterns mark assignments, access keys and long hex strings. The method adds bare high-entropy tokens:
the hash of every candidate value is counted over the corpus by distinct repositories and owners, and a value
that few owners hold, in few repositories, is a live-looking credential of theirs, while one that many owners share or
that stands in many repositories is a copied example.

Patterns run once over the texts; the spans that they find are written to the shared folder and read from there.

Counting drops to one row per (value, owner, repository) in each task before it is shuffled, so a value that a
third of all rows hold costs no more than any other; texts are never shuffled. Counts go back to the
occurrences by a sort-merge join, whose hot keys adaptive execution splits.

Positions are code points, end exclusive. Defined cases: a null text is empty; a null owner or repository is
an owner of its own; repeated rows get equal results each and add no owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Runs of token characters; the long ones with letters and digits, or mixed case and a digit, are candidates.
BARE = "[A-Za-z0-9+/_-]{20,}"
#: (kind, quick test that holds wherever the kind has a span, pattern, group of the value, least characters of it)
BASE = (
    ("assign", r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]{16}", ACCESS, 0, 20),
    ("hex", "[0-9a-f]{24}", HEX, 0, 24),
)
KINDS = ("assign", "access", "hex", "owned")
#: Values held by more owners, or in more repositories, than these are copied examples.
MAX_OWNERS, MAX_REPOS = 2, 6


def _found(kind: str, quick: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a kind in `body`: array of (start, end, kind number, value), failing matches dropped.

    Matches and the pieces between them alternate, so starts are running sums of their lengths.
    """
    lengths = F.transform(F.split("body", pattern, -1), F.length)
    hits = F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all("body", F.lit(pattern), F.lit(group)).alias("value"), lengths.alias("gap"))
    number = KINDS.index(kind)
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    walked = F.aggregate(
        F.filter(hits, lambda h: h["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("got")),
        lambda acc, h: F.struct(
            (acc["at"] + h["gap"] + F.length(h["hit"])).alias("at"),
            F.when(
                F.length(h["value"]) >= least,
                F.concat(acc["got"], F.array(F.struct((acc["at"] + h["gap"]).alias("start"), (acc["at"] + h["gap"] + F.length(h["hit"])).alias("end"), F.lit(number).alias("kind"), h["value"].alias("value")))),
            ).otherwise(acc["got"]).alias("got"),
        ),
        lambda acc: acc["got"],
    )
    return F.when(F.col("body").rlike(quick), walked).otherwise(none)


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """docs with base, the base spans, and bare, the method's candidates that overlap none of them."""
    df = docs.withColumn("body", F.coalesce("text", F.lit("")))
    for kind, quick, pattern, group, least in BASE:
        df = df.withColumn(f"_{kind}", _found(kind, quick, pattern, group, least))
    df = df.withColumn("_bare", _found("owned", BARE, BARE, 0, 20))
    df = df.withColumn("base", F.concat("_assign", "_access", "_hex"))
    mixed = F.filter(
        "_bare",
        lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return df.withColumn("bare", mixed).drop("_assign", "_access", "_hex", "_bare", "body")


def ownership(held: DataFrame) -> DataFrame:
    """value_hash, repos, owners of (value_hash, owner, repo) rows: numbers of distinct ones."""
    single = held.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = single.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


_NO_SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"


def _keyed(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """doc_id, text, row (all columns of docs, so that no name can clash), the spans and the keys."""
    keyed = candidates(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"), owner.cast("string").alias("_owner"), repo.cast("string").alias("_repo")))
    return keyed.withColumn("text_key", F.xxhash64("text", F.octet_length("text")))


def _judged(df: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """doc_id, text_key, added (live bare spans), live and copied for rows that have any span."""
    df = df.select("doc_id", "text_key", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), "base", "bare")
    seen = df.filter((F.size("base") > 0) | (F.size("bare") > 0)).withColumn("span", F.explode(F.concat("base", "bare")))
    seen = seen.select("doc_id", "text_key", "owner", "repo", "span", F.sha2(F.col("span.value"), 256).alias("value_hash"))
    owned = seen.join(ownership(seen.select("value_hash", "owner", "repo")), "value_hash")
    is_live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    return (
        owned.groupBy("doc_id", "text_key")
        .agg(
            F.collect_set(F.when(is_live & (F.col("span.kind") == 3), F.col("span"))).alias("added"),
            F.count_if(is_live).alias("live"),
            F.count_if(~is_live).alias("copied"),
            F.count_distinct("span").alias("n_spans"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        # repeated rows meet here; each counts its own spans
        .select("doc_id", "text_key", "added", (F.col("live") * F.col("n_spans") / F.col("n_rows")).cast("bigint").alias("live"), (F.col("copied") * F.col("n_spans") / F.col("n_rows")).cast("bigint").alias("copied"))
    )


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_key").eqNullSafe(F.col(f"{b}.text_key"))


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, base and spans (arrays), live (values that few owners hold in few repositories) and copied.

    One row per row of docs. spans holds the base spans and the candidates with a live-looking value.
    """
    df = saved(_keyed(docs, owner, repo).drop("row", "text"), "spans")
    rows, judged = df.select("doc_id", "text_key", "base").alias("a"), _judged(df, max_owners, max_repos).alias("b")
    zero = F.lit(0).cast("bigint")
    return rows.join(judged, _same_row("a", "b"), "left").select(
        "a.doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(_NO_SPANS))).alias("spans"),
        F.coalesce("live", zero).alias("live"), F.coalesce("copied", zero).alias("copied"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets: counts of base kinds, digest of base spans, all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    return scanned.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "live", "copied",
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with the value of every span replaced by mark; a value ends where its span does."""
    values = F.array_sort(F.transform(spans, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"))))
    walked = F.aggregate(
        values,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, v: F.when(v["start"] < acc["at"], F.struct(F.greatest(acc["at"], v["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(v["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, v["start"] - acc["at"]), F.lit(mark)).alias("out"))
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))).otherwise(text)


def redact(docs: DataFrame, owner: Column, repo: Column, mark: str = "[SECRET]", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with the values of base spans and live candidates in text replaced by mark; columns and rows stay.

    Only texts with a bare candidate are shuffled, to meet its owner count; the others are rewritten in place.
    """
    df = saved(_keyed(docs, owner, repo).drop("text"), "spans")
    done = lambda d, spans: d.select(F.col("row").withField("text", _without(F.col("row.text"), spans, mark)).alias("row")).select("row.*")
    plain = done(df.filter(F.size("bare") == 0), F.col("base"))
    judged = _judged(df, max_owners, max_repos).filter(F.size("added") > 0).select("doc_id", "text_key", "added")
    waiting = df.filter(F.size("bare") > 0).alias("a").join(judged.alias("b"), _same_row("a", "b"), "left")
    waiting = waiting.select("a.*", F.concat("base", F.coalesce("added", F.array().cast(_NO_SPANS))).alias("_spans"))
    return plain.unionByName(done(waiting, F.col("_spans")))
