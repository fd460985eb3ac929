"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within each source; row r of n gets the fractional rank (2r - 1) / 2n.
Sorted by it, every run of rows holds the sources in their overall proportions, so equal cuts give shards
that match the mixture to within a row a source and differ by one row at most.

Neither rank needs a whole source, or the whole table, in one task: both are counted per range of the sort
key, ranges are offset by a running sum of the counts, and only the rows of a range are numbered together.
There are about sqrt(rows) ranges, so ranges and the rows of a range both grow with the square root. Texts
are not shuffled.

Defined cases: a null text has size 1 and the checksum of no bytes; null sources are a source of their own;
rows that are equal in all columns used may change places with each other, which no result shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42


def seeded(seed: int, *keys: str) -> Column:
    """32 hex digits that shuffle rows by seed and keys, the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def _numbered(df: DataFrame, group: list[str], bin_: str, order: list[str], out: str) -> DataFrame:
    """Adds the number, from 1, of each row of its group in the order given; bin_ must not fall in that order."""
    cells = df.groupBy(*group, bin_).agg(F.count(F.lit(1)).alias("_cell"))
    running = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, bin_, F.coalesce(F.sum("_cell").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bin_).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(inside)).join(cells, [*group, bin_]).withColumn(out, F.col("_before") + F.col("_at")).drop("_before", "_at")


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each row; docs needs doc_id, text and source."""
    rows = docs.count()
    bins = max(1, int(rows**0.5))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    u = seeded(seed, "doc_id")
    df = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),  # no name is the null source's
        size.alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        u.alias("u"),
    ).withColumn("u_bin", F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("bigint") * bins / F.lit(2**32)))
    ties = ["u", "doc_id", "size", "text_crc32"]
    df = _numbered(df, ["source"], "u_bin", ties, "rank")
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    df = df.join(counts, "source").withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("n")))
    df = df.withColumn("f_bin", F.floor(F.col("fraction") * bins)).withColumn("all", F.lit(0))
    df = _numbered(df, ["all"], "f_bin", ["fraction", *ties, "source"], "position")
    place = F.col("position") - 1
    shard = F.floor(place * shards / F.lit(max(rows, 1))).cast("int")
    # The first row of shard s is the least p with p * shards >= s * rows.
    first = F.ceil(F.col("shard").cast("bigint") * F.lit(rows) / F.lit(shards))
    return df.withColumn("shard", shard).select(
        "doc_id", F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1)).alias("source"), "size", "text_crc32", "shard", (place - first).cast("bigint").alias("slot")
    )
