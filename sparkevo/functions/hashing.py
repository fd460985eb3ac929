"""Portable seeded randomness: the same value in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: object, *keys: Column) -> Column:
    """'seed:key:...' as text; nulls are empty."""
    parts = [F.lit(str(seed))] + [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.concat_ws(":", *parts)


def uniform(seed: object, *keys: Column) -> Column:
    """A number in [0, 1) that seed and keys decide."""
    digits = F.substring(F.md5(seeded_key(seed, *keys)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: object, *keys: str) -> str:
    """The same in DuckDB's SQL."""
    text = "||':'||".join([f"'{seed}'"] + [f"cast({k} as varchar)" for k in keys])
    return f"cast(('0x'||substr(md5({text}),1,8))::bigint as double)/4294967296.0"
