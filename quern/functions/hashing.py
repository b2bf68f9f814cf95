"""Seeded hashes that any SQL engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*cols: str | Column, seed: int | str = 42) -> Column:
    """60 bits of the md5 of the columns' texts joined by '|' and the seed; nulls are skipped, as concat_ws does."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def hashed_sql(*cols: str, seed: int | str = 42) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(cols)}, '{seed}')), 1, 15) as bigint)"


def unit_hash(*cols: str | Column, seed: int | str = 42) -> Column:
    """In (0, 1)."""
    return (hashed(*cols, seed=seed).cast("double") + 0.5) / float(1 << 60)


def unit_hash_sql(*cols: str, seed: int | str = 42) -> str:
    return f"((({hashed_sql(*cols, seed=seed)})::double + 0.5) / {float(1 << 60)!r}::double)"
