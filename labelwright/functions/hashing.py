"""Seeded, portable pseudo-randomness: the same in every run and in any SQL engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits used to spread rows over hash buckets (65,536 buckets).
BUCKET_DIGITS = 4
_TWO_32 = 4294967296.0


def row_hash(seed: int | str, keys: Sequence[str | Column]) -> Column:
    """md5 of ``seed|key1|key2...``; null keys count as an empty text."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_bucket(digest: Column) -> Column:
    return F.substring(digest, 1, BUCKET_DIGITS)


def hash_uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 8 hex digits."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TWO_32)
