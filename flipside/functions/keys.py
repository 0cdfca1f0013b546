"""Seeded hash keys: reproducible "random" choices at any partitioning.

Every random pick of the reference (global RNG, ``random_state=42``) becomes an
md5 of ``seed:part:part...``; rows are ordered by the first 15 hex digits of
that md5 (a 60-bit integer), ties broken by the caller's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hash_hex(seed, *parts) -> Column:
    """md5 hex of ``seed:part1:part2...``."""
    cols = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    cols += [_as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_rank_key(seed, *parts) -> Column:
    """First 15 hex digits of the md5: orders like the hex prefix does."""
    return F.substring(hash_hex(seed, *parts), 1, 15)


def hex_to_long(hex_col: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def hash_bucket(seed, *parts, buckets: int = 100) -> Column:
    """Integer bucket in [0, buckets) from the first 8 hex digits."""
    return (hex_to_long(hash_hex(seed, *parts), 8) % buckets).cast("int")
