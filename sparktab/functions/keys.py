"""Seeded, row-order-independent pseudo-random keys.

``h = conv(substring(md5('<seed>:<key>'), 1, 8), 16, 10)`` is a 32-bit
integer that DuckDB computes identically as
``('0x' || substr(md5('<seed>:' || key), 1, 8))::BIGINT``.  Splits, folds
and samples built on it do not depend on partitioning or file order, so a
lost executor recomputes exactly the same assignment."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_int(key, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_unit(key, seed: int = 42) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(key, seed) / F.lit(TWO_32)


def hash_key_sql(key_sql: str, seed: int = 42) -> str:
    """DuckDB twin of :func:`hash_int` for oracle SQL."""
    return f"('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"
