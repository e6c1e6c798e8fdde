"""Deterministic, partition-independent pseudo-randomness from md5.

``rand(seed)`` depends on partitioning and task order, so a retried task or a
different cluster size would pick other rows.  A hash of (seed, row key) gives
every row a fixed position instead, and the same expression is plain SQL, so
any engine can reproduce the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42
# 16**4 buckets: a class holding a third of a 100 TB table still splits into
# pieces of well under a GB for the one window that ranks inside a bucket.
BUCKET_HEX_DIGITS = 4
NUM_BUCKETS = 16 ** BUCKET_HEX_DIGITS


def _as_str(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("string")


def row_hash(key: Sequence[str | Column], seed: int = DEFAULT_SEED) -> Column:
    """Lower-case hex md5 of ``seed|k1|k2...`` (NULL keys are skipped)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_str(k) for k in key]))


def hash_bucket(h: Column, digits: int = BUCKET_HEX_DIGITS) -> Column:
    """Leading hex digits of a hash as an int; order-compatible with ``h``."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def u60(h: Column) -> Column:
    """First 15 hex digits of a hash as a non-negative bigint."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def draw_hash(parts: Sequence[str | Column], seed: int = DEFAULT_SEED) -> Column:
    """u60 of md5(seed|parts...): the j-th draw of a group."""
    return u60(row_hash(parts, seed))
