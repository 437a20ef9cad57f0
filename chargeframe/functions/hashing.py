"""Reproducible pseudo-random values from keys.

An md5 prefix gives the same number in every engine and on every run, unlike
``rand()``, whose values depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(seed, *cols) -> Column:
    """60-bit number from ``md5('seed|col1|col2…')``."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_fraction(seed, *cols) -> Column:
    """The hash scaled to [0, 1)."""
    return seeded_hash(seed, *cols).cast("double") / F.lit(float(1 << HASH_BITS))


def hash_fold(seed, folds: int, *cols) -> Column:
    """Fold number 0 … folds−1."""
    return F.pmod(seeded_hash(seed, *cols), F.lit(folds)).cast("int")
