"""A bounded sample that needs neither a sort nor a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 40


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows, those whose key has a small enough hash; all rows with a key if there are no more than ``n``.

    Rows are counted first, and each is then taken or left on its own. The size has a standard
    deviation of at most the square root of ``n`` for keys that do not repeat.
    """
    known, total = rows.filter(F.col(key).isNotNull()), rows.count()
    if total <= n:
        return known
    return known.filter(F.pmod(F.xxhash64(key), F.lit(_STEPS)) < F.lit(_STEPS * n // total))
