from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chargeframe.operators import encoding


def _fold(key, folds=5):
    return int(hashlib.md5(f"42|{key}".encode()).hexdigest()[:15], 16) % folds


def _smooth(train: pd.DataFrame, value) -> float:
    mean, var = train.y.mean(), train.y.var(ddof=0)
    own = train[train.c.isna()] if value is None else train[train.c == value]
    if not len(own):
        return mean
    weight = len(own) * var / (len(own) * var + own.y.var(ddof=0))
    return weight * own.y.mean() + (1 - weight) * mean


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    cats = ["hot" if i % 3 == 0 else None if i % 17 == 0 else f"c{i % 40}" for i in range(900)]
    return pd.DataFrame({"k": range(900), "c": cats, "y": 1e6 + rng.normal(size=900) * 3, "train": [i % 4 != 0 for i in range(900)]})


def _encode(spark, pdf):
    data = list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None))
    df = spark.createDataFrame(data, "k long, c string, y double, train boolean")
    out = encoding.target_encode(df, {"e": "c"}, "y", ["k"], F.col("train"))
    assert out.columns == ["k", "c", "y", "train", "e"]
    return {r["k"]: r["e"] for r in out.collect()}


def test_matches_brute_force(spark, rows):
    got = _encode(spark, rows)
    fold = rows.k.map(_fold)
    for i in range(0, 900, 7):
        r = rows.iloc[i]
        keep = rows.train & (fold != fold[i]) if r.train else rows.train
        assert got[i] == pytest.approx(_smooth(rows[keep], r.c if isinstance(r.c, str) else None), abs=1e-6)


def test_own_target_does_not_count(spark, rows):
    before = _encode(spark, rows)
    changed = rows.copy()
    row = int(changed.index[changed.train][5])
    changed.loc[row, "y"] += 500.0
    after = _encode(spark, changed)
    assert after[row] == pytest.approx(before[row], abs=1e-9)
    other = next(i for i in rows.index if rows.train[i] and _fold(i) != _fold(row) and rows.c[i] == rows.c[row])
    assert abs(after[other] - before[other]) > 1e-3


def test_unseen_and_constant_values(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "b", 5.0)], "k long, c string, y double")
    table, default = encoding.full_encoding(df, "c", "y")
    assert default == 5.0 and {r["c"]: r["encoded"] for r in table.collect()} == {"a": 5.0, "b": 5.0}
