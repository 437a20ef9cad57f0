from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeframe.operators import attribution, boosting
from chargeframe.operators.boosting import Settings


def by_subsets(model, row, n):
    """Shapley values by enumerating the known features."""
    def value(known, node):
        feature = model.feature[node]
        if feature < 0:
            return model.value[node]
        left, right = model.left[node], model.right[node]
        if feature in known:
            return value(known, left if row[feature] <= model.threshold[node] else right)
        return (model.rows[left] * value(known, left) + model.rows[right] * value(known, right)) / model.rows[node]

    def game(known):
        return model.base + model.rate * sum(value(known, r) for r in model.roots)

    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            for known in combinations(rest, size):
                share = factorial(size) * factorial(n - size - 1) / factorial(n)
                out[i] += share * (game({*known, i}) - game(set(known)))
    return out, game(set())


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = x[:, 0] * (x[:, 1] > 0) + x[:, 2] ** 2 + x[:, 0]
    df = spark.createDataFrame([(a.tolist(), float(b), False) for a, b in zip(x, y)], "features array<double>, y double, _val boolean")
    settings = [Settings(6, 0.3, leaves=14, min_rows=3), Settings(4, 0.5, depth=4, min_rows=2, alpha=0.8), Settings(0, 0.5)]
    return df, x, [f.model for f in boosting.fit(df, settings, "y")]


def test_equal_to_subsets_and_sum_to_the_prediction(fitted):
    _, x, models = fitted
    for model in models:
        got = attribution.contributions(model, x)
        assert got.sum(axis=1) + attribution.expected(model) == pytest.approx(model.predict(x))
        for row, own in list(zip(x, got))[:25]:
            want, base = by_subsets(model, row, 5)
            assert own == pytest.approx(want, abs=1e-9) and base == pytest.approx(attribution.expected(model))


def test_every_row_is_attributed(fitted):
    df, x, (model, *_) = fitted
    got = attribution.attribute(df, model).collect()
    want = {tuple(a): c for a, c in zip(x, attribution.contributions(model, x))}
    assert len(got) == len(x) and all(r["contributions"] == pytest.approx(want[tuple(r["features"])]) for r in got)
    sizes = {r["feature"]: r["mean_size"] for r in attribution.influence(df, model, list("abcde")).collect()}
    assert sizes["a"] == pytest.approx(np.abs(attribution.contributions(model, x)[:, 0]).mean())
    assert min(sizes["a"], sizes["c"]) > max(sizes["d"], sizes["e"])
    assert attribution.influence(df.limit(0), model, list("abcde")).collect() == []
