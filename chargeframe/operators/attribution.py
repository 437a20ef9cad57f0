"""Contributions of features to the predictions of a tree ensemble.

Shapley values of the game in which unknown features are averaged along the trees by the training rows of the
branches (path-dependent tree attributions). Leaf by leaf: a leaf's value reaches a row by the features on its path, each
of which either holds for the row or is left to chance. The weights over subsets are an integral of a polynomial in
the share of known features, which Gauss-Legendre quadrature gives exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.operators.ensemble import Ensemble

#: Rows that are attributed together.
ROWS = 2048


def _paths(model: Ensemble, root: int) -> Iterator[tuple[float, dict[int, list[float]]]]:
    """Per leaf: its value, and per feature on the path the share of rows that chance sends on, and the bounds (low, high]."""
    stack = [(int(root), {})]
    while stack:
        node, path = stack.pop()
        feature = int(model.feature[node])
        if feature < 0:
            yield float(model.value[node]), path
            continue
        share, low, high = path.get(feature, (1.0, -np.inf, np.inf))
        cut = float(model.threshold[node])
        for child, bounds in ((model.left[node], (low, min(high, cut))), (model.right[node], (max(low, cut), high))):
            stack.append((int(child), {**path, feature: (share * model.rows[child] / model.rows[node], *bounds)}))


def expected(model: Ensemble) -> float:
    """The prediction with all features left to chance."""
    return model.base + model.rate * sum(value * np.prod([p[0] for p in path.values()])
                                         for root in model.roots for value, path in _paths(model, root))


def contributions(model: Ensemble, x: np.ndarray) -> np.ndarray:
    """(rows, features); a row's contributions sum to its prediction less ``expected``."""
    out = np.zeros(x.shape)
    for root in model.roots:
        for value, path in _paths(model, root):
            if not path or value == 0.0:
                continue
            features = np.array(list(path))
            share, low, high = np.array(list(path.values())).T
            t, w = np.polynomial.legendre.leggauss((len(features) + 1) // 2)
            t, w = (t + 1) / 2, w / 2
            for at in range(0, len(x), ROWS):
                own = x[at:at + ROWS][:, features]
                holds = (own > low) & (own <= high)
                factor = (share * (1 - t)[:, None])[:, None, :] + holds * t[:, None, None]  # points, rows, features
                weight = np.einsum("q,qr,qrf->rf", w, factor.prod(axis=2), 1 / factor)
                out[at:at + ROWS][:, features] += model.rate * value * (holds - share) * weight
    return out


def attribute(df: DataFrame, model: Ensemble, features: str = "features", out: str = "contributions") -> DataFrame:
    """Adds an array with a contribution per feature, for every row."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(contributions(model, np.stack(v.to_numpy()))) if len(v) else [], dtype=object)

    vectors = isinstance(df.schema[features].dataType, VectorUDT)
    return df.withColumn(out, run(vector_to_array(features) if vectors else F.col(features)))


def influence(df: DataFrame, model: Ensemble, names: list[str], features: str = "features") -> DataFrame:
    """Per feature: the mean size and the mean of its contributions over all rows, from one pass; no row is left out."""
    each = attribute(df.select(features), model, features).select(F.posexplode("contributions").alias("at", "c"))
    named = F.get(F.array(*map(F.lit, names)), F.col("at"))
    return each.groupBy("at").agg(F.avg(F.abs("c")).alias("mean_size"), F.avg("c").alias("mean_contribution")).select(
        named.alias("feature"), "mean_size", "mean_contribution")
