"""Tree ensembles as one flat table of nodes.

A model of any number of trees is four arrays of nodes and the roots' positions. One vectorised function walks all
trees, so a plan has the same size for one round and for thousands, and a model is stored as one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that walk the trees together.
ROWS = 2048

_NODE = "tree int, node int, feature int, threshold double, left int, right int, value double, rows double"
_SCHEMA = f"{_NODE}, base double, rate double, kind string"


@dataclass
class Ensemble:
    """``base + rate * sum of the trees' leaf values``.

    A row goes left where its feature is at most the threshold; ``left`` and ``right`` are positions in the arrays, a leaf has
    feature -1. ``rows`` counts the training rows of a node.
    """

    base: float
    rate: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @property
    def rounds(self) -> int:
        return len(self.roots)

    def first(self, rounds: int) -> Ensemble:
        """The model after some rounds."""
        end = int(self.roots[rounds]) if rounds < self.rounds else len(self.feature)
        return Ensemble(self.base, self.rate, self.roots[:rounds], *(a[:end] for a in (
            self.feature, self.threshold, self.left, self.right, self.value, self.rows)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x`` (rows, features)."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), ROWS):
            part = x[at:at + ROWS]
            own = np.arange(len(part))
            for root in self.roots:
                node = np.full(len(part), root)
                while True:
                    feature = self.feature[node]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    down = np.where(part[own, feature] <= self.threshold[node], self.left[node], self.right[node])
                    node = np.where(inner, down, node)
                out[at:at + ROWS] += self.rate * self.value[node]
        return out

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        return predict(df, {out: self}, features)

    def table(self, spark: SparkSession, kind: str = "") -> DataFrame:
        """One row per node, with the model's settings repeated; a model without trees has one row without a node."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        rows = [(int(tree[i]), i, int(self.feature[i]), float(self.threshold[i]), int(self.left[i]), int(self.right[i]),
                 float(self.value[i]), float(self.rows[i]), self.base, self.rate, kind) for i in range(len(self.feature))]
        return spark.createDataFrame(rows or [(None,) * 8 + (self.base, self.rate, kind)], _SCHEMA).coalesce(1)

    @staticmethod
    def of(table: DataFrame) -> Ensemble:
        """The model of such a table, in one read."""
        rows = sorted(table.collect(), key=lambda r: -1 if r["node"] is None else r["node"])
        own = [r for r in rows if r["node"] is not None]
        column = lambda name, kind: np.array([r[name] for r in own], kind)
        tree = column("tree", np.int64)
        roots = np.flatnonzero(np.diff(tree, prepend=-1)) if len(own) else np.zeros(0, np.int64)
        return Ensemble(rows[0]["base"], rows[0]["rate"], roots, column("feature", np.int64), column("threshold", float),
                        column("left", np.int64), column("right", np.int64), column("value", float), column("rows", float))


def scores(models: list[Ensemble], features: Column) -> Column:
    """The models' predictions of a column of feature arrays as one array, by Arrow batches."""
    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 0))
            yield pd.Series(list(np.stack([m.predict(x) for m in models], axis=1)) if len(v) else [], dtype=object)
    return score(features)


def predict(df: DataFrame, models: dict[str, Ensemble], features: str = "features") -> DataFrame:
    """A column per model, all from one pass over the feature vectors."""
    vectors = isinstance(df.schema[features].dataType, VectorUDT)
    out = df.withColumn("_scores", scores(list(models.values()), vector_to_array(features) if vectors else F.col(features)))
    return out.withColumns({name: F.get("_scores", F.lit(i)) for i, name in enumerate(models)}).drop("_scores")


def build(base: float, rate: float, trees: list[dict]) -> Ensemble:
    """From trees of arrays whose children are positions within the tree."""
    sizes = [len(t["feature"]) for t in trees]
    roots = np.cumsum([0, *sizes])[:-1].astype(np.int64)
    joined = {k: np.concatenate([np.asarray(t[k]) + (r if k in ("left", "right") else 0) for t, r in zip(trees, roots)]) if trees else np.zeros(0)
              for k in ("feature", "threshold", "left", "right", "value", "rows")}
    whole = {k: joined[k].astype(np.int64) for k in ("feature", "left", "right")}
    return Ensemble(base, rate, roots, whole["feature"], joined["threshold"].astype(float), whole["left"], whole["right"],
                    joined["value"].astype(float), joined["rows"].astype(float))
