"""Boosted quantile models.

Trees are fitted to the gradient of the pinball loss; the leaf values are the α-quantiles of the residuals in the
leaves (gradient boosting with line search per leaf, Friedman 2001). The levels are fitted in step: one
pass over the rows serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeframe.operators import boosting, ensemble
from chargeframe.operators.boosting import Settings
from chargeframe.schemas import TARGET

# Fixed values.
ALPHAS = (0.05, 0.50, 0.95)
ROUNDS, RATE, PATIENCE = 1500, 0.03, 100


def column_name(alpha: float) -> str:
    return "pred_median" if alpha == 0.5 else f"pred_{round(alpha * 100):02d}"


@dataclass
class QuantileModel:
    """The ensemble of one level."""

    alpha: float
    model: ensemble.Ensemble
    features: str = "features"

    @property
    def rounds(self) -> int:
        return self.model.rounds

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return self.model.transform(df, self.features, out or column_name(self.alpha))

    def save(self, spark: SparkSession, path: str) -> None:
        """One table of nodes."""
        table = self.model.table(spark, self.features).withColumn("alpha", F.lit(self.alpha))
        table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> QuantileModel:
        table = spark.read.parquet(path)
        row = table.select("alpha", "kind").first()
        return QuantileModel(row["alpha"], ensemble.Ensemble.of(table), row["kind"])


def fit_quantiles(train: DataFrame, val: DataFrame, alphas: tuple[float, ...] = ALPHAS, label: str = TARGET,
                  features: str = "features", rounds: int = ROUNDS, depth: int | None = 6, rate: float = RATE,
                  patience: int = PATIENCE, min_leaf: int = 20, seed: int = 42, **more) -> dict[float, QuantileModel]:
    """One model per level; each keeps the rounds up to its smallest validation loss.

    ``more`` takes the other settings of ``boosting.Settings``: leaf limit, penalties, shares of rows and columns.
    """
    cols = [label, features]
    both = train.select(*cols, F.lit(False).alias("_val")).unionByName(val.select(*cols, F.lit(True).alias("_val")))
    settings = [Settings(rounds, rate, depth=depth, min_rows=min_leaf, patience=patience, alpha=a, seed=seed, **more) for a in alphas]
    return {a: QuantileModel(a, f.model, features) for a, f in zip(alphas, boosting.fit(both, settings, label, features))}


def predict_quantiles(models: dict[float, QuantileModel], df: DataFrame) -> DataFrame:
    """One column per level, from one pass; crossing predictions are put in order."""
    levels = sorted(models)
    names = [column_name(a) for a in levels]
    df = ensemble.predict(df, {n: models[a].model for n, a in zip(names, levels)}, models[levels[0]].features)
    return df.withColumn("_q", F.array_sort(F.array(*names))).withColumns(
        {name: F.get("_q", F.lit(i)) for i, name in enumerate(names)}).drop("_q")
