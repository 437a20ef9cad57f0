"""Training table to probabilistic forecasts, evaluation and ablation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeframe.operators import aggregates, attribution
from chargeframe.operators.cleaning import SERVING_DEFAULTS, fill_defaults
from chargeframe.operators.encoding import full_encoding
from chargeframe.operators.joins import apply_encoding
from chargeframe.operators.learners import assemble, fit_stack, predict_stack
from chargeframe.operators.quantile import ALPHAS, QuantileModel, column_name, fit_quantiles, predict_quantiles
from chargeframe.plans.prepare import ENCODED, add_features
from chargeframe.runtime import union_all
from chargeframe.schemas import BEHAVIORAL, TARGET, feature_set
from chargeframe.sources import models as store

FORECAST_COLUMNS = ["true_kWh", "pred_point", "pred_median", "pred_05", "pred_95", "lower_conformal", "upper_conformal"]


def split_parts(table: DataFrame, split: str = "split") -> dict[str, DataFrame]:
    return {part: table.filter(F.col(split) == part) for part in ("train", "val", "test")}


def calibrate(pred: DataFrame, level: float = 0.90, mode: str = "reference") -> float:
    """Conformal radius of validation predictions, always computed from them."""
    score = aggregates.cqr_score() if mode == "cqr" else aggregates.absolute_score()
    return aggregates.conformal_radius(pred, score, level, mode)


@dataclass
class Forecaster:
    """Stacked point model, quantile models, radius, and the target encodings."""

    features: list[str]
    stack: PipelineModel
    quantiles: dict[float, QuantileModel]
    q_hat: float
    encodings: dict[str, tuple[DataFrame, float]]

    def predict(self, df: DataFrame) -> DataFrame:
        """Predictions for rows that hold all feature columns; a narrow plan."""
        df = predict_stack(self.stack, assemble(df, self.features))
        return aggregates.conformalize(predict_quantiles(self.quantiles, df), self.q_hat).drop("features")

    def encode(self, df: DataFrame) -> DataFrame:
        for out, (table, default) in self.encodings.items():
            col = ENCODED[out]
            df = apply_encoding(df, table, col, default, out) if col in df.columns else df.withColumn(out, F.lit(0.0))
        return df

    def score(self, sessions: DataFrame) -> DataFrame:
        """Predictions for arriving sessions; gaps take the serving defaults."""
        known = fill_defaults(sessions, {c: v for c, v in SERVING_DEFAULTS.items() if c not in sessions.columns})
        df = self.encode(add_features(known))
        return self.predict(fill_defaults(df, {c: 0.0 for c in self.features}))

    def save(self, spark: SparkSession, path: str) -> None:
        store.save_model(self.stack, f"{path}/stack")
        for alpha, model in self.quantiles.items():
            model.save(spark, f"{path}/{column_name(alpha)}")
        for out, (table, _) in self.encodings.items():
            store.save_table(table, f"{path}/{out}")
        defaults = [self.encodings[out][1] for out in ENCODED]
        store.save_table(spark.createDataFrame(
            [(self.features, self.q_hat, sorted(self.quantiles), defaults)],
            "features array<string>, q_hat double, alphas array<double>, defaults array<double>"), f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forecaster:
        s = store.load_table(spark, f"{path}/settings").first()
        quantiles = {a: QuantileModel.load(spark, f"{path}/{column_name(a)}") for a in s["alphas"]}
        encodings = {out: (store.load_table(spark, f"{path}/{out}"), d) for out, d in zip(ENCODED, s["defaults"])}
        return Forecaster(list(s["features"]), store.load_model(f"{path}/stack"), quantiles, s["q_hat"], encodings)


def fit_forecaster(table: DataFrame, key: str = "sessionID", features: list[str] | None = None,
                   alphas: tuple[float, ...] = ALPHAS, mode: str = "reference", folds: int = 5,
                   stack_params: dict | None = None, quantile_params: dict | None = None,
                   with_encodings: bool = True) -> Forecaster:
    """Fit everything on the train rows and calibrate on the validation rows."""
    features = features or feature_set("honest")
    parts = split_parts(assemble(table, features))
    stack = fit_stack(parts["train"], key, folds=folds, params=stack_params)
    quantiles = fit_quantiles(parts["train"], parts["val"], alphas, **(quantile_params or {}))
    val = predict_quantiles(quantiles, parts["val"]).withColumn("true_kWh", F.col(TARGET))
    q_hat = calibrate(val, mode=mode)
    train = table.filter("split = 'train'")
    encodings = {out: full_encoding(train, col, TARGET) for out, col in ENCODED.items()} if with_encodings else {}
    return Forecaster(features, stack, quantiles, q_hat, encodings)


def forecast(model: Forecaster, rows: DataFrame, key: str = "sessionID") -> DataFrame:
    """The prediction table of rows with known energy."""
    return model.predict(rows).withColumn("true_kWh", F.col(TARGET)).select(key, *FORECAST_COLUMNS)


def evaluate(pred: DataFrame) -> DataFrame:
    """Point and interval metrics in one pass."""
    inside = F.col("true_kWh").between(F.col("lower_conformal"), F.col("upper_conformal")).cast("int")
    return pred.agg(*[m.alias(f"ensemble_{n}") for m, n in zip(
        aggregates.metric_columns("true_kWh", "pred_point"), ("mae", "rmse", "r2"))],
        F.avg(inside).alias("pi_coverage"), F.avg(F.col("upper_conformal") - F.col("lower_conformal")).alias("pi_width"))


def arms(features: list[str], groups: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """WITH: every feature. One arm per group: without its features."""
    groups = groups or {"WITHOUT": BEHAVIORAL}
    return {"WITH": features, **{name: [f for f in features if f not in drop] for name, drop in groups.items()}}


def ablate(table: DataFrame, by_arm: dict[str, list[str]], key: str = "sessionID", **params) -> DataFrame:
    """Refit and evaluate per arm; one row of metrics each."""
    test, rows = table.filter("split = 'test'"), []
    for name, features in by_arm.items():
        model = fit_forecaster(table, key, features, with_encodings=False, **params)
        rows.append(evaluate(forecast(model, test, key)).select(
            F.lit(name).alias("behavioral"), "*", F.lit(model.q_hat).alias("q_hat")))
    return union_all(*rows)


def influence(model: Forecaster, rows: DataFrame) -> DataFrame:
    """Contributions of the features to the median of all given rows."""
    return attribution.influence(assemble(rows, model.features), model.quantiles[0.5].model, model.features)
