"""Point models: boosted trees over histograms; forest, stacking and search with Spark ML.

Only rows of parameters and metrics pass through the driver. The loops over
learners, folds, trials and arms submit independent Spark jobs from a few
threads, so that small jobs do not leave the cluster idle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeframe.functions.hashing import hash_fold, seeded_hash
from chargeframe.operators import boosting, ensemble
from chargeframe.operators.aggregates import metric_columns
from chargeframe.operators.ordering import global_row_number
from chargeframe.runtime import durable, durable_spread, shared_dir
from chargeframe.schemas import TARGET

# Settings of the learners.
BASELINE = boosting.Settings(rounds=1200, rate=0.05, depth=8, min_rows=1, l2=1.0, rows=0.85, columns=0.85, patience=60)
#: The three boosted base learners as settings of ``boosting``; the last grows best-first to its leaf limit.
BASE_SETTINGS = {
    "fine": boosting.Settings(rounds=600, rate=0.02, depth=7, min_rows=1, l2=1.0, rows=0.85, columns=0.85),
    "deep": boosting.Settings(rounds=800, rate=0.03, depth=8, min_rows=1, l2=4.0),
    "leafy": boosting.Settings(rounds=100, rate=0.0183, leaves=79, min_rows=20, l1=0.0098, l2=1.14e-6, rows=0.938, columns=0.964),
}
FOREST = {"numTrees": 400, "maxDepth": 10, "minInstancesPerNode": 2}
BOOSTED = {
    "fine": {"maxIter": 600, "maxDepth": 7, "stepSize": 0.02, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"},
    "deep": {"maxIter": 800, "maxDepth": 8, "stepSize": 0.03},
    # 79 leaves: the depth that holds them
    "leafy": {"maxIter": 100, "maxDepth": 7, "stepSize": 0.0183, "subsamplingRate": 0.938,
              "featureSubsetStrategy": "0.964"},
}
META = {"maxIter": 1000, "maxDepth": 6, "stepSize": 0.015, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
SEARCH_SPACE = {
    "leaves": (31, 127), "stepSize": (0.01, 0.1), "featureSubset": (0.7, 1.0), "subsamplingRate": (0.7, 1.0),
}
SEARCH_TRIALS = 30


def parallel(jobs: Iterable[Callable], threads: int = 4) -> list:
    """Results of independent Spark jobs, in order."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        futures = [pool.submit(job) for job in jobs]
        return [f.result() for f in futures]


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """The feature vector, in the order given; a gap is an error."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def _gbt(settings: dict, label: str, features: str, prediction: str, seed: int) -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol=features, predictionCol=prediction, seed=seed,
                        checkpointInterval=10, **settings)


@dataclass
class BoostedModel:
    """An ensemble and the errors of its rows after each round."""

    model: ensemble.Ensemble
    history: list
    features: str = "features"

    @property
    def rounds(self) -> int:
        return self.model.rounds

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.model.transform(df, self.features, out)


def fit_in_step(train: DataFrame, val: DataFrame | None, settings: list[boosting.Settings], label: str = TARGET,
                features: str = "features") -> list[BoostedModel]:
    """Boosted models with these settings from common passes over the rows."""
    rows = train.select(label, features, F.lit(False).alias("_val"))
    if val is not None:
        rows = rows.unionByName(val.select(label, features, F.lit(True).alias("_val")))
    return [BoostedModel(f.model, f.history, features) for f in boosting.fit(rows, settings, label, features)]


def fit_baseline(train: DataFrame, val: DataFrame, label: str = TARGET, features: str = "features", seed: int = 42,
                 **params) -> BoostedModel:
    """Boosted trees that stop after a number of rounds without a smaller validation error."""
    return fit_in_step(train, val, [replace(BASELINE, seed=seed, **params)], label, features)[0]


def training_curve(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """Train and validation RMSE, MAE and R² per round, as noted by the fit itself; one row per round."""
    def errors(sums: np.ndarray) -> list[float]:
        n, absolute, squares, _, total, total_squares = map(float, sums)
        if not n:
            return [float("nan")] * 3
        spread = total_squares - total * total / n
        return [(squares / n) ** 0.5, absolute / n, 1 - squares / spread if spread else float("nan")]

    names = ["train_rmse", "train_mae", "train_r2", "val_rmse", "val_mae", "val_r2"]
    schema = T.StructType([T.StructField("iteration", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in names])
    return spark.createDataFrame([(i, *errors(h[0]), *errors(h[1])) for i, h in enumerate(model.history[1:])], schema)


def fit_forest(df: DataFrame, label: str = TARGET, features: str = "features", prediction: str = "prediction",
               seed: int = 42, **params):
    est = RandomForestRegressor(labelCol=label, featuresCol=features, predictionCol=prediction, seed=seed,
                                **{**FOREST, **params})
    return est.fit(df)


def fit_boosted(df: DataFrame, variant: str, label: str = TARGET, features: str = "features",
                prediction: str = "prediction", seed: int = 42, **params):
    """One of the three boosted learners: fine, deep or leafy."""
    shared_dir(df.sparkSession)
    return _gbt({**BOOSTED[variant], **params}, label, features, prediction, seed).fit(df)


BASES = ["forest", *BOOSTED]
#: Base learners that are fitted at a time.
THREADS = 4


def _fit_base(df: DataFrame, name: str, label: str, features: str, seed: int, params: dict) -> Model:
    extra = params.get(name, {})
    if name == "forest":
        return fit_forest(df, label, features, "base_forest", seed, **extra)
    return fit_boosted(df, name, label, features, f"base_{name}", seed, **extra)


def fit_stack(train: DataFrame, key: str, label: str = TARGET, features: str = "features", folds: int = 5,
              mode: str = "oof", seed: int = 42, params: dict | None = None) -> PipelineModel:
    """Four base learners and a boosted learner over their predictions.

    ``oof``: the upper learner sees predictions of base models that did not
    train on the row. ``in_sample``: it sees predictions on their own training
    rows. ``params`` overrides settings per learner (forest, fine, deep,
    leafy, meta).
    """
    params = params or {}
    rows = durable_spread(train.select(key, label, features, hash_fold(seed, folds, key).alias("_fold")), key)

    def with_bases(models: list[Model], df: DataFrame) -> DataFrame:
        for m in models:
            df = m.transform(df)
        return df

    if mode not in ("oof", "in_sample"):
        raise ValueError(f"unknown mode {mode!r}")
    # the fits on all rows and those without a fold wait in one queue: most of a small fit's time is the start of its jobs
    tables = [rows, *(rows.filter(F.col("_fold") != f) for f in range(folds if mode == "oof" else 0))]
    fits = parallel([lambda n=n, df=df: _fit_base(df, n, label, features, seed, params) for df in tables for n in BASES], THREADS)
    final, *without = [fits[i:i + len(BASES)] for i in range(0, len(fits), len(BASES))]
    if mode == "oof":
        parts = [with_bases(models, rows.filter(F.col("_fold") == f)) for f, models in enumerate(without)]
        stacked = parts[0]
        for part in parts[1:]:
            stacked = stacked.unionByName(part)
    else:
        stacked = with_bases(final, rows)
    upper = VectorAssembler(inputCols=[f"base_{n}" for n in BASES], outputCol="stacked")
    table = durable(upper.transform(stacked).select(label, "stacked"))
    meta = _gbt({**META, **params.get("meta", {})}, label, "stacked", "pred_point", seed).fit(table)
    return PipelineModel(stages=[*final, upper, meta])


def predict_stack(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``pred_point``; the base predictions are dropped."""
    return model.transform(df).drop("stacked", *[f"base_{n}" for n in BASES])


def draw_params(n: int = SEARCH_TRIALS, seed: int = 42) -> list[dict]:
    """Seeded random settings; rates are drawn on a log scale.

    Leaf counts become the depth that holds them. L1 and L2 penalties have no
    counterpart in the learner and are left out.
    """
    rng = np.random.default_rng(seed)
    s = SEARCH_SPACE
    return [{
        "maxDepth": int(np.ceil(np.log2(rng.integers(s["leaves"][0], s["leaves"][1] + 1)))),
        "stepSize": float(np.exp(rng.uniform(*np.log(s["stepSize"])))),
        "featureSubsetStrategy": f"{rng.uniform(*s['featureSubset']):.4f}",
        "subsamplingRate": float(rng.uniform(*s["subsamplingRate"])),
    } for _ in range(n)]


def search(train: DataFrame, val: DataFrame, trials: list[dict], label: str = TARGET, features: str = "features",
           seed: int = 42, threads: int = 4, **common) -> DataFrame:
    """Validation MAE of every trial, one row each; see ``best_trial``."""
    spark = train.sparkSession
    train, val = durable_spread(train.select(label, features), label), durable(val.select(label, features))

    def run(p: dict) -> tuple:
        model = fit_boosted(train, "fine", label, features, seed=seed, lossType="absolute", **{**p, **common})
        mae = model.transform(val).agg(*metric_columns(label, "prediction")).first()["mae"]
        return (p["maxDepth"], p["stepSize"], p["featureSubsetStrategy"], p["subsamplingRate"], mae)

    schema = "maxDepth int, stepSize double, featureSubset string, subsamplingRate double, mae double"
    return spark.createDataFrame(parallel([lambda p=p: run(p) for p in trials], threads), schema)


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, features: list[str], y: str,
                           key: str, prediction: str = "prediction", seed: int = 42) -> DataFrame:
    """How much the error grows when one feature is taken from another row.

    All rows are put in a random cyclic order by a seeded hash, and every row
    receives the values of the next one; that is one sort and one join on the
    position, whatever the number of features. ``score`` adds ``prediction``
    to rows that hold the feature columns.
    """
    order: list[Column] = [seeded_hash(seed, key), F.col(key)]
    ranked = global_row_number(df.select(key, y, *features), order, "_rank")
    n = df.count()
    donors = ranked.select(F.pmod(F.col("_rank") + 1, F.lit(n)).alias("_rank"),
                           F.struct(*features).alias("_donor"))
    paired = ranked.join(donors, "_rank")
    versions = [F.struct(F.lit("(none)").alias("feature"), *features)]
    for name in features:
        versions.append(F.struct(F.lit(name).alias("feature"), *[
            F.col(f"_donor.{c}").alias(c) if c == name else F.col(c) for c in features]))
    rows = paired.select(y, F.inline(F.array(*versions)))
    # one row per feature
    mae = durable(score(rows).groupBy("feature").agg(F.avg(F.abs(F.col(y) - F.col(prediction))).alias("mae")))
    base = mae.filter("feature = '(none)'").first()["mae"]
    return (mae.filter("feature <> '(none)'").withColumn("mae_increase", F.col("mae") - F.lit(base))
            .orderBy(F.desc("mae_increase"), "feature"))

