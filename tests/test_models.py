from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.operators import aggregates, learners, quantile
from chargeframe.plans import forecast as P
from chargeframe.plans.prepare import training_table
from chargeframe.registry.modelling import QUICK, QUICK_STACK
from chargeframe.runtime import materialize
from chargeframe.schemas import FEATURES, TARGET, TARGET_DERIVED, feature_set
from tests.conftest import SF


@pytest.fixture(scope="module")
def table(spark):
    return materialize(training_table(materialize(adapters.sessions(spark, SF))))


@pytest.fixture(scope="module")
def model(table):
    return P.fit_forecaster(table, mode="cqr", **QUICK)


def test_feature_sets():
    assert len(FEATURES) == 25 and feature_set("leaky") == FEATURES
    assert not set(feature_set("honest")) & set(TARGET_DERIVED)


def test_split_sizes_in_the_training_table(table):
    n = table.count()
    got = {r["split"]: r["n"] for r in table.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"test": 4 * n // 10, "val": n // 10, "train": n - 4 * n // 10 - n // 10}


def test_quantiles_on_known_noise(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 4000)
    y = x + rng.uniform(0, 1, 4000) * (1 + x)
    df = learners.assemble(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), ["x"])
    train, val, test = df.randomSplit([0.5, 0.2, 0.3], seed=1)
    models = quantile.fit_quantiles(train, val, label="y", rounds=15, depth=4, rate=0.4, patience=5)
    pred = quantile.predict_quantiles(models, test).cache()
    for a in quantile.ALPHAS:
        share = pred.agg(F.avg((F.col("y") <= F.col(quantile.column_name(a))).cast("int"))).first()[0]
        assert abs(share - a) < 0.06, (a, share)
    crossed = pred.filter((F.col("pred_05") > F.col("pred_median")) | (F.col("pred_median") > F.col("pred_95")))
    assert crossed.count() == 0


def test_early_stop_keeps_the_best_round(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(600, 2))], "x double, y double")
    train, val = learners.assemble(df, ["x"]).randomSplit([0.5, 0.5], seed=1)
    m = quantile.fit_quantiles(train, val, (0.5,), "y", rounds=12, depth=5, rate=0.9, patience=2, min_leaf=1)[0.5]
    assert m.rounds < 12


def test_forecast_table(table, model):
    pred = P.forecast(model, table.filter("split = 'test'"))
    assert pred.columns == ["sessionID", *P.FORECAST_COLUMNS]
    m = P.evaluate(pred).first()
    n = pred.count()
    assert n == table.filter("split = 'test'").count()
    # at least the nominal share, up to four standard errors
    assert m["pi_coverage"] >= 0.9 - 4 * (0.09 / n) ** 0.5
    assert m["ensemble_r2"] > 0.7


def test_saved_forecaster_scores_alike(spark, table, model, tmp_path):
    path = str(tmp_path / "m")
    model.save(spark, path)
    again = P.Forecaster.load(spark, path)
    assert again.features == model.features and again.q_hat == model.q_hat
    sessions = adapters.sessions(spark, SF).drop("habit_stability")
    cols = ["sessionID", "pred_point", "pred_median", "pred_05", "pred_95", "lower_conformal", "upper_conformal"]
    a, b = (sorted(map(tuple, m.score(sessions).select(*cols).collect())) for m in (model, again))
    assert a == b and len(a) == 1000


def test_stack_does_not_learn_from_its_own_rows(table):
    """With random targets, out-of-fold stacking must not look better in sample than a mean."""
    noise = learners.assemble(table, ["parsed_kWhRequested", "hour"]).withColumn(
        TARGET, F.pmod(F.xxhash64("sessionID"), F.lit(1000)) / 100.0)
    deep = {k: {**v, "maxDepth": 8} if k != "meta" else v for k, v in QUICK_STACK.items()}
    fit = {mode: learners.fit_stack(noise, "sessionID", folds=2, mode=mode, params=deep) for mode in ("oof", "in_sample")}
    r2 = {k: aggregates.regression_metrics(learners.predict_stack(m, noise), TARGET, "pred_point").first()["r2"] for k, m in fit.items()}
    assert r2["in_sample"] > r2["oof"]


def test_curve_and_importance(spark, table):
    parts = P.split_parts(learners.assemble(table, feature_set("honest")))
    m = learners.fit_baseline(parts["train"], parts["val"], rounds=6, depth=3, rate=0.3)
    curve = learners.training_curve(spark, m).orderBy("iteration").collect()
    assert len(curve) == m.rounds == 6 and curve[-1]["train_rmse"] < curve[0]["train_rmse"]
    end = aggregates.regression_metrics(m.transform(parts["train"]), TARGET, "prediction").first()
    assert curve[-1]["train_rmse"] == pytest.approx(end["rmse"]) and curve[-1]["train_r2"] == pytest.approx(end["r2"])
    feats = feature_set("honest")
    imp = learners.permutation_importance(lambda df: m.transform(learners.assemble(df, feats)), table, feats, TARGET, "sessionID").collect()
    assert imp[0]["feature"] == "parsed_kWhRequested" and len(imp) == len(feats)
    used = {feats[i] for i in m.model.feature if i >= 0}
    assert all(r["mae_increase"] == pytest.approx(0, abs=1e-9) for r in imp if r["feature"] not in used)


def test_search_prefers_the_lower_loss(table):
    parts = P.split_parts(learners.assemble(table, feature_set("honest")))
    draws = learners.draw_params(30)
    assert len(draws) == 30 and draws == learners.draw_params(30)
    assert all(5 <= d["maxDepth"] <= 7 and 0.01 <= d["stepSize"] <= 0.1 for d in draws)
    trials = learners.search(parts["train"], parts["val"], [{**draws[0], "stepSize": s} for s in (0.01, 0.3)], maxIter=4)
    best = aggregates.best_trial(trials, ["stepSize"]).first()
    assert best["mae"] == min(r["mae"] for r in trials.collect())


def test_ablation_arms():
    by_arm = P.arms(feature_set("leaky"))
    assert len(by_arm["WITH"]) == 25 and len(by_arm["WITHOUT"]) == 21
