"""Learners, quantile models, forecasts and their evaluation.

Most results depend on tree learners that SQL cannot express; those queries
are checked by tests instead. Fits take larger rates and less patience than the published
settings; the rows are always all rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.operators import aggregates, attribution, ensemble, learners, quantile
from chargeframe.plans import forecast as P
from chargeframe.plans.prepare import training_table
from chargeframe.registry.book import Book, table
from chargeframe.registry.sql import SESSIONS, with_ctes
from chargeframe.runtime import durable_spread, materialize, scratch_path, spread
from chargeframe.schemas import TARGET, feature_set
from chargeframe.sources import models as store

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

QUICK_STACK = {
    "forest": {"numTrees": 20, "maxDepth": 5}, "fine": {"maxIter": 8, "maxDepth": 4, "stepSize": 0.2},
    "deep": {"maxIter": 8, "maxDepth": 5, "stepSize": 0.2}, "leafy": {"maxIter": 8, "maxDepth": 4, "stepSize": 0.2},
    "meta": {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3},
}
#: The published tree limits, with a larger rate and a smaller patience, so that the fits end after tens of rounds.
QUICK_QUANTILE = {"leaves": 79, "depth": 6, "rate": 0.3, "patience": 3}
QUICK_BOOSTED = {"rate": 0.3, "patience": 5}
QUICK = {"folds": 2, "stack_params": QUICK_STACK, "quantile_params": QUICK_QUANTILE}


def _sessions(spark, sf):
    """The session table as the cleaning steps leave it in storage."""
    events = spread(table(spark, sf, "events"), "event_id")
    return materialize(adapters.augmented(adapters.base_sessions(events)), "sessions")


def _table(spark, sf):
    return materialize(training_table(_sessions(spark, sf)), "training")


def _parts(spark, sf):
    """Train, validation and test rows with their feature vectors."""
    # read once, so that only these columns of the training table are computed and written
    rows = learners.assemble(training_table(_sessions(spark, sf)), feature_set("honest")).select("sessionID", "split", TARGET, "features")
    return P.split_parts(durable_spread(rows, "sessionID"))


def _r(c, n=6):
    return F.round(c, n).alias(c)


#: The row features in the order of the vector, as SQL over the sessions; the two target encodings have queries of their own.
_ROW_FEATURES = {
    "parsed_milesRequested": '"parsed_milesRequested"', "parsed_WhPerMile": '"parsed_WhPerMile"',
    "parsed_minutesAvailable": '"parsed_minutesAvailable"', "parsed_kWhRequested": '"parsed_kWhRequested"',
    "revisionCount": '"revisionCount"', "hour": 'hour("connectionTime")', "day_of_week_encoded": 'isodow("connectionTime") - 1',
    "is_weekend": '(isodow("connectionTime") >= 6)::INT', "is_peak": '(hour("connectionTime") BETWEEN 17 AND 21)::INT',
    "urgency_score": "urgency_score", "flexibility_index": "flexibility_index", "habit_stability": "habit_stability",
    "grid_impact_proxy": "grid", "urgency_flex_interaction": "urgency_score * flexibility_index",
    "revision_urgency": '"revisionCount" * urgency_score', "habit_grid": "habit_stability * grid",
    "energy_per_minute": '"parsed_kWhRequested" / ("parsed_minutesAvailable" + 1e-5)',
    "request_efficiency": '"parsed_milesRequested" / ("parsed_WhPerMile" + 1e-5)',
    "duration_hours": """date_diff('microsecond', "connectionTime", "disconnectTime") / 3.6e9""",
    "charging_efficiency": '"kWhDelivered" / "parsed_kWhRequested"', "requested_gap": '"parsed_kWhRequested" - "kWhDelivered"',
    "hour_sin": 'sin(2 * pi() * hour("connectionTime") / 24)', "hour_cos": 'cos(2 * pi() * hour("connectionTime") / 24)',
}


@B.query("feature_matrix", with_ctes("SELECT " + ", ".join(
    f'round(sum(({sql})::DOUBLE), 2) + 0e0 AS "{name}", round(sum(({sql})::DOUBLE ** 2), 2) + 0e0 AS "{name}_squares"'
    for name, sql in _ROW_FEATURES.items()) + ", count(*) AS n_rows FROM known", SESSIONS, """
known AS (
  SELECT *, CASE grid_impact_proxy WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS grid FROM sessions
  WHERE "kWhDelivered" IS NOT NULL AND "parsed_minutesAvailable" IS NOT NULL
    AND "parsed_kWhRequested" <> 0 AND grid_impact_proxy IN ('low', 'medium', 'high'))"""))
def feature_matrix(spark, sf):
    """Sums and sums of squares of the row features, read back from the vectors of all 25 features by position."""
    from pyspark.ml.functions import vector_to_array

    names = feature_set("leaky")
    v = learners.assemble(training_table(_sessions(spark, sf)), names).select(vector_to_array("features").alias("v"))
    sums = [F.round(F.sum(at ** power), 2).alias(name + end) for name in _ROW_FEATURES
            for at in [F.get("v", F.lit(names.index(name)))] for power, end in ((1, ""), (2, "_squares"))]
    return v.agg(F.count("*").alias("n_rows"), *sums)


@B.query("boosted_baseline")
def boosted_baseline(spark, sf):
    parts = _parts(spark, sf)
    model = learners.fit_baseline(parts["train"], parts["val"], **QUICK_BOOSTED)
    return aggregates.regression_metrics(model.transform(parts["test"]), TARGET, "prediction")


@B.query("training_curve")
def training_curve(spark, sf):
    parts = _parts(spark, sf)
    return learners.training_curve(spark, learners.fit_baseline(parts["train"], parts["val"], **QUICK_BOOSTED))


@B.query("forest_base")
def forest_base(spark, sf):
    parts = _parts(spark, sf)
    model = learners.fit_forest(parts["train"], **QUICK_STACK["forest"])
    return aggregates.regression_metrics(model.transform(parts["test"]), TARGET, "prediction")


@B.query("boosted_bases")
def boosted_bases(spark, sf):
    parts = _parts(spark, sf)
    settings = [replace(s, **QUICK_BOOSTED) for s in learners.BASE_SETTINGS.values()]
    fits = learners.fit_in_step(parts["train"], parts["val"], settings)
    scored = ensemble.predict(parts["test"], {f"p_{v}": m.model for v, m in zip(learners.BASE_SETTINGS, fits)})
    runs = [F.struct(*aggregates.metric_columns(TARGET, f"p_{v}"), F.lit(v).alias("variant")) for v in learners.BASE_SETTINGS]
    return scored.agg(F.array(*runs).alias("r")).select(F.inline("r"))


@B.query("stacked_ensemble")
def stacked_ensemble(spark, sf):
    parts = _parts(spark, sf)
    model = learners.fit_stack(parts["train"], "sessionID", folds=2, params=QUICK_STACK)
    return aggregates.regression_metrics(learners.predict_stack(model, parts["test"]), TARGET, "pred_point")


@B.query("quantile_models")
def quantile_models(spark, sf):
    """Share of test rows at or below each level, in one scoring pass."""
    parts = _parts(spark, sf)
    models = quantile.fit_quantiles(parts["train"], parts["val"], **QUICK_QUANTILE)
    pred = quantile.predict_quantiles(models, parts["test"])
    shares = [F.struct(F.lit(a).alias("alpha"), F.avg((F.col(TARGET) <= F.col(quantile.column_name(a))).cast("int")).alias("share"))
              for a in quantile.ALPHAS]
    return pred.agg(F.array(*shares).alias("r")).select(F.inline("r"))


@B.query("probabilistic_forecast")
def probabilistic_forecast(spark, sf):
    table = _table(spark, sf)
    model = P.fit_forecaster(table, with_encodings=False, **QUICK)
    return P.forecast(model, table.filter("split = 'test'"))


@B.query("param_search")
def param_search(spark, sf):
    parts = _parts(spark, sf)
    trials = learners.search(parts["train"], parts["val"], learners.draw_params(4), maxIter=6)
    return aggregates.best_trial(trials, ["maxDepth", "stepSize", "featureSubset", "subsamplingRate"])


@B.query("feature_ablation")
def feature_ablation(spark, sf):
    return P.ablate(_table(spark, sf), P.arms(feature_set("honest")), **QUICK)


@B.query("feature_influence")
def feature_influence(spark, sf):
    """Contributions of each feature to the median of every test row."""
    parts, features = _parts(spark, sf), feature_set("honest")
    median = quantile.fit_quantiles(parts["train"], parts["val"], (0.5,), **QUICK_QUANTILE)[0.5]
    return attribution.influence(parts["test"], median.model, features).select("feature", _r("mean_size"), _r("mean_contribution"))


_TABLE_ROWS = with_ctes("""
SELECT count(*) AS n_rows, 0 AS n_different FROM sessions
WHERE "kWhDelivered" IS NOT NULL AND "parsed_minutesAvailable" IS NOT NULL
  AND "parsed_kWhRequested" <> 0 AND grid_impact_proxy IN ('low', 'medium', 'high')""", SESSIONS)


@B.query("model_store", _TABLE_ROWS)
def model_store(spark, sf):
    """Rows whose prediction changes when the models are saved and loaded again."""
    path = scratch_path(spark, "models")
    rows = learners.assemble(_table(spark, sf), feature_set("honest"))
    stack = PipelineModel(stages=[learners.fit_forest(rows, prediction="p_forest", numTrees=10, maxDepth=4)])
    parts = P.split_parts(rows)
    median = quantile.fit_quantiles(parts["train"], parts["val"], (0.5,), rounds=3, depth=4, rate=0.3)[0.5]
    store.save_model(stack, f"{path}/forest")
    median.save(spark, f"{path}/median")
    before = median.transform(stack.transform(rows))
    again = quantile.QuantileModel.load(spark, f"{path}/median").transform(
        store.load_model(f"{path}/forest").transform(
            before.withColumnsRenamed({"p_forest": "old_forest", "pred_median": "old_median"})))
    different = (F.col("p_forest") != F.col("old_forest")) | (F.col("pred_median") != F.col("old_median"))
    return again.agg(F.count("*").alias("n_rows"), F.count_if(different).alias("n_different"))

