"""Aggregations, metrics and conformal radii."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.functions.energy import known
from chargeframe.operators.ordering import order_statistics, sorted_counts


def _grouped(df: DataFrame, by):
    return df.groupBy(*by) if by else df.groupBy()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, nulls kept, most frequent first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(col))


def describe_text(df: DataFrame, col: str) -> DataFrame:
    """count, unique, top and freq of a text column; ties to the smallest text."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("v")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"), F.count("*").alias("unique"),
                      best.alias("b")).select("count", "unique", F.col("b.v").alias("top"), (-F.col("b.neg")).alias("freq"))


def metric_columns(y: str, p: str) -> list[Column]:
    """MAE, RMSE and R² = 1 − SSE/SST as aggregates of one pass; rows with a null or NaN do not count."""
    err = known(y) - known(p)
    sst = F.count(err) * F.var_pop(F.when(err.isNotNull(), F.col(y)))
    return [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            (F.lit(1.0) - F.sum(err * err) / F.nullif(sst, F.lit(0.0))).alias("r2")]


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return _grouped(df, by).agg(*metric_columns(y, p))


def metrics_with_total(df: DataFrame, y: str, p: str, by: str, total: str = "all") -> DataFrame:
    """The metrics of each group and, under the name ``total``, of all rows, in one pass."""
    out = df.rollup(by).agg(F.grouping(by).alias("_all"), *metric_columns(y, p))
    return out.withColumn(by, F.when(F.col("_all") == 1, total).otherwise(F.col(by))).drop("_all")


def interval_metrics(df: DataFrame, y: str, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """Share of rows inside the interval, and its mean width."""
    inside = known(y).between(known(lo), known(hi)).cast("int")
    return _grouped(df, by).agg(F.avg(inside).alias("coverage"), F.avg(known(hi) - known(lo)).alias("width"))


def pinball_column(y: str, q: str, alpha: float) -> Column:
    """Mean quantile loss at level ``alpha``; rows with a null or NaN do not count."""
    err = known(y) - known(q)
    return F.avg(F.greatest(F.lit(alpha) * err, F.lit(alpha - 1.0) * err))


def pinball(df: DataFrame, y: str, q: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    return _grouped(df, by).agg(pinball_column(y, q, alpha).alias("pinball"))


def pinball_levels(df: DataFrame, y: str, columns: dict[float, str]) -> DataFrame:
    """(alpha, pinball) for several levels, in one pass."""
    rows = [F.struct(F.lit(a).alias("alpha"), pinball_column(y, q, a).alias("pinball")) for a, q in columns.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def absolute_score(y: str = "true_kWh", median: str = "pred_median") -> Column:
    """Distance from the median prediction."""
    return F.abs(F.col(y) - F.col(median))


def cqr_score(y: str = "true_kWh", lo: str = "pred_05", hi: str = "pred_95") -> Column:
    """How far the value lies outside the interval; negative inside."""
    return F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))


def conformal_radius(df: DataFrame, score: Column, level: float = 0.90, mode: str = "reference") -> float:
    """The calibrated radius from validation rows.

    ``reference``: the linearly interpolated quantile at ``level``. ``cqr``:
    the score of rank ⌈(n+1)·level⌉, which gives finite-sample coverage.
    ``approximate``: a mergeable sketch for tables where even one sort of the
    score column is too much.
    """
    scores = df.select(known(score).alias("_score")).filter(F.col("_score").isNotNull())
    if mode == "approximate":
        return scores.agg(F.percentile_approx("_score", level, 100_000).alias("q")).first()["q"]
    counts = sorted_counts(scores, "_score")
    n = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    if n == 0:
        raise ValueError("no validation rows to calibrate on")
    if mode == "reference":
        at = (n - 1) * level
        lo, hi = math.floor(at), math.ceil(at)
    elif mode == "cqr":
        rank = math.ceil(round((n + 1) * level, 9))
        if rank > n:
            return math.inf
        at = lo = hi = rank - 1
    else:
        raise ValueError(f"unknown mode {mode!r}")
    found = {r["rank"]: r["value"] for r in order_statistics(counts, [lo, hi]).collect()}
    return found[lo] + (found[hi] - found[lo]) * (at - lo)


def conformalize(df: DataFrame, q_hat: float, lo: str = "pred_05", hi: str = "pred_95") -> DataFrame:
    return df.withColumns({"lower_conformal": F.col(lo) - F.lit(q_hat), "upper_conformal": F.col(hi) + F.lit(q_hat)})


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population standard deviation, one row per column, in one pass."""
    entries = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"),
                        F.stddev_pop(F.col(c).cast("double")).alias("std")) for c in cols]
    return df.agg(F.array(*entries).alias("s")).select(F.inline("s"))


def standardize(df: DataFrame, stats: DataFrame) -> DataFrame:
    """z-scores; a constant column is only centred. ``stats`` has one row per column."""
    moments = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in moments.items()})


def ablation_summary(runs: list[DataFrame], arm: str = "arm", metrics: tuple[str, ...] = ("mae", "rmse", "r2"),
                     base: str = "WITH", other: str = "WITHOUT") -> DataFrame:
    """One row per metric: its value in either arm, and other − base."""
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    long = rows.select(arm, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    wide = long.groupBy("metric").pivot(arm, [base, other]).agg(F.first("value"))
    return wide.withColumn("delta", F.col(other) - F.col(base))


def ablation_of_predictions(df: DataFrame, y: str, base_p: str, other_p: str, metrics: tuple[str, ...] = ("mae", "rmse", "r2"),
                            base: str = "WITH", other: str = "WITHOUT") -> DataFrame:
    """``ablation_summary`` of two prediction columns of one table, in one pass over its rows."""
    arms = df.agg(F.struct(*metric_columns(y, base_p)).alias("_base"), F.struct(*metric_columns(y, other_p)).alias("_other"))
    wide = arms.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_base.{m}").cast("double").alias(base),
                 F.col(f"_other.{m}").cast("double").alias(other)) for m in metrics])))
    return wide.withColumn("delta", F.col(other) - F.col(base))


def split_counts(df: DataFrame, month: str = "month", split: str = "split") -> DataFrame:
    return (df.groupBy(month).pivot(split, ["train", "val", "test"]).agg(F.count(F.lit(1)))
            .na.fill(0, ["train", "val", "test"]))


def best_trial(trials: DataFrame, params: list[str], loss: str = "mae") -> DataFrame:
    """The parameters with the lowest loss; ties to the smallest parameters."""
    best = F.min(F.struct(F.col(loss), F.struct(*params).alias("p")))
    return trials.agg(best.alias("b")).select("b.p.*", F.col(f"b.{loss}").alias(loss))
