"""NaN counts as missing, and repeated replies leave a session one row."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from chargeframe import runtime
from chargeframe.functions import jsontext
from chargeframe.operators import aggregates, cleaning

NAN = float("nan")


def test_active_sessions_with_nan(spark):
    rows = [("a", 10.0, NAN, NAN), ("b", NAN, 1.0, 60.0), ("c", 10.0, None, None), ("d", 10.0, 9.8, 60.0)]
    df = spark.createDataFrame(rows, "s string, parsed_kWhRequested double, kWhDelivered double, parsed_minutesAvailable double")
    got = {r["s"]: (r["remaining_kWh"], r["minutes_left"]) for r in cleaning.active_sessions(df).collect()}
    assert got == {"a": (10.0, 300.0), "c": (10.0, 300.0)}


def test_metrics_ignore_nan(spark):
    rows = [("x", 1.0, 2.0), ("x", 3.0, 3.0), ("y", 5.0, 4.0), ("y", NAN, 1.0), ("x", 2.0, NAN), ("y", None, 1.0)]
    df = spark.createDataFrame(rows, "site string, y double, p double")
    got = {r["site"]: r["mae"] for r in aggregates.metrics_with_total(df, "y", "p", "site").collect()}
    assert got == pytest.approx({"all": 2 / 3, "x": 0.5, "y": 1.0})
    levels = {r["alpha"]: r["pinball"] for r in aggregates.pinball_levels(df, "y", {0.5: "p", 0.9: "p"}).collect()}
    assert levels == pytest.approx({0.5: 1 / 3, 0.9: (0.1 * 1 + 0 + 0.9 * 1) / 3})
    assert aggregates.conformal_radius(df, F.abs(F.col("y") - F.col("p")), 0.5) == 1.0
    assert not math.isnan(aggregates.interval_metrics(df, "y", "p", "p").first()["width"])


def test_newest_usable_reply_counts(spark):
    def reply(urgency):
        return f'[{{"urgency_score": {urgency}, "flexibility_index": 0.5, "habit_stability": 0.4, "grid_impact_proxy": "low"}}]'

    sessions = spark.createDataFrame([("a", 100.0, 12.0, 1), ("b", 100.0, 12.0, 1)], "sessionID string, parsed_minutesAvailable double, parsed_kWhRequested double, revisionCount int")
    replies = spark.createDataFrame([("a", reply(10), 1), ("a", reply(20), 2), ("a", None, 3), ("b", None, 1)], "sessionID string, payload string, attempt int")
    got = {r["sessionID"]: (r["used_rules"], r["urgency_score"]) for r in jsontext.merge_augmented(sessions, replies, order="attempt").collect()}
    assert len(got) == 2 and got["a"] == (False, 20) and got["b"][0] is True


def test_scratch_is_in_a_shared_place(spark):
    assert runtime.shared_dir(spark).startswith((spark.conf.get("spark.sql.warehouse.dir"), spark.conf.get("spark.checkpoint.dir", "none")))


def test_nested_values_are_measured(spark):
    df = spark.createDataFrame([(["x" * 1000], {"k": "y" * 500}, b"z" * 300)], "a array<string>, m map<string,string>, b binary")
    assert df.agg(runtime._value_bytes(df).alias("n")).first()["n"] >= 1800


def test_large_paths_of_slices_and_samples(spark):
    """Both ways of slicing and sampling give the same rows; repeated keys do not make a sample larger."""
    from chargeframe.operators import ordering

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    for start, end in ((0, 3), (120, 131), (498, 600), (600, 700)):
        small = sorted(map(tuple, ordering.slice_rows(df, ["k"], start, end).collect()), key=str)
        assert sorted(map(tuple, ordering.slice_rows(df, ["k"], start, end, top_k_rows=0).collect()), key=str) == small
    with pytest.raises(IndexError):
        ordering.row_at(df, ["k"], 500)
    assert ordering.row_at(df, ["k"], 499).first()["k"] == 499
    twice = df.union(df)
    for n in (1, 7, 100, 999, 2000):
        assert ordering.sample_n(twice, "k", n, top_k_rows=0).count() == min(n, 1000)
    same = {r["k"] for r in ordering.sample_n(df, "k", 50).collect()}
    assert {r["k"] for r in ordering.sample_n(df, "k", 50, top_k_rows=0).collect()} == same


def test_ablation_in_one_pass(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.0), (2.0, 2.5, 4.0), (4.0, None, 3.0), (float("nan"), 1.0, 1.0)], "y double, a double, b double")
    runs = [aggregates.regression_metrics(df, "y", p).withColumn("arm", F.lit(arm)) for arm, p in (("WITH", "a"), ("WITHOUT", "b"))]
    want = sorted(map(tuple, aggregates.ablation_summary(runs).collect()))
    both = aggregates.ablation_of_predictions(df, "y", "a", "b")
    assert sorted(map(tuple, both.collect())) == want
    assert sorted(map(tuple, aggregates.ablation_of_predictions(df.limit(0), "y", "a", "b").collect()))[0][0] == "mae"
