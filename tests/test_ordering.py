from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeframe.operators import aggregates, ordering
from chargeframe.runtime import attach_small


def _hash(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one stratum and a third of the values equal."""
    rows = [(i, 1 if i % 3 == 0 else i % 11 + 2 if i % 50 else None, 7.0 if i % 3 == 0 else float(i * 37 % 1001))
            for i in range(5000)]
    return spark.createDataFrame(rows, "k long, m int, v double").repartition(7).cache()


def test_row_numbers_are_dense_and_ordered(skewed):
    got = ordering.global_row_number(skewed, ["v", "k"], "n").select("n", "v", "k").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5000))
    assert [(r["v"], r["k"]) for r in got] == sorted((r["v"], r["k"]) for r in got)


def test_split_is_exact_and_follows_the_hash(skewed):
    rows = ordering.stratified_split(skewed, "m", "k").collect()
    assert len(rows) == 5000
    by = {}
    for r in rows:
        by.setdefault(r["m"], []).append(r)
    for m, group in by.items():
        ranked = sorted(group, key=lambda r: (_hash(42, r["k"]), r["k"]))
        n = len(group)
        t, v = 4 * n // 10, n // 10
        want = ["train"] * n if m is None else ["test"] * t + ["val"] * v + ["train"] * (n - t - v)
        assert [r["split"] for r in ranked] == want


def test_split_of_tiny_strata(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 3)], "k long, m int")
    got = {(r["m"], r["split"]): r["n"] for r in ordering.stratified_split(df, "m", "k").groupBy("m", "split").agg(
        F.count("*").alias("n")).collect()}
    assert got == {(1, "train"): 1, (2, "train"): 2, (3, "test"): 1, (3, "train"): 2}


def test_hash_split_shares(skewed):
    got = {r["split"]: r["n"] for r in ordering.stratified_split(skewed, "m", "k", exact=False).filter(
        "m IS NOT NULL").groupBy("split").agg(F.count("*").alias("n")).collect()}
    total = sum(got.values())
    assert abs(got["test"] / total - 0.4) < 0.03 and abs(got["val"] / total - 0.1) < 0.02


def test_large_sample_equals_small_path(skewed, monkeypatch):
    small = sorted(r["k"] for r in ordering.sample_n(skewed, "k", 300).collect())
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 10)
    assert sorted(r["k"] for r in ordering.sample_n(skewed, "k", 300).collect()) == small
    assert ordering.sample_n(skewed, "k", 9999).count() == 5000


def test_slices_and_rows(skewed, monkeypatch):
    order = ["v", "k"]
    want = [r["k"] for r in skewed.orderBy(*order).collect()]
    assert [r["k"] for r in ordering.slice_rows(skewed, order, 40, 60).orderBy(*order).collect()] == want[40:60]
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 10)
    assert [r["k"] for r in ordering.slice_rows(skewed, order, 40, 60).orderBy(*order).collect()] == want[40:60]
    assert ordering.row_at(skewed, order, 4999).first()["k"] == want[4999]
    for idx in (-1, 5000):
        with pytest.raises(IndexError):
            ordering.row_at(skewed, order, idx)


def test_batches(skewed):
    sizes = [r["n"] for r in ordering.batch_id(skewed, ["k"], 64).groupBy("batch_id").agg(
        F.count("*").alias("n")).orderBy("batch_id").collect()]
    assert sizes == [64] * 78 + [8]


def test_order_statistics_with_a_hot_value(skewed):
    values = np.sort([r["v"] for r in skewed.collect()])
    ranks = [0, 10, 1500, 2500, 4999]
    got = {r["rank"]: r["value"] for r in ordering.order_statistics(ordering.sorted_counts(skewed, "v"), ranks).collect()}
    assert got == {r: values[r] for r in ranks}


@pytest.mark.parametrize("level", [0.5, 0.9, 0.937])
def test_radius_matches_linear_interpolation(skewed, level):
    values = [r["v"] for r in skewed.collect()]
    assert aggregates.conformal_radius(skewed, F.col("v"), level) == pytest.approx(np.quantile(values, level))
    rank = int(np.ceil(5001 * level))
    assert aggregates.conformal_radius(skewed, F.col("v"), level, "cqr") == np.sort(values)[rank - 1]
    approx = aggregates.conformal_radius(skewed, F.col("v"), level, "approximate")
    assert abs(approx - np.quantile(values, level)) <= 2.0


def test_radius_needs_enough_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert aggregates.conformal_radius(df, F.col("v"), 0.9, "cqr") == float("inf")
    with pytest.raises(ValueError):
        aggregates.conformal_radius(df.filter("v > 5"), F.col("v"))


def test_factorize_first_seen_with_null(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, None), (4, "c"), (5, "a")], "o int, v string")
    got = {r["o"]: r["v_code"] for r in ordering.factorize(df, "v", ["o"]).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: 3}


def test_size_checked_join_gives_the_same_rows(skewed):
    side = skewed.groupBy("m").agg(F.avg("v").alias("a"))
    rows = [sorted(map(str, attach_small(skewed, side, ["m"], "left", size).collect())) for size in (0, 1 << 20)]
    assert rows[0] == rows[1]


def test_metrics(skewed):
    pdf = skewed.withColumn("p", F.col("v") * 0.9 + 3).toPandas()
    got = aggregates.regression_metrics(skewed.withColumn("p", F.col("v") * 0.9 + 3), "v", "p").first()
    err = pdf.v - pdf.p
    assert got["mae"] == pytest.approx(err.abs().mean())
    assert got["rmse"] == pytest.approx((err ** 2).mean() ** 0.5)
    assert got["r2"] == pytest.approx(1 - (err ** 2).sum() / ((pdf.v - pdf.v.mean()) ** 2).sum())
