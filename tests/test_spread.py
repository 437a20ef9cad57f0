from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe.registry import modelling
from chargeframe.operators import encoding


def test_sessions_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sessions = modelling._sessions(spark, str(tmp_path))
    files = sessions.groupBy(F.input_file_name()).count().collect()
    assert len(files) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in files) == events.count()


def test_folds_are_hashed_once_per_row(spark, monkeypatch):
    """All encodings come from one written table of the train rows' folds."""
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"),
                                 (F.col("id") % 11).cast("double").alias("y"), (F.col("id") % 4 > 0).alias("t"))
    seen = []
    fold_encodings = encoding.fold_encodings

    def noted(train, *args):
        seen.append(train._jdf.queryExecution().optimizedPlan().toString())
        return fold_encodings(train, *args)

    monkeypatch.setattr(encoding, "fold_encodings", noted)
    assert encoding.target_encode(df, {"ea": "a", "eb": "b"}, "y", ["k"], F.col("t")).count() == 300
    assert len(seen) == 2 and not any("md5" in plan for plan in seen)
