from __future__ import annotations

from chargeframe import adapters
from chargeframe.streaming import jobs
from tests.conftest import SF


def test_only_new_files_are_processed(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        source = jobs.session_stream(spark, inbox, schema, files_per_batch=1)
        jobs.stream_augment(adapters.base_sessions(source), out, progress)
        return spark.read.parquet(out)

    spark.createDataFrame(events[:300], schema).coalesce(2).write.parquet(inbox)
    assert run().count() == 300
    assert run().count() == 300
    spark.createDataFrame(events[300:700], schema).coalesce(1).write.mode("append").parquet(inbox)
    got = run()
    assert got.count() == 700
    batch = adapters.augmented(adapters.base_sessions(spark.createDataFrame(events[:700], schema)))
    cols = ["sessionID", "urgency_score", "flexibility_index", "habit_stability"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
