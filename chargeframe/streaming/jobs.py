"""Resumable augmentation and scoring of arriving sessions.

Both jobs are stateless per row: a restart continues after the last committed
batch of the checkpoint, and no row is processed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chargeframe.functions.energy import behavior_rules
from chargeframe.plans.forecast import Forecaster


def session_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                   glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Files that land under ``path`` as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(df: DataFrame, out: str, checkpoint: str, fmt: str = "parquet", idle_batches: bool = True) -> StreamingQuery:
    """Process what has arrived since the last run, then stop.

    Without ``idle_batches`` no batch runs on timers alone: a state with timers asks for
    another batch after each, so the run would not stop.
    """
    spark = df.sparkSession
    before = spark.conf.get(IDLE_BATCHES)
    try:
        if not idle_batches:
            spark.conf.set(IDLE_BATCHES, "false")
        query = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
                 .option("path", out).trigger(availableNow=True).start())
    finally:
        spark.conf.set(IDLE_BATCHES, before)
    query.awaitTermination()
    return query


def stream_augment(source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rule-based behaviour columns for rows not yet augmented."""
    return run_available(source.withColumns(behavior_rules()), out, checkpoint)


def stream_score(source: DataFrame, model: Forecaster, out: str, checkpoint: str,
                 columns: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Features, stream-static encodings and interval forecasts."""
    scored = model.score(source)
    return run_available(columns(scored) if columns else scored, out, checkpoint)
