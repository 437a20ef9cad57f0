"""Incremental jobs, run over the events file as it would arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.plans import forecast as P
from chargeframe.registry import features
from chargeframe.registry.book import Book, table
from chargeframe.registry.modelling import QUICK, _table
from chargeframe.registry.sql import BASE, SESSIONS, with_ctes
from chargeframe.runtime import scratch_path, spread
from chargeframe.streaming import jobs, replies

B = Book()
QUERIES, ORACLE = B.queries, B.oracle


def _events_stream(spark, sf):
    return jobs.session_stream(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")


def _spread_sessions(events):
    return adapters.augmented(adapters.base_sessions(spread(events, "event_id")))


@B.query("incremental_augment", with_ctes("""
SELECT "sessionID", urgency_score, round(flexibility_index, 9) AS flexibility_index,
  round(habit_stability, 9) AS habit_stability,
  CASE WHEN coalesce(nullif("parsed_kWhRequested", 0), 10e0) > 30 THEN 'high'
    WHEN coalesce(nullif("parsed_kWhRequested", 0), 10e0) > 10 THEN 'medium' ELSE 'low' END AS grid_impact_proxy
FROM sessions""", SESSIONS))
def incremental_augment(spark, sf):
    """Two runs over the same checkpoint: the second adds nothing."""
    out, checkpoint = scratch_path(spark, "augmented"), scratch_path(spark, "augment-progress")
    for _ in range(2):
        jobs.stream_augment(adapters.base_sessions(_events_stream(spark, sf)), out, checkpoint)
    return spark.read.parquet(out).select(
        "sessionID", "urgency_score", F.round("flexibility_index", 9).alias("flexibility_index"),
        F.round("habit_stability", 9).alias("habit_stability"), "grid_impact_proxy")


@B.query("incremental_replies", features.ORACLE["merge_augmented"])
def incremental_replies(spark, sf):
    """Sessions first with a part of the replies, then the other replies, after their timers ran out."""
    sessions = _spread_sessions(table(spark, sf, "events"))
    answers = adapters.retried(adapters.replies(sessions))
    inbox, out, progress = (scratch_path(spark, n) for n in ("replies", "versions", "replies-progress"))
    early = F.pmod(F.xxhash64("sessionID", "attempt"), F.lit(2)) == 0
    for part in (early, ~early):
        answers.filter(part).write.mode("append").parquet(inbox)
        arriving = adapters.base_sessions(_events_stream(spark, sf))
        replies.stream_augment_replies(arriving, jobs.session_stream(spark, inbox, answers.schema), out, progress, patience_ms=1)
    merged = replies.augmented(sessions, spark.read.parquet(out))
    return merged.select("sessionID", "used_rules", "urgency_score", F.round("flexibility_index", 9).alias("flexibility_index"),
                         F.round("habit_stability", 9).alias("habit_stability"), "grid_impact_proxy")


@B.query("stream_score", with_ctes("SELECT count(*) AS n_rows, 0 AS n_different FROM base", BASE))
def stream_score(spark, sf):
    """Rows whose streamed forecast differs from the batch forecast."""
    model = P.fit_forecaster(_table(spark, sf), **QUICK)
    out, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "score-progress")
    cols = ["sessionID", "pred_point", "pred_median", "lower_conformal", "upper_conformal"]
    arriving = _spread_sessions(_events_stream(spark, sf))
    jobs.stream_score(arriving, model, out, checkpoint, lambda df: df.select(*cols))
    batch = model.score(_spread_sessions(table(spark, sf, "events"))).select("sessionID", *[F.col(c).alias(f"b_{c}") for c in cols[1:]])
    joined = batch.join(spark.read.parquet(out), "sessionID", "full")
    same = F.lit(True)
    for c in cols[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(~same).alias("n_different"))
