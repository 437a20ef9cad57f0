"""Keyed joins for what is otherwise aligned by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.operators.ordering import top_k
from chargeframe.runtime import small_side

# Schedule horizon.
HORIZON_HOURS = 8
STEP_MINUTES = 15
BUSIEST_USERS = 15


def apply_encoding(df: DataFrame, encoding: DataFrame, col: str, default: float, out: str) -> DataFrame:
    """Left join of (``col``, ``encoded``); unseen values take ``default``."""
    side = small_side(encoding.select(F.col(col), F.col("encoded").alias("_enc")))
    return df.join(side, col, "left").withColumn(out, F.coalesce(F.col("_enc"), F.lit(default))).drop("_enc")


def split_of(df: DataFrame, assignment: DataFrame, key: str, name: str = "split") -> DataFrame:
    """Label rows from a table of test and validation keys; the rest is train.

    One join instead of a semi join per part and an anti join.
    """
    return df.join(assignment.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit("train")))


def exclude_keys(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the taken ones."""
    return df.join(taken.select(key), key, "left_anti")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in the output of an earlier run."""
    return exclude_keys(df, done, key)


def attach(df: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    """Bring parsed columns back to their base rows by key."""
    return df.join(cols, key, "inner")


def align_predictions(pred: DataFrame, sessions: DataFrame, key: str = "sessionID",
                      ts: str = "connectionTime") -> DataFrame:
    """Predictions with the time of their session, in time order."""
    return pred.join(sessions.select(key, F.col(ts).alias("timestamp")), key, "inner").orderBy("timestamp", key)


def unmatched_count(pred: DataFrame, sessions: DataFrame, key: str = "sessionID") -> DataFrame:
    """Number of predictions without a session."""
    return exclude_keys(pred, sessions, key).agg(F.count("*").alias("n_unmatched"))


def session_slots(df: DataFrame, hours: int = HORIZON_HOURS, step_min: int = STEP_MINUTES,
                  slot: str = "time_slot") -> DataFrame:
    """Every session with every slot of the horizon, without a shuffle."""
    last = hours * 60 // step_min - 1
    return df.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(last))))


def for_top_users(schedule: DataFrame, sessions: DataFrame, n: int = BUSIEST_USERS,
                  user: str = "user_id", session_user: str = "parsed_userID") -> DataFrame:
    """Schedule rows of the users with most sessions; at most ``n`` keys are broadcast."""
    busiest = top_k(sessions, session_user, n).select(F.col(session_user).alias(user))
    return schedule.join(F.broadcast(busiest), user, "left_semi")
