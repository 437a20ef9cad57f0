"""Declared schemas; nothing is inferred on read.

Timestamps are ``timestamp_ntz`` holding the UTC wall clock, so results do
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _i, _l, _t = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


#: One revision of what a driver asked for.
USER_INPUT = _struct(
    ("userID", _l), ("milesRequested", _d), ("WhPerMile", _d), ("minutesAvailable", _d),
    ("kWhRequested", _d), ("modifiedAt", _s), ("requestedDeparture", _s),
)

RAW_SESSION = _struct(
    ("_id", _s), ("sessionID", _s), ("stationID", _s), ("userID", _s),
    ("connectionTime", _s), ("disconnectTime", _s), ("doneChargingTime", _s),
    ("kWhDelivered", _d), ("userInputs", T.ArrayType(USER_INPUT)),
)

#: A landed page of the sessions service.
SESSION_PAGE = _struct(
    ("_items", T.ArrayType(RAW_SESSION)),
    ("_links", _struct(("next", _struct(("href", _s))))),
)

#: Cleaned and augmented sessions, the main table.
SESSION = _struct(
    ("sessionID", _s), ("stationID", _s), ("parsed_userID", _l),
    ("connectionTime", _t), ("disconnectTime", _t), ("doneChargingTime", _s), ("day_of_week", _s),
    ("kWhDelivered", _d), ("parsed_kWhRequested", _d), ("parsed_minutesAvailable", _d),
    ("parsed_milesRequested", _d), ("parsed_WhPerMile", _d), ("revisionCount", _i),
    ("urgency_score", _i), ("flexibility_index", _d), ("habit_stability", _d),
    ("grid_impact_proxy", _s),
)

RUN_LOG = _struct(
    ("timestamp", T.TimestampType()), ("experiment", _s), ("n_features", _i),
    ("test_mae", _d), ("test_rmse", _d), ("test_r2", _d),
)

# The feature columns in model order, and their groups.
FEATURES = [
    "parsed_milesRequested", "parsed_WhPerMile", "parsed_minutesAvailable", "parsed_kWhRequested",
    "revisionCount", "hour", "day_of_week_encoded", "is_weekend", "is_peak",
    "urgency_score", "flexibility_index", "habit_stability", "grid_impact_proxy",
    "urgency_flex_interaction", "revision_urgency", "habit_grid", "energy_per_minute",
    "request_efficiency", "duration_hours", "charging_efficiency", "requested_gap",
    "hour_sin", "hour_cos", "station_encoded", "user_encoded",
]
#: Computed from the delivered energy, that is from the target itself.
TARGET_DERIVED = ["charging_efficiency", "requested_gap"]
#: Known only after the car has left.
AFTER_SESSION = ["duration_hours"]
BEHAVIORAL = ["urgency_flex_interaction", "revision_urgency", "habit_grid", "energy_per_minute"]
TARGET = "kWhDelivered"


def feature_set(name: str = "honest") -> list[str]:
    """``leaky``: every feature; ``honest``: only those known beforehand."""
    if name == "leaky":
        return list(FEATURES)
    if name == "honest":
        return [c for c in FEATURES if c not in TARGET_DERIVED + AFTER_SESSION]
    raise ValueError(f"unknown feature set {name!r}")
