"""Raw sessions to the training table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.functions.energy import add_energy, add_interactions, behavior_rules, ordinal
from chargeframe.functions.jsontext import extract_json_reply, merge_augmented, parse_user_inputs
from chargeframe.functions.timestamps import add_calendar, cyclic_hour, duration_hours, parse_utc
from chargeframe.operators.cleaning import drop_blank, drop_empty_json, drop_missing
from chargeframe.operators.encoding import target_encode
from chargeframe.operators.ordering import stratified_split
from chargeframe.runtime import materialize
from chargeframe.schemas import FEATURES, TARGET

ENCODED = {"station_encoded": "stationID", "user_encoded": "parsed_userID"}


def normalize_user_inputs(df: DataFrame, inputs: str = "userInputs") -> DataFrame:
    """Latest revision as ``parsed_*`` columns, revision count and weekday name."""
    parsed = parse_user_inputs(df, inputs, "_latest")
    latest = "_latest."
    return parsed.withColumns({
        "parsed_userID": F.col(latest + "userID"),
        "parsed_milesRequested": F.col(latest + "milesRequested"),
        "parsed_WhPerMile": F.col(latest + "WhPerMile"),
        "parsed_minutesAvailable": F.col(latest + "minutesAvailable"),
        "parsed_kWhRequested": F.coalesce(
            F.col(latest + "kWhRequested"),
            F.col(latest + "milesRequested") * F.col(latest + "WhPerMile") / F.lit(1000.0)),
        "modifiedAt": parse_utc(latest + "modifiedAt"),
        "requestedDeparture": parse_utc(latest + "requestedDeparture"),
        "day_of_week": F.date_format("connectionTime", "EEEE"),
    }).drop("_latest", inputs)


def clean(raw: DataFrame) -> DataFrame:
    """Session items with ``userInputs`` as JSON text to cleaned sessions."""
    kept = drop_empty_json(raw, "userInputs").withColumns({
        "connectionTime": parse_utc("connectionTime"), "disconnectTime": parse_utc("disconnectTime")})
    return normalize_user_inputs(kept)


def augment(cleaned: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Behaviour columns from reply texts where usable, else from the rules."""
    if replies is None:
        return cleaned.withColumns(behavior_rules())
    return merge_augmented(cleaned, extract_json_reply(replies)).drop("used_rules")


def session_table(raw: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """The whole preparation; a shuffle only for the keyed join of replies."""
    return drop_blank(augment(clean(raw), replies), "doneChargingTime")


def add_features(sessions: DataFrame, tz: str | None = None) -> DataFrame:
    """All features that need no other row."""
    df = sessions.withColumn("grid_impact_proxy", ordinal("grid_impact_proxy")) if dict(
        sessions.dtypes)["grid_impact_proxy"] == "string" else sessions
    df = add_interactions(add_energy(add_calendar(df, tz=tz)))
    return df.withColumn("duration_hours", duration_hours()).select("*", *cyclic_hour("hour"))


def row_features() -> list[str]:
    return [c for c in FEATURES if c not in ENCODED]


def training_table(sessions: DataFrame, key: str = "sessionID", strata: str = "month", folds: int = 5,
                   seed=42, exact: bool = True) -> DataFrame:
    """Features, split labels and target encodings; rows with gaps are dropped.

    The feature rows are written once: the split and each encoding read two to
    four of their columns.
    """
    rows = materialize(drop_missing(add_features(sessions), [TARGET, *row_features()]), "features")
    df = stratified_split(rows, strata, key, seed=seed, exact=exact)
    train: Column = F.col("split") == "train"
    return target_encode(df, ENCODED, TARGET, [key], train, folds, seed)
