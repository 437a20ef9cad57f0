"""Energy, interaction and behaviour features, and the bands over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EPSILON = 1e-5
GRID_IMPACT_CODES = {"low": 0, "medium": 1, "high": 2}
RULE_DEFAULTS = {"minutes": 60.0, "kwh": 10.0, "revisions": 0}
MINUTES_PER_DAY = 1440
FLEXIBLE_MINUTES = 300.0
REVISIONS_UNSTABLE = 5.0
HIGH_KWH, MEDIUM_KWH = 30, 10
URGENCY_BANDS = [(75, "very high"), (60, "high"), (45, "medium")]
LOWEST_BAND = "low"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c) -> Column:
    """The value, with NaN as null."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c), c)


def charging_efficiency() -> Column:
    return F.col("kWhDelivered") / F.nullif(F.col("parsed_kWhRequested"), F.lit(0.0))


def requested_gap() -> Column:
    return F.col("parsed_kWhRequested") - F.col("kWhDelivered")


def add_energy(df: DataFrame) -> DataFrame:
    """charging_efficiency, requested_gap, energy_per_minute, request_efficiency."""
    return df.withColumns({
        "charging_efficiency": charging_efficiency(),
        "requested_gap": requested_gap(),
        "energy_per_minute": F.col("parsed_kWhRequested") / (F.col("parsed_minutesAvailable") + F.lit(EPSILON)),
        "request_efficiency": F.col("parsed_milesRequested") / (F.col("parsed_WhPerMile") + F.lit(EPSILON)),
    })


def add_interactions(df: DataFrame) -> DataFrame:
    """Products of behaviour columns; a missing grid impact counts as 1."""
    return df.withColumns({
        "urgency_flex_interaction": F.col("urgency_score") * F.col("flexibility_index"),
        "revision_urgency": (F.col("revisionCount") * F.col("urgency_score")).cast("double"),
        "habit_grid": F.col("habit_stability") * F.coalesce(known("grid_impact_proxy"), F.lit(1.0)),
    })


def ordinal(c, codes: dict[str, int] = GRID_IMPACT_CODES) -> Column:
    """Category text as its code; any other text gives null."""
    c = _col(c)
    out = F.lit(None).cast("int")
    for text, code in codes.items():
        out = F.when(c == text, F.lit(code)).otherwise(out)
    return out


def behavior_rules(minutes="parsed_minutesAvailable", kwh="parsed_kWhRequested",
                   revisions="revisionCount") -> dict[str, Column]:
    """Rule-based behaviour columns; zero, null and NaN inputs take the default."""
    def usable(c, default):
        return F.coalesce(F.nullif(known(c), F.lit(0.0)), F.lit(float(default)))

    mins = usable(minutes, RULE_DEFAULTS["minutes"])
    energy = usable(kwh, RULE_DEFAULTS["kwh"])
    revs = usable(revisions, RULE_DEFAULTS["revisions"]).cast("int")

    def clamp(x: Column, top) -> Column:
        return F.greatest(F.least(x, F.lit(top)), F.lit(type(top)(0)))

    return {
        "urgency_score": clamp((F.lit(100) * (F.lit(1) - mins / F.lit(MINUTES_PER_DAY))).cast("int"), 100),
        "flexibility_index": clamp(mins / F.lit(FLEXIBLE_MINUTES), 1.0),
        "habit_stability": clamp(F.lit(1.0) - revs / F.lit(REVISIONS_UNSTABLE), 1.0),
        "grid_impact_proxy": (
            F.when(energy > HIGH_KWH, "high").when(energy > MEDIUM_KWH, "medium").otherwise("low")
        ),
    }


def urgency_band(c="urgency") -> Column:
    c = _col(c)
    first, *rest = URGENCY_BANDS
    out = F.when(c >= first[0], first[1])
    for floor, name in rest:
        out = out.when(c >= floor, name)
    return out.otherwise(LOWEST_BAND)


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns, each to its own number of digits."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})
