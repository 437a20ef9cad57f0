"""Projection, predicates and nulls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeframe.functions.energy import known
from chargeframe.functions.jsontext import is_blank_json
from chargeframe.functions.timestamps import utc_literal

# Fixed values.
MIN_REMAINING_KWH = 0.5
DEFAULT_MINUTES_LEFT = 300
SERVING_DEFAULTS = {
    "urgency_score": 50.0, "flexibility_index": 1.0, "grid_impact_proxy": 1.0, "habit_stability": 1.0,
}


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with null or NaN in any of the columns."""
    return df.dropna(subset=cols)


def drop_empty_json(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose JSON text is null or stands for "nothing entered"."""
    return df.filter(~is_blank_json(col))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop null, empty and whitespace-only text."""
    return df.filter(F.col(col).rlike(r"\S"))


def blank_report(df: DataFrame, col: str) -> DataFrame:
    """Row counts before and after ``drop_blank``, in one pass."""
    kept = F.count_if(F.col(col).rlike(r"\S"))
    return df.agg(F.count("*").alias("rows_before"), kept.alias("rows_after"),
                  (F.count("*") - kept).alias("rows_removed"))


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null and empty-text counts, one row per column, in one pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts = []
    for name in cols:
        kind, c = kinds[name], F.col(name)
        null = c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()
        empty = F.count_if(c == "") if isinstance(kind, T.StringType) else F.lit(0).cast("long")
        counts.append(F.struct(F.lit(name).alias("column"), F.count_if(null).alias("n_null"),
                               empty.alias("n_empty")))
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def on_day(df: DataFrame, ts: str, day: dt.date | str) -> DataFrame:
    """Rows of one UTC day, as a range that reaches the Parquet scan."""
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    start = dt.datetime.combine(day, dt.time())
    kind = df.schema[ts].dataType
    lo, hi = utc_literal(start, kind), utc_literal(start + dt.timedelta(days=1), kind)
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def active_sessions(df: DataFrame, min_kwh: float = MIN_REMAINING_KWH) -> DataFrame:
    """Sessions that still need energy, with remaining_kWh and minutes_left; NaN counts as missing."""
    return df.withColumns({
        "remaining_kWh": known("parsed_kWhRequested") - F.coalesce(known("kWhDelivered"), F.lit(0.0)),
        "minutes_left": F.coalesce(known("parsed_minutesAvailable"), F.lit(float(DEFAULT_MINUTES_LEFT))),
    }).filter(F.col("remaining_kWh") > min_kwh)


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Constants for null and NaN values and for columns that do not exist."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def filled(name, value):
        if name not in kinds:
            return F.lit(value)
        c = F.col(name)
        if isinstance(kinds[name], (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast("double"))
        return F.coalesce(c, F.lit(value).cast(kinds[name]))

    return df.withColumns({name: filled(name, value) for name, value in defaults.items()})


def prefixed(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in cols})
