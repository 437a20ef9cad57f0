"""Timestamps and calendar features."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Evening peak hours (inclusive) and the default weekday.
PEAK_HOURS = (17, 21)
DEFAULT_WEEKDAY = "Monday"

_HAS_ZONE = r"\d{1,2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?|[A-Z]{3,4})$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_wall_clock(ts: Column) -> Column:
    """An instant as ``timestamp_ntz`` in UTC, for any session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def utc_literal(value: dt.datetime, kind: T.DataType) -> Column:
    """A UTC time as a literal of a timestamp type, for any session time zone."""
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    text = value.isoformat(sep=" ")
    return F.lit(text).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(text + "+00:00").cast(kind)


def parse_utc(c) -> Column:
    """ISO or RFC 1123 text as a UTC ``timestamp_ntz``; bad text gives null.

    Text without a zone is taken as UTC.
    """
    text = F.trim(_col(c))
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3},\s+", "")
    instant = F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(no_weekday, F.lit("d MMM yyyy HH:mm:ss z")),
    )
    return F.when(text.rlike(_HAS_ZONE), utc_wall_clock(instant)).otherwise(text.try_cast("timestamp_ntz"))


def local_time(ts, tz: str | None) -> Column:
    """Shift a UTC wall clock to ``tz``; ``None`` leaves it in UTC."""
    ts = _col(ts)
    return ts if tz in (None, "UTC") else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def weekday_code(ts) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(_col(ts))


def duration_hours(start="connectionTime", end="disconnectTime") -> Column:
    """Hours between two timestamps, with fractions."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(3.6e9)


def is_peak(hour: Column) -> Column:
    return hour.between(*PEAK_HOURS).cast("int")


def cyclic_hour(hour="hour") -> list[Column]:
    """Sine and cosine of the hour on a 24-hour circle."""
    angle = F.lit(2 * math.pi) * _col(hour) / F.lit(24)
    return [F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos")]


def add_calendar(df: DataFrame, ts: str = "connectionTime", tz: str | None = None) -> DataFrame:
    """hour, month, date, day_of_week_encoded, is_weekend and is_peak."""
    local = local_time(ts, tz)
    code = weekday_code(local)
    return df.withColumns({
        "hour": F.hour(local),
        "month": F.month(local),
        "date": F.to_date(local),
        "day_of_week_encoded": code,
        "is_weekend": (code >= 5).cast("int"),
        "is_peak": is_peak(F.hour(local)),
    })
