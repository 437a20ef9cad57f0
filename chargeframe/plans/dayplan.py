"""Forecasts to charging schedules, for one day or for all of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.operators import schedule as S
from chargeframe.operators.cleaning import on_day
from chargeframe.plans.forecast import Forecaster


def plan_input(sessions: DataFrame, model: Forecaster | None = None, day: dt.date | str | None = None) -> DataFrame:
    """Schedule input of one day or all days; the lower bound comes from the model."""
    if day is not None:
        sessions = on_day(sessions, "connectionTime", day)
    if model is None:
        return S.schedule_input(sessions)
    return S.schedule_input(model.score(sessions), F.col("lower_conformal"))


def quick_plan(rows: DataFrame, params: S.ScheduleParams = S.DEFAULT) -> dict[str, DataFrame]:
    """Cheapest slots per session, which is optimal while the grid limit is slack and weights are high."""
    filled = S.filled_slots(rows, params)
    return _tables(rows, filled, params)


def peak_aware_plan(rows: DataFrame, params: S.ScheduleParams = S.DEFAULT, rounds: int = 12) -> dict[str, DataFrame]:
    """The price loop, with its report."""
    result = S.schedule(rows, params, rounds)
    return {**_tables(rows, result.rows, params), "report": result.report}


def _tables(rows: DataFrame, filled: DataFrame, params: S.ScheduleParams) -> dict[str, DataFrame]:
    schedule = S.schedule_rows(filled, params)
    load = S.slot_load(schedule, params.chart_slots, name="optimized_kw")
    return {
        "schedule": schedule,
        "before_after": S.before_after(S.naive_profile(rows, params), load),
        "gantt": S.gantt_rows(schedule, rows),
        "audit": S.audit(filled, params),
    }
