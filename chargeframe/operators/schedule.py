"""Charging schedules for any number of (site, date) groups at once.

The model chooses kW per session and slot. It minimises the peak plus 0.01
per kW plus 0.06 · weight · slot weight per kW, so that every session gets its
target energy within charger, late-slot and grid limits. Pricing the peak and
the grid limit per slot (their Lagrange multipliers) separates the sessions:
each then fills its cheapest slots, which is a running sum over 32 slots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chargeframe.functions.energy import known, urgency_band
from chargeframe.operators.cleaning import active_sessions
from chargeframe.operators.joins import HORIZON_HOURS, STEP_MINUTES, for_top_users, session_slots
from chargeframe.runtime import BROADCAST_BYTES, durable, small_side

GROUP = ["site", "date"]


@dataclass(frozen=True)
class ScheduleParams:
    """Limits and weights; the defaults are fixed values."""

    horizon_hours: int = HORIZON_HOURS
    step_minutes: int = STEP_MINUTES
    charger_kw: float = 11.0
    grid_kw: float = 400.0
    target_share: float = 0.93
    usage_cost: float = 0.01
    delay_cost: float = 0.06
    urgent_above: float = 80.0
    inflexible_below: float = 0.3
    urgent_share: float = 0.9
    urgent_kw: float = 2.0
    trickle_kw: float = 0.5
    direction: str = "late"  # "late" prices early slots most, "early" late ones
    min_kw: float = 0.1
    naive_extra_slots: int = 2
    chart_slots: int = 40

    @property
    def slots(self) -> int:
        return self.horizon_hours * 60 // self.step_minutes

    @property
    def hours(self) -> float:
        return self.step_minutes / 60.0


DEFAULT = ScheduleParams()


def schedule_input(sessions: DataFrame, lower: Column | None = None) -> DataFrame:
    """Active sessions in the columns the schedule operators read."""
    active = active_sessions(sessions)
    lower = F.lit(0.0) if lower is None else lower
    return active.select(
        *GROUP, F.col("sessionID").alias("session_id"), "parsed_userID", "remaining_kWh",
        lower.alias("lower_kWh"), "minutes_left", "urgency_score", "flexibility_index",
        (F.col("urgency_score") * F.col("flexibility_index")).alias("urgency_flex_interaction"))


def energy_targets(df: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """required_kWh, max_slots and target_kWh of each session."""
    required = F.greatest("remaining_kWh", "lower_kWh")
    slots = (F.col("minutes_left") / F.lit(params.step_minutes)).cast("int")
    reachable = slots * F.lit(params.charger_kw * params.hours)
    return df.withColumns({
        "required_kWh": required, "max_slots": slots,
        "target_kWh": F.least(required * F.lit(params.target_share), reachable),
    })


def _cap_break(params: ScheduleParams) -> tuple[Column, Column]:
    """The slot from which on a lower limit holds, and that limit."""
    urgent = F.coalesce(
        (F.col("urgency_score") > params.urgent_above) & (F.col("flexibility_index") < params.inflexible_below),
        F.lit(False))
    soft = (F.col("max_slots") * F.lit(params.urgent_share)).cast("int")
    return (F.when(urgent, soft).otherwise(F.col("max_slots")),
            F.when(urgent, F.lit(params.urgent_kw)).otherwise(F.lit(params.trickle_kw)))


def _cap(slot: Column, params: ScheduleParams) -> Column:
    start, low = _cap_break(params)
    return F.when(slot >= start, low).otherwise(F.lit(params.charger_kw))


def _capacity(params: ScheduleParams) -> Column:
    """kWh that all slots of a session can give together."""
    start, low = _cap_break(params)
    full = F.greatest(F.lit(0), F.least(start, F.lit(params.slots)))
    return (full * F.lit(params.charger_kw) + (F.lit(params.slots) - full) * low) * F.lit(params.hours)


def _cap_sum(params: ScheduleParams) -> Column:
    """``_capacity`` of rows that carry start_slot and low_kw."""
    full = F.greatest(F.lit(0), F.least("start_slot", F.lit(params.slots)))
    return (full * F.lit(params.charger_kw) + (F.lit(params.slots) - full) * F.col("low_kw")) * F.lit(params.hours)


def _delay_price(slot: Column, params: ScheduleParams) -> Column:
    weight = F.coalesce(known("urgency_flex_interaction"), F.lit(1.0))
    steps = F.lit(params.slots) - slot if params.direction == "late" else slot + F.lit(1)
    return F.lit(params.usage_cost) + F.lit(params.delay_cost) * weight * steps


def slot_caps(df: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """cap_kw of (session, slot) rows that carry the columns of ``energy_targets``."""
    return df.withColumn("cap_kw", _cap(F.col("time_slot"), params))


def slot_prices(df: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """Cost per kW of each (session, slot) row."""
    return df.withColumn("price", _delay_price(F.col("time_slot"), params))


def priced_slots(sessions: DataFrame, params: ScheduleParams = DEFAULT, cluster: bool = True) -> DataFrame:
    """Targets, slots, caps and prices of each session.

    ``cluster`` brings the sessions to their partition before they are
    expanded: filling and auditing by session then need no shuffle of the
    slots, which are 32 times as many.
    """
    targets = energy_targets(sessions, params)
    targets = targets.repartition("session_id") if cluster else targets
    slots = session_slots(targets, params.horizon_hours, params.step_minutes)
    return slot_prices(slot_caps(slots, params), params)


def infeasible(sessions: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """Sessions whose target exceeds what their slots can give; no slot is expanded."""
    targets = energy_targets(sessions, params).withColumn("capacity_kWh", _capacity(params))
    return targets.filter(F.col("target_kWh") > F.col("capacity_kWh"))


def fill_slots(slots: DataFrame, params: ScheduleParams = DEFAULT, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Fill the slots of a session from the cheapest on until its target is met."""
    room = F.col("cap_kw") * F.lit(params.hours)
    w = W.partitionBy(*keys).orderBy("price", "time_slot").rowsBetween(W.unboundedPreceding, -1)
    prior = F.coalesce(F.sum(room).over(w), F.lit(0.0))
    energy = F.least(F.greatest(F.col("target_kWh") - prior, F.lit(0.0)), room)
    return slots.withColumn("kwh", energy).withColumn("kw", F.col("kwh") / F.lit(params.hours))


def _room_between(first: Column, end: Column, params: ScheduleParams) -> Column:
    """kWh that the slots from ``first`` up to before ``end`` can give."""
    start, low = _cap_break(params)
    count = F.greatest(F.lit(0), end - first)
    full = F.greatest(F.lit(0), F.least(start, end) - first)
    return (full * F.lit(params.charger_kw) + (count - full) * low) * F.lit(params.hours)


def _cheapest_kwh(slot: Column, params: ScheduleParams) -> Column:
    """What ``fill_slots`` gives a slot at the plain prices, from columns of ``energy_targets`` alone.

    The price of a slot rises or falls with its number by the sign of the weight, so the slots that
    come before it are those on one side; equal prices go by number.
    """
    weight = F.coalesce(known("urgency_flex_interaction"), F.lit(1.0))
    falling = weight > 0 if params.direction == "late" else weight < 0
    prior = F.when(falling, _room_between(slot + 1, F.lit(params.slots), params)).otherwise(_room_between(F.lit(0), slot, params))
    room = _cap(slot, params) * F.lit(params.hours)
    return F.least(F.greatest(F.col("target_kWh") - prior, F.lit(0.0)), room)


def filled_slots(sessions: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """``fill_slots`` of ``priced_slots`` in one narrow pass: nothing is shuffled or sorted."""
    slots = session_slots(energy_targets(sessions, params), params.horizon_hours, params.step_minutes)
    priced = slot_prices(slot_caps(slots, params), params)
    return priced.withColumn("kwh", _cheapest_kwh(F.col("time_slot"), params)).withColumn("kw", F.col("kwh") / F.lit(params.hours))


def load_profiles(sessions: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """``before_after`` of the naive and the cheapest-slot load, from one scan and one aggregate per group."""
    per_slot = params.charger_kw * params.hours
    need = F.least(F.ceil(F.col("remaining_kWh") / F.lit(per_slot)) + F.lit(params.naive_extra_slots),
                   F.lit(params.chart_slots)).cast("int")
    kw = F.transform(F.sequence(F.lit(0), F.lit(params.slots - 1)), lambda t: _cheapest_kwh(t, params) / F.lit(params.hours))
    rows = energy_targets(sessions, params).select(*GROUP, need.alias("need"), kw.alias("kw"))

    def total(t: int) -> Column:
        shown = F.when(F.get("kw", F.lit(t)) > params.min_kw, F.round(F.get("kw", F.lit(t)), 2)).otherwise(0.0)
        return F.sum(shown) if t < params.slots else F.lit(0.0)

    n = range(params.chart_slots)
    naive = F.array(*(F.count_if(F.col("need") > t) * F.lit(params.charger_kw) for t in n))
    groups = rows.groupBy(*GROUP).agg(naive.alias("naive"), F.array(*(total(t) for t in n)).alias("optimized"))
    peaks = groups.withColumns({"naive_peak": F.array_max("naive"), "optimized_peak": F.array_max("optimized")})
    ratio = F.lit(1.0) - F.col("optimized_peak") / F.nullif(F.col("naive_peak"), F.lit(0.0))
    return peaks.select(*GROUP, F.posexplode(F.arrays_zip("naive", "optimized")).alias("time_slot", "kw"), "naive_peak", "optimized_peak",
                        F.coalesce(F.lit(100.0) * ratio, F.lit(0.0)).alias("reduction_pct")).select(
        *GROUP, "time_slot", F.col("kw.naive").alias("naive_kw"), F.col("kw.optimized").alias("optimized_kw"),
        "naive_peak", "optimized_peak", "reduction_pct")


def schedule_rows(filled: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """Slots with noticeable power, rounded for output."""
    return filled.filter(F.col("kw") > params.min_kw).select(
        *GROUP, "session_id", F.col("parsed_userID").alias("user_id"), "time_slot",
        F.round("kw", 2).alias("power_kw"), F.round("kwh", 3).alias("energy_kwh"),
        F.round(F.coalesce(F.col("urgency_score").cast("double"), F.lit(0.0)), 1).alias("urgency"))


def _per_slot(n_slots: int, value: str, condition: str = "time_slot = {t}") -> str:
    """An array with one conditional sum per slot; empty slots are zero without a join."""
    sums = (f"coalesce(sum(CASE WHEN {condition.format(t=t)} THEN {value} END), 0D)" for t in range(n_slots))
    return f"array({', '.join(sums)})"


def _by_slot(df: DataFrame, loads: str, name: str) -> DataFrame:
    return df.groupBy(*GROUP).agg(F.expr(loads).alias("_load")).select(
        *GROUP, F.posexplode("_load").alias("time_slot", name))


def slot_load(schedule: DataFrame, n_slots: int = DEFAULT.chart_slots, power: str = "power_kw",
              name: str = "load_kw") -> DataFrame:
    """Total kW per group and slot, zero-filled over ``n_slots``."""
    loads = schedule.groupBy(*GROUP, "time_slot").agg(F.sum(power).alias("_kw"))
    return _by_slot(loads, _per_slot(n_slots, "_kw"), name)


def naive_profile(sessions: DataFrame, params: ScheduleParams = DEFAULT) -> DataFrame:
    """Load when every session charges at full power from slot 0 on.

    Sessions are counted, not expanded: a slot's load is the number of
    sessions that need more slots than come before it, times the power.
    """
    per_slot = params.charger_kw * params.hours
    need = F.least(F.ceil(F.col("remaining_kWh") / F.lit(per_slot)) + F.lit(params.naive_extra_slots),
                   F.lit(params.chart_slots)).cast("int")
    counts = sessions.groupBy(*GROUP, need.alias("_need")).agg(F.count("*").alias("_n"))
    return _by_slot(counts, _per_slot(params.chart_slots, f"_n * {params.charger_kw}D", "_need > {t}"), "naive_kw")


def peak_reduction(loads: DataFrame, naive: str = "naive_kw", opt: str = "optimized_kw") -> DataFrame:
    """Both peaks per group and the reduction in percent, 0 without a naive peak."""
    a, b = F.max(naive), F.max(opt)
    return loads.groupBy(*GROUP).agg(
        a.alias("naive_peak"), b.alias("optimized_peak"),
        F.coalesce(F.lit(100.0) * (F.lit(1.0) - b / F.nullif(a, F.lit(0.0))), F.lit(0.0)).alias("reduction_pct"))


def before_after(naive: DataFrame, optimized: DataFrame) -> DataFrame:
    """Naive and optimized load per slot, with the peaks of the group.

    A group has at most ``chart_slots`` rows, so its peaks are a window.
    """
    loads = naive.join(optimized, [*GROUP, "time_slot"], "full").select(
        *GROUP, "time_slot", F.coalesce("naive_kw", F.lit(0.0)).alias("naive_kw"),
        F.coalesce("optimized_kw", F.lit(0.0)).alias("optimized_kw"))
    w = W.partitionBy(*GROUP)
    peaks = loads.withColumns({"naive_peak": F.max("naive_kw").over(w), "optimized_peak": F.max("optimized_kw").over(w)})
    ratio = F.lit(1.0) - F.col("optimized_peak") / F.nullif(F.col("naive_peak"), F.lit(0.0))
    return peaks.withColumn("reduction_pct", F.coalesce(F.lit(100.0) * ratio, F.lit(0.0)))


def gantt_rows(schedule: DataFrame, sessions: DataFrame) -> DataFrame:
    """Charging slots of the busiest users with their urgency band."""
    return for_top_users(schedule, sessions).select(*GROUP, "user_id", "time_slot", urgency_band("urgency").alias("band"))


def audit(filled: DataFrame, params: ScheduleParams = DEFAULT, tolerance: float = 1e-6) -> DataFrame:
    """Violations per group, and the energy placed after departure.

    One pass: slots are first combined per session, which keeps the session's
    power per slot, and sessions then per group.
    """
    n = range(params.slots)
    per_session = filled.groupBy(*GROUP, "session_id").agg(
        F.sum("kwh").alias("kwh"), F.max("target_kWh").alias("target"),
        F.sum(F.col("cap_kw") * F.lit(params.hours)).alias("capacity"),
        F.count_if(F.col("kw") > params.charger_kw + tolerance).alias("charger"),
        F.count_if(F.col("kw") > F.col("cap_kw") + tolerance).alias("late"),
        F.sum(F.when(F.col("time_slot") >= F.col("max_slots"), F.col("kwh")).otherwise(0.0)).alias("after"),
        F.expr(_per_slot(params.slots, "kw")).alias("power"))
    short = F.col("kwh") < F.col("target") - tolerance
    groups = per_session.groupBy(*GROUP).agg(
        F.count_if(short & (F.col("target") <= F.col("capacity"))).alias("target_violations"),
        F.count_if(F.col("target") > F.col("capacity")).alias("infeasible_sessions"),
        F.sum("charger").alias("charger_violations"), F.sum("late").alias("late_violations"),
        F.sum("after").alias("kwh_after_departure"),
        F.expr(f"array({', '.join(f'sum(power[{t}])' for t in n)})").alias("load"))
    over = F.size(F.filter("load", lambda kw: kw > params.grid_kw + tolerance)).cast("long")
    return groups.withColumn("grid_violations", over).drop("load")


# --- price loop ---------------------------------------------------------------

def _fill_arrays(params: ScheduleParams):
    """Column function: kW per slot of a session, averaged over price vectors.

    The rule of ``fill_slots`` for a batch of rows at once: ``prices`` holds
    one or more vectors of extra slot prices, one after the other.
    """
    n, charger, hours = params.slots, params.charger_kw, params.hours
    steps = np.arange(n, 0, -1) if params.direction == "late" else np.arange(1, n + 1)
    usage, delay = params.usage_cost, params.delay_cost

    @F.pandas_udf("array<double>")
    def fill(prices: pd.Series, target: pd.Series, weight: pd.Series, start: pd.Series, low: pd.Series) -> pd.Series:
        if not len(prices):
            return pd.Series([], dtype=object)
        extra = np.stack(prices.to_numpy()).reshape(len(prices), -1, n)
        slot = np.arange(n)
        room = np.where(slot >= start.to_numpy()[:, None], low.to_numpy()[:, None], charger) * hours
        own = usage + delay * weight.to_numpy()[:, None] * steps
        total = np.zeros_like(room)
        for r in range(extra.shape[1]):
            order = np.argsort(own + extra[:, r], axis=1, kind="stable")
            ranked = np.take_along_axis(room, order, axis=1)
            prior = np.cumsum(ranked, axis=1) - ranked
            kwh = np.clip(target.to_numpy()[:, None] - prior, 0.0, ranked)
            filled = np.empty_like(kwh)
            np.put_along_axis(filled, order, kwh, axis=1)
            total += filled
        return pd.Series(list(total / (extra.shape[1] * hours)))

    return lambda prices: fill(prices, "served_kWh", "weight", "start_slot", "low_kw")


def _group_loads(powers: DataFrame, params: ScheduleParams, kw: str = "power") -> DataFrame:
    """Load per slot as an array, and the usage and delay cost, per group.

    One sum per slot, so sessions are combined before the shuffle and never
    expanded into slots.
    """
    n = range(params.slots)
    steps = [params.slots - t if params.direction == "late" else t + 1 for t in n]
    plain = " + ".join(f"{kw}[{t}]" for t in n)
    weighted = " + ".join(f"{kw}[{t}] * {steps[t]}D" for t in n)
    cost = f"{params.usage_cost}D * ({plain}) + {params.delay_cost}D * weight * ({weighted}) AS _cost"
    loads = "array(" + ", ".join(f"sum({kw}[{t}])" for t in n) + ") AS load"
    return powers.selectExpr(*GROUP, kw, cost).groupBy(*GROUP).agg(F.expr(loads), F.sum("_cost").alias("cost"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _dot(a: str, b: str) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


@dataclass
class Schedule:
    """``rows``: one per session and slot. ``report``: one per group."""

    rows: DataFrame
    report: DataFrame


#: Width in kWh of the classes that the fill within the grid limit works on.
NEED_STEP = 0.05


def _laxity_fill(classes: pd.DataFrame, params: ScheduleParams) -> tuple[np.ndarray, str]:
    """kWh per slot for one session of each class, within the grid limit, and the group's state.

    Slot by slot, cheap slots first, what no later turn can give is given; the rest of the limit goes
    to the classes with the least slack first. ``classes`` has n, need, start_slot, low_kw, and asked, the
    mean of the true needs, which are at most ``need``. Where no plan meets the needs the limit holds all
    the same, and energy is left over.
    """
    T, budget = params.slots, params.grid_kw * params.hours
    n, need = classes["n"].to_numpy(float), classes["need"].to_numpy(float)
    room = np.where(np.arange(T) >= classes["start_slot"].to_numpy()[:, None], classes["low_kw"].to_numpy()[:, None],
                    params.charger_kw) * params.hours
    # energy that the first or the last slots must give, against all that the limit allows in them
    impossible = False
    for side in (room, room[:, ::-1]):
        rest = side.sum(axis=1, keepdims=True) - np.cumsum(side, axis=1)
        due = (n[:, None] * np.maximum(0.0, classes["asked"].to_numpy(float)[:, None] - rest)).sum(axis=0)
        impossible |= bool((due > budget * np.arange(1, T + 1) + 1e-6).any())
    turns = np.arange(T)[::-1] if params.direction == "late" else np.arange(T)
    room = room[:, turns]
    later = room.sum(axis=1, keepdims=True) - np.cumsum(room, axis=1)
    given, left, met = np.zeros_like(room), need.copy(), True
    for t in range(T):
        must = np.clip(left - later[:, t], 0.0, room[:, t])
        due = (n * must).sum()
        free = budget - due
        met &= free >= -1e-9
        # what exceeds the limit is dealt in proportion and stays unserved
        must *= min(1.0, budget / due) if due > 0 else 1.0
        more = np.minimum(room[:, t], left) - must
        order = np.argsort(later[:, t] + room[:, t] - left, kind="stable")
        wanted = (n * more)[order]
        before = np.cumsum(wanted) - wanted
        share = np.zeros(len(n))
        share[order] = np.clip((max(free, 0.0) - before) / np.where(wanted > 0, wanted, 1.0), 0.0, 1.0)
        given[:, t] = must + share * more
        left -= given[:, t]
    given = given[:, np.argsort(turns)]
    return given, "infeasible" if impossible else "feasible" if met and (left < 1e-9).all() else "not converged"


def within_grid(base: DataFrame, params: ScheduleParams) -> DataFrame:
    """A plan within the grid limit: base with ``plan`` (kW per slot) and ``status`` of its group.

    Sessions with the same limits and the same need, rounded up to NEED_STEP, are one class. A group
    has a bounded number of classes, however many sessions it has, so it is filled in one task.
    """
    capacity = _cap_sum(params)
    classed = base.withColumn("need", F.least(F.ceil(F.col("served_kWh") / NEED_STEP) * NEED_STEP, capacity))
    keys = [*GROUP, "start_slot", "low_kw", "need"]
    counts = classed.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("served_kWh").alias("asked"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        given, status = _laxity_fill(rows, params)
        return rows[keys].assign(class_plan=list(given / params.hours), status=status)

    kinds = dict(base.select(*GROUP).dtypes)
    ddl = ", ".join([*(f"{g} {kinds[g]}" for g in GROUP), "start_slot int, low_kw double, need double, class_plan array<double>, status string"])
    plans = durable(counts.groupBy(*GROUP).applyInPandas(fill, ddl))
    scale = F.when(F.col("need") > 0, F.col("served_kWh") / F.col("need")).otherwise(0.0)
    return classed.join(small_side(plans), keys).withColumn(
        "plan", F.transform("class_plan", lambda kw: kw * scale)).drop("class_plan", "need")


def schedule(sessions: DataFrame, params: ScheduleParams = DEFAULT, rounds: int = 12,
             peak_step: float | None = None, grid_step: float = 0.15) -> Schedule:
    """Peak-aware schedule by price updates, kept within the grid limit.

    Every round prices the slots, lets each session fill its cheapest ones and
    raises the price of loaded slots: the peak prices by multiplicative
    weights, which keeps their sum at 1, and the grid prices by a projected
    subgradient step of the size of the delay costs. The loop keeps only the prices,
    2 × 32 numbers per group and round; the powers, averaged over the later half of the rounds, are
    computed from them at the end, in one pass. Where the average still exceeds the grid limit it is
    mixed with a plan that keeps it, as much as it takes: limits per session and targets
    are convex, so the mixture keeps them too.

    ``status`` of a group: ``feasible`` (targets and limits hold; ``gap`` to the best dual bound
    is given), ``infeasible`` (no plan can meet the targets within the grid limit) or ``not
    converged`` (none was found). Groups that are not feasible keep the limit too, by the plan within
    it alone; ``unserved_kWh`` of a row and of the report is the energy that a session and a group lack. Targets beyond what the slots of a session can give are
    served up to that; the rows keep the target itself, so that an audit sees it.
    """
    T = params.slots
    step = peak_step if peak_step is not None else math.sqrt(2 * math.log(T) / rounds)
    fill = _fill_arrays(params)
    start, low = _cap_break(params)
    base = durable(energy_targets(sessions, params).withColumns({
        "served_kWh": F.greatest(F.least(F.col("target_kWh"), _capacity(params)), F.lit(0.0)),
        "weight": F.coalesce(known("urgency_flex_interaction"), F.lit(1.0)),
        "start_slot": start.cast("int"), "low_kw": low.cast("double"),
    }).select(*GROUP, "session_id", "parsed_userID", "urgency_score", "flexibility_index", "max_slots",
              "target_kWh", "served_kWh", "weight", "start_slot", "low_kw"))
    state = durable(base.groupBy(*GROUP).agg(
        (F.lit(params.delay_cost * T) * F.avg(F.abs("weight")) + F.lit(params.usage_cost)).alias("scale")).withColumns({
            "lam": F.array_repeat(F.lit(1.0 / T), T), "mu": F.array_repeat(F.lit(0.0), T),
            "history": F.array().cast("array<double>"), "bound": F.lit(float("-inf"))}))
    # the table of prices has as many rows in every round: one check of its size will do
    side = F.broadcast if state.count() * (T + 8) * 8 <= BROADCAST_BYTES else (lambda df: df)

    for r in range(rounds):
        prices = state.select(*GROUP, F.zip_with("lam", "mu", lambda x, y: x + y).alias("price"))
        powers = base.join(side(prices), GROUP).withColumn("power", fill("price"))
        joined = state.join(_group_loads(powers, params), GROUP)
        dual = F.col("cost") + _dot("lam", "load") + _dot("mu", "load") - F.lit(params.grid_kw) * _total(F.col("mu"))
        top = F.greatest(F.array_max("load"), F.lit(1e-9))
        rate = F.lit(grid_step / math.sqrt(r + 1.0)) * F.col("scale")
        kept = F.concat("history", F.zip_with("lam", "mu", lambda x, y: x + y)) if r >= rounds // 2 else F.col("history")
        updated = joined.select(
            *GROUP, "scale", kept.alias("history"), F.greatest("bound", dual).alias("bound"),
            F.zip_with("lam", "load", lambda x, y: x * F.exp(F.lit(step) * y / top)).alias("grown"),
            F.zip_with("mu", "load", lambda x, y: F.greatest(
                F.lit(0.0), x + rate * (y / F.lit(params.grid_kw) - F.lit(1.0)))).alias("mu"),
        ).withColumn("sum", _total(F.col("grown")))
        state = durable(updated.select(
            *GROUP, "scale", "history", "bound", "mu", F.transform("grown", lambda x: x / F.col("sum")).alias("lam")))

    used = within_grid(base, params).join(small_side(state.select(*GROUP, "history")), GROUP)
    both = durable(used.withColumn("power", fill("history")).drop("history"))
    loads = _group_loads(both, params).join(_group_loads(both, params, "plan").select(*GROUP, F.col("load").alias("safe")), GROUP)
    # the largest share of the averaged powers that keeps every slot within the limit
    limits = F.zip_with("load", "safe", lambda x, y: F.when(x > params.grid_kw, F.greatest(
        F.lit(0.0), F.try_divide(F.lit(params.grid_kw) - y, x - y))).otherwise(1.0))
    mix = loads.select(*GROUP, F.array_min(limits).alias("mix"))
    share = F.when(F.col("status") == "feasible", F.col("mix")).otherwise(0.0)
    powers = durable(both.join(small_side(mix), GROUP).withColumn(
        "power", F.zip_with("power", "plan", lambda x, y: share * x + (F.lit(1.0) - share) * y)).drop("plan", "mix").withColumn("unserved_kWh", F.when(
            F.col("status") == "feasible", 0.0).otherwise(F.greatest(
                F.col("served_kWh") - _total(F.col("power")) * F.lit(params.hours), F.lit(0.0)))))
    rows = powers.select("*", F.posexplode("power").alias("time_slot", "kw")).drop("power", "weight")
    rows = rows.withColumns({"kwh": F.col("kw") * F.lit(params.hours), "cap_kw": F.when(
        F.col("time_slot") >= F.col("start_slot"), F.col("low_kw")).otherwise(F.lit(params.charger_kw))})
    objective = F.col("cost") + F.array_max("load")
    status = powers.groupBy(*GROUP).agg(F.first("status").alias("status"), F.sum("unserved_kWh").alias("unserved_kWh"))
    report = _group_loads(powers, params).join(state.select(*GROUP, "bound"), GROUP).join(status, GROUP).select(
        *GROUP, "status", F.array_max("load").alias("peak_kw"), objective.alias("objective"),
        F.col("bound").alias("dual_bound"), F.when(F.col("status") == "feasible", objective - F.col("bound")).alias("gap"),
        F.greatest(F.array_max("load") - F.lit(params.grid_kw), F.lit(0.0)).alias("grid_violation_kw"), "unserved_kWh")
    return Schedule(rows, report)
