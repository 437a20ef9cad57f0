"""Charging schedules over all sites and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.operators import schedule as S
from chargeframe.operators.joins import for_top_users
from chargeframe.registry.book import Book
from chargeframe.registry.sql import ACTIVE, FILLED, LOADS, SLOTS, TARGETS, with_ctes

B = Book()
QUERIES, ORACLE = B.queries, B.oracle


def _input(spark, sf):
    expected = F.least(F.col("parsed_kWhRequested"),
                       F.lit(adapters.MEAN_KW) * F.coalesce("parsed_minutesAvailable", F.lit(60.0)) / F.lit(60.0))
    lower = F.lit(0.65) * expected - F.coalesce("kWhDelivered", F.lit(0.0))
    return S.schedule_input(adapters.sessions(spark, sf), lower)


def _filled(spark, sf):
    return S.filled_slots(_input(spark, sf))


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _out(df):
    """Dates as text, which both engines hand over alike."""
    return df.withColumn("date", F.col("date").cast("string"))


@B.query("energy_targets", with_ctes("""
SELECT session_id, round("required_kWh", 6) AS "required_kWh", max_slots, round("target_kWh", 6) AS "target_kWh"
FROM targets""", TARGETS))
def energy_targets(spark, sf):
    return S.energy_targets(_input(spark, sf)).select("session_id", _r("required_kWh"), "max_slots", _r("target_kWh"))


@B.query("slot_caps", with_ctes("SELECT session_id, time_slot, cap_kw FROM caps", SLOTS))
def slot_caps(spark, sf):
    return S.priced_slots(_input(spark, sf), cluster=False).select("session_id", "time_slot", "cap_kw")


SHORT = S.ScheduleParams(horizon_hours=1, trickle_kw=0.0)


@B.query("infeasible_sessions", with_ctes("""
SELECT session_id, round(max("target_kWh"), 6) AS "target_kWh", sum(cap * 0.25e0) AS "capacity_kWh"
FROM (SELECT *, CASE WHEN cap_kw = 0.5 THEN 0e0 ELSE cap_kw END AS cap FROM caps WHERE time_slot < 4)
GROUP BY 1 HAVING max("target_kWh") > sum(cap * 0.25e0)""", SLOTS))
def infeasible_sessions(spark, sf):
    """With a horizon of one hour and no trickle charging, under which some sessions are infeasible."""
    return S.infeasible(_input(spark, sf), SHORT).select("session_id", _r("target_kWh"), "capacity_kWh")


@B.query("fill_cheapest_slots", with_ctes("SELECT session_id, time_slot, round(kw, 6) AS kw, round(kwh, 6) AS kwh FROM filled", FILLED))
def fill_cheapest_slots(spark, sf):
    return _filled(spark, sf).select("session_id", "time_slot", _r("kw"), _r("kwh"))


@B.query("schedule_rows", with_ctes('SELECT * REPLACE ("date"::VARCHAR AS "date") FROM schedule', FILLED))
def schedule_rows(spark, sf):
    return _out(S.schedule_rows(_filled(spark, sf)))


@B.query("schedule_top_users", with_ctes("""
SELECT * REPLACE ("date"::VARCHAR AS "date") FROM schedule WHERE user_id IN (
  SELECT "parsed_userID" FROM active GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)""", FILLED))
def schedule_top_users(spark, sf):
    return _out(for_top_users(S.schedule_rows(_filled(spark, sf)), _input(spark, sf)))


@B.query("slot_load", with_ctes('SELECT site, "date"::VARCHAR AS "date", time_slot, round(optimized_kw, 4) AS load_kw FROM opt', LOADS))
def slot_load(spark, sf):
    return _out(S.slot_load(S.schedule_rows(_filled(spark, sf)))).withColumn("load_kw", F.round("load_kw", 4))


@B.query("naive_profile", with_ctes('SELECT * REPLACE ("date"::VARCHAR AS "date") FROM naive', LOADS))
def naive_profile(spark, sf):
    return _out(S.naive_profile(_input(spark, sf)))


_BOTH = """
loads AS (
  SELECT n.site, n."date", n.time_slot, n.naive_kw, coalesce(o.optimized_kw, 0e0) AS optimized_kw
  FROM naive n LEFT JOIN opt o USING (site, "date", time_slot))"""


@B.query("peak_reduction", with_ctes("""
SELECT site, "date"::VARCHAR AS "date", max(naive_kw) AS naive_peak, round(max(optimized_kw), 4) AS optimized_peak,
  round(100 * (1 - max(optimized_kw) / max(naive_kw)), 4) AS reduction_pct FROM loads GROUP BY ALL""", LOADS, _BOTH))
def peak_reduction(spark, sf):
    return _out(S.peak_reduction(S.load_profiles(_input(spark, sf)))).withColumns({
        "optimized_peak": F.round("optimized_peak", 4), "reduction_pct": F.round("reduction_pct", 4)})


@B.query("before_after", with_ctes("""
SELECT site, "date"::VARCHAR AS "date", time_slot, naive_kw, round(optimized_kw, 4) AS optimized_kw,
  max(naive_kw) OVER w AS naive_peak, round(max(optimized_kw) OVER w, 4) AS optimized_peak,
  round(100 * (1 - max(optimized_kw) OVER w / max(naive_kw) OVER w), 4) AS reduction_pct
FROM loads WINDOW w AS (PARTITION BY site, "date")""", LOADS, _BOTH))
def before_after(spark, sf):
    return _out(S.load_profiles(_input(spark, sf))).withColumns({
        c: F.round(c, 4) for c in ("optimized_kw", "optimized_peak", "reduction_pct")})


@B.query("gantt_rows", with_ctes("""
SELECT site, "date"::VARCHAR AS "date", user_id, time_slot, CASE WHEN urgency >= 75 THEN 'very high' WHEN urgency >= 60 THEN 'high'
  WHEN urgency >= 45 THEN 'medium' ELSE 'low' END AS band
FROM schedule WHERE user_id IN (
  SELECT "parsed_userID" FROM active GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)""", FILLED))
def gantt_rows(spark, sf):
    return _out(S.gantt_rows(S.schedule_rows(_filled(spark, sf)), _input(spark, sf)))


@B.query("schedule_audit", with_ctes("""
SELECT * REPLACE ("date"::VARCHAR AS "date") FROM (
  SELECT site, "date", count(*) FILTER (kwh < target - 1e-6 AND target <= capacity) AS target_violations,
    count(*) FILTER (target > capacity) AS infeasible_sessions, sum(charger)::BIGINT AS charger_violations,
    sum(late)::BIGINT AS late_violations, round(sum(after), 4) AS kwh_after_departure
  FROM (SELECT site, "date", session_id, sum(kwh) AS kwh, max("target_kWh") AS target, sum(cap_kw * 0.25e0) AS capacity,
      count(*) FILTER (kw > 11 + 1e-6) AS charger, count(*) FILTER (kw > cap_kw + 1e-6) AS late,
      sum(CASE WHEN time_slot >= max_slots THEN kwh ELSE 0e0 END) AS after
    FROM filled GROUP BY ALL) GROUP BY ALL)
JOIN (SELECT site, "date", count(*) FILTER (load > 400 + 1e-6) AS grid_violations FROM (
    SELECT site, "date", time_slot, sum(kw) AS load FROM filled GROUP BY ALL) GROUP BY ALL) USING (site, "date")""", FILLED))
def schedule_audit(spark, sf):
    return _out(S.audit(_filled(spark, sf))).withColumn("kwh_after_departure", F.round("kwh_after_departure", 4))


@B.query("peak_aware_one_round", with_ctes("""
SELECT site, "date"::VARCHAR AS "date", round(max(load), 4) AS peak_kw, round(sum(cost) + max(load), 3) AS objective,
  round(sum(cost) + sum(load) / 32, 3) AS dual_bound FROM (
  SELECT site, "date", time_slot, sum(kw) AS load, sum(kw * price) AS cost FROM filled GROUP BY ALL)
GROUP BY ALL""", FILLED))
def peak_aware_one_round(spark, sf):
    """The first round of the price loop, whose peak prices are still equal."""
    report = S.schedule(_input(spark, sf), rounds=1).report
    return _out(report.select("site", "date", _r("peak_kw", 4), _r("objective", 3), _r("dual_bound", 3)))


@B.query("peak_aware_audit", with_ctes("""
SELECT site, "date"::VARCHAR AS "date", 0::BIGINT AS target_violations,
  count(*) FILTER (target > capacity) AS infeasible_sessions, 0::BIGINT AS charger_violations,
  0::BIGINT AS late_violations, 0::BIGINT AS grid_violations
FROM (SELECT site, "date", session_id, max("target_kWh") AS target, sum(cap_kw * 0.25e0) AS capacity FROM caps GROUP BY ALL)
GROUP BY ALL""", SLOTS))
def peak_aware_audit(spark, sf):
    """The audit of the price loop's rows: every limit holds, and sessions are judged by their own targets."""
    return _out(S.audit(S.schedule(_input(spark, sf)).rows)).drop("kwh_after_departure")


#: A grid limit that the cheapest fill breaks in most groups of the test tables.
TIGHT_KW = 100.0


@B.query("peak_aware_tight_audit", with_ctes(f"""
SELECT site, "date"::VARCHAR AS "date", over_before, infeasible_sessions, CASE WHEN impossible THEN 'infeasible' ELSE 'feasible' END AS status,
  CASE WHEN NOT impossible THEN 0::BIGINT END AS target_violations, 0::BIGINT AS charger_violations, 0::BIGINT AS late_violations,
  0::BIGINT AS grid_violations
FROM (
  SELECT site, "date", bool_or(first_due > {TIGHT_KW} * 0.25e0 * (time_slot + 1) + 1e-6
      OR last_due > {TIGHT_KW} * 0.25e0 * (32 - time_slot) + 1e-6) AS impossible
  FROM (SELECT site, "date", time_slot, sum(greatest(0, need - later)) AS first_due, sum(greatest(0, need - earlier)) AS last_due
    FROM (SELECT site, "date", time_slot, greatest(0, least("target_kWh", sum(room) OVER s)) AS need,
        coalesce(sum(room) OVER (PARTITION BY site, "date", session_id ORDER BY time_slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later,
        coalesce(sum(room) OVER (PARTITION BY site, "date", session_id ORDER BY time_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM (SELECT *, cap_kw * 0.25e0 AS room FROM caps) WINDOW s AS (PARTITION BY site, "date", session_id)) GROUP BY ALL) GROUP BY ALL)
JOIN (SELECT site, "date", count(*) FILTER (load > {TIGHT_KW} + 1e-6) AS over_before FROM (
    SELECT site, "date", time_slot, sum(kw) AS load FROM filled GROUP BY ALL) GROUP BY ALL) USING (site, "date")
JOIN (SELECT site, "date", count(*) FILTER (target > capacity) AS infeasible_sessions FROM (
    SELECT site, "date", session_id, max("target_kWh") AS target, sum(cap_kw * 0.25e0) AS capacity FROM caps GROUP BY ALL)
  GROUP BY ALL) USING (site, "date")""", FILLED))
def peak_aware_tight_audit(spark, sf):
    """The audit under a limit that binds: slots over it before, states of the groups, and no limit broken after."""
    params = S.ScheduleParams(grid_kw=TIGHT_KW)
    plan = S.schedule(_input(spark, sf), params)
    after = S.audit(plan.rows, params)
    before = S.audit(_filled(spark, sf), params).select(*S.GROUP, F.col("grid_violations").alias("over_before"))
    both = after.join(before, S.GROUP).join(plan.report.select(*S.GROUP, "status"), S.GROUP)
    targets = F.when(F.col("status") == "feasible", F.col("target_violations"))
    return _out(both.select(*S.GROUP, "over_before", "infeasible_sessions", "status", targets.alias("target_violations"),
                            "charger_violations", "late_violations", "grid_violations"))


@B.query("peak_aware_schedule")
def peak_aware_schedule(spark, sf):
    """Report per group; the rows behind it are built by the same call."""
    return _out(S.schedule(_input(spark, sf)).report)
