"""SQL building blocks: the adapter's rules restated for the checking engine."""

from __future__ import annotations


def seeded_hash(seed, *cols: str) -> str:
    parts = "||'|'||".join(f"({c})::VARCHAR" for c in cols)
    return f"('0x'||substr(md5('{seed}|'||{parts}),1,15))::BIGINT"


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


BASE = f"""
base0 AS (
  SELECT event_id, event_id::VARCHAR AS "sessionID", (event_id % 53)::VARCHAR AS "stationID",
    'S'||((event_id % 53) % 5)::VARCHAR AS site, ts::DATE AS "date",
    user_id AS "parsed_userID", ts AS "connectionTime",
    CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 0e0
      ELSE (15 + 6 * json_extract_string(props, '$.k')::INT)::DOUBLE END AS "parsed_minutesAvailable",
    10e0 + value % 120e0 AS "parsed_milesRequested",
    (200 + 20 * (user_id % 10))::DOUBLE AS "parsed_WhPerMile",
    (1 + event_id % 5)::INT AS "revisionCount",
    CASE WHEN event_id % 71 <> 0 THEN dayname(ts) END AS day_of_week
  FROM events),
base1 AS (
  SELECT *, "parsed_milesRequested" * "parsed_WhPerMile" / 1000e0 AS "parsed_kWhRequested",
    (coalesce("parsed_minutesAvailable", 60e0) + event_id % 61)::INT AS stay FROM base0),
base AS (
  SELECT * EXCLUDE (stay), "connectionTime" + to_minutes(stay) AS "disconnectTime",
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN '   '
      ELSE strftime("connectionTime" + to_minutes(stay // 2), '%Y-%m-%d %H:%M:%S') END AS "doneChargingTime",
    CASE WHEN event_id % 79 <> 0 THEN least("parsed_kWhRequested", 6.6e0 * (stay / 60e0))
      * (0.6e0 + 0.4e0 * (({seeded_hash('kwh', 'event_id')})::DOUBLE / 1152921504606846976e0)) END AS "kWhDelivered"
  FROM base1)
"""

SESSIONS = BASE + """,
ruled AS (
  SELECT *, coalesce(nullif("parsed_minutesAvailable", 0), 60e0) AS mins,
    coalesce(nullif("parsed_kWhRequested", 0), 10e0) AS kwh FROM base),
sessions AS (
  SELECT * EXCLUDE (mins, kwh),
    greatest(least(trunc(100 * (1 - mins / 1440e0))::INT, 100), 0)::INT AS urgency_score,
    greatest(least(mins / 300e0, 1e0), 0e0) AS flexibility_index,
    greatest(least(1e0 - "revisionCount" / 5e0, 1e0), 0e0) AS habit_stability,
    CASE WHEN event_id % 73 = 0 THEN 'unknown' WHEN kwh > 30 THEN 'high' WHEN kwh > 10 THEN 'medium' ELSE 'low' END
      AS grid_impact_proxy
  FROM ruled)
"""

PREDICTIONS = SESSIONS + """,
taken AS (
  SELECT *, least("parsed_kWhRequested", 6.6e0 * coalesce("parsed_minutesAvailable", 60e0) / 60e0) AS taken
  FROM sessions WHERE "kWhDelivered" IS NOT NULL),
pred AS (
  SELECT "sessionID", site, "kWhDelivered" AS "true_kWh", taken * 0.8e0 AS pred_median,
    taken * 0.65e0 AS pred_05, taken * 0.95e0 AS pred_95 FROM taken)
"""

ACTIVE = SESSIONS + """,
active AS (
  SELECT * FROM (
    SELECT *, "parsed_kWhRequested" - coalesce("kWhDelivered", 0e0) AS "remaining_kWh",
      coalesce("parsed_minutesAvailable", 300e0) AS minutes_left FROM sessions)
  WHERE "remaining_kWh" > 0.5e0)
"""

TARGETS = ACTIVE + """,
lowered AS (
  SELECT site, "date", "sessionID" AS session_id, "parsed_userID", "remaining_kWh",
    0.65e0 * least("parsed_kWhRequested", 6.6e0 * coalesce("parsed_minutesAvailable", 60e0) / 60e0)
      - coalesce("kWhDelivered", 0e0) AS "lower_kWh",
    minutes_left, urgency_score, flexibility_index,
    urgency_score * flexibility_index AS urgency_flex_interaction
  FROM active),
targets AS (
  SELECT *, greatest("remaining_kWh", "lower_kWh") AS "required_kWh", trunc(minutes_left / 15)::INT AS max_slots,
    least(greatest("remaining_kWh", "lower_kWh") * 0.93e0, trunc(minutes_left / 15) * 2.75e0) AS "target_kWh"
  FROM lowered)
"""

SLOTS = TARGETS + """,
caps AS (
  SELECT *, CASE
      WHEN urgency_score > 80 AND flexibility_index < 0.3e0
        THEN CASE WHEN time_slot >= trunc(max_slots * 0.9e0)::INT THEN 2e0 ELSE 11e0 END
      WHEN time_slot >= max_slots THEN 0.5e0 ELSE 11e0 END AS cap_kw,
    0.01e0 + 0.06e0 * coalesce(urgency_flex_interaction, 1e0) * (32 - time_slot) AS price
  FROM targets, (SELECT unnest(range(32))::INT AS time_slot))
"""

FILLED = SLOTS + """,
filled AS (
  SELECT *, kwh / 0.25e0 AS kw FROM (
    SELECT *, least(greatest("target_kWh" - coalesce(prior, 0e0), 0e0), cap_kw * 0.25e0) AS kwh FROM (
      SELECT *, sum(cap_kw * 0.25e0) OVER (PARTITION BY session_id ORDER BY price, time_slot
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM caps))),
schedule AS (
  SELECT site, "date", session_id, "parsed_userID" AS user_id, time_slot, round(kw, 2) AS power_kw,
    round(kwh, 3) AS energy_kwh, round(coalesce(urgency_score, 0)::DOUBLE, 1) AS urgency
  FROM filled WHERE kw > 0.1e0)
"""

LOADS = FILLED + """,
groups AS (SELECT DISTINCT site, "date" FROM active),
chart AS (SELECT site, "date", unnest(range(40))::INT AS time_slot FROM groups),
naive AS (
  SELECT c.site, c."date", c.time_slot, 11e0 * count(a."sessionID") AS naive_kw
  FROM chart c LEFT JOIN active a ON a.site = c.site AND a."date" = c."date"
    AND c.time_slot < least(ceil(a."remaining_kWh" / 2.75e0) + 2, 40)
  GROUP BY ALL),
opt_groups AS (SELECT DISTINCT site, "date" FROM schedule),
opt AS (
  SELECT c.site, c."date", c.time_slot, coalesce(sum(s.power_kw), 0e0) AS optimized_kw
  FROM (SELECT site, "date", unnest(range(40))::INT AS time_slot FROM opt_groups) c
  LEFT JOIN schedule s ON s.site = c.site AND s."date" = c."date" AND s.time_slot = c.time_slot
  GROUP BY ALL)
"""
