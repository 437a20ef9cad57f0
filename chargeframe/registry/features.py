"""Scalar functions and JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.functions import energy, jsontext, timestamps
from chargeframe.functions.hashing import hash_fraction
from chargeframe.operators.cleaning import drop_empty_json
from chargeframe.plans.prepare import normalize_user_inputs
from chargeframe.registry.book import Book, table
from chargeframe.registry.sql import BASE, SESSIONS, with_ctes
from chargeframe.sources.readers import explode_user_inputs, flatten_struct

B = Book()
QUERIES, ORACLE = B.queries, B.oracle


def _rounded(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@B.query("parse_utc_timestamps", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN date_trunc('second', ts) + INTERVAL 8 HOUR
  ELSE date_trunc('second', ts) END AS parsed FROM events""")
def parse_utc_timestamps(spark, sf):
    events = table(spark, sf, "events")
    form = F.col("event_id") % 4
    text = (F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
            .when(form == 1, F.date_format("ts", adapters.RFC1123))
            .when(form == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'-08:00'"))
            .otherwise(F.concat(F.lit("not a time "), F.col("event_type"))))
    return events.select("event_id", timestamps.parse_utc(text).alias("parsed"))


@B.query("calendar_features", """
SELECT event_id, hour(ts)::INT AS "hour", month(ts)::INT AS "month", ts::DATE::VARCHAR AS "date",
  (isodow(ts) - 1)::INT AS day_of_week_encoded, (isodow(ts) >= 6)::INT AS is_weekend,
  (hour(ts) BETWEEN 17 AND 21)::INT AS is_peak FROM events""")
def calendar_features(spark, sf):
    return timestamps.add_calendar(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts").withColumn(
        "date", F.col("date").cast("string"))


@B.query("calendar_local", """
SELECT event_id, hour(l)::INT AS "hour", l::DATE::VARCHAR AS "date" FROM (
  SELECT event_id, ts - INTERVAL 8 HOUR AS l FROM events)""")
def calendar_local(spark, sf):
    """January only, so the zone is eight hours behind UTC throughout."""
    df = timestamps.add_calendar(table(spark, sf, "events").select("event_id", "ts"), "ts", tz="America/Los_Angeles")
    return df.select("event_id", "hour", F.col("date").cast("string").alias("date"))


@B.query("cyclic_hour", """
SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) + 0e0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) + 0e0 AS hour_cos
FROM events""")
def cyclic_hour(spark, sf):
    df = table(spark, sf, "events").select("event_id", *timestamps.cyclic_hour(F.hour("ts")))
    return _rounded(df, ["hour_sin", "hour_cos"], 9)


@B.query("duration_hours", with_ctes("""
SELECT "sessionID", round(date_diff('microsecond', "connectionTime", "disconnectTime") / 3.6e9, 9) AS duration_hours
FROM base""", BASE))
def duration_hours(spark, sf):
    df = adapters.plain_sessions(spark, sf)
    return _rounded(df.select("sessionID", timestamps.duration_hours().alias("duration_hours")), ["duration_hours"], 9)


@B.query("energy_features", with_ctes("""
SELECT "sessionID", round("kWhDelivered" / nullif("parsed_kWhRequested", 0), 6) AS charging_efficiency,
  round("parsed_kWhRequested" - "kWhDelivered", 6) AS requested_gap,
  round("parsed_kWhRequested" / ("parsed_minutesAvailable" + 1e-5), 6) AS energy_per_minute,
  round("parsed_milesRequested" / ("parsed_WhPerMile" + 1e-5), 6) AS request_efficiency FROM base""", BASE))
def energy_features(spark, sf):
    df = energy.add_energy(adapters.plain_sessions(spark, sf))
    cols = ["charging_efficiency", "requested_gap", "energy_per_minute", "request_efficiency"]
    return _rounded(df.select("sessionID", *cols), cols)


@B.query("interaction_features", with_ctes("""
SELECT "sessionID", round(urgency_score * flexibility_index, 6) AS urgency_flex_interaction,
  ("revisionCount" * urgency_score)::DOUBLE AS revision_urgency,
  round(habit_stability * coalesce(CASE grid_impact_proxy WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END, 1), 6)
    AS habit_grid FROM sessions""", SESSIONS))
def interaction_features(spark, sf):
    df = adapters.sessions(spark, sf).withColumn("grid_impact_proxy", energy.ordinal("grid_impact_proxy"))
    out = energy.add_interactions(df).select("sessionID", "urgency_flex_interaction", "revision_urgency", "habit_grid")
    return _rounded(out, ["urgency_flex_interaction", "habit_grid"])


@B.query("ordinal_map", with_ctes("""
SELECT "sessionID", grid_impact_proxy AS category,
  CASE grid_impact_proxy WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS code FROM sessions""", SESSIONS))
def ordinal_map(spark, sf):
    return adapters.sessions(spark, sf).select("sessionID", F.col("grid_impact_proxy").alias("category"),
                                               energy.ordinal("grid_impact_proxy").alias("code"))


@B.query("behavior_rules", with_ctes("""
SELECT "sessionID", urgency_score, round(flexibility_index, 9) AS flexibility_index,
  round(habit_stability, 9) AS habit_stability,
  CASE WHEN coalesce(nullif("parsed_kWhRequested", 0), 10e0) > 30 THEN 'high'
    WHEN coalesce(nullif("parsed_kWhRequested", 0), 10e0) > 10 THEN 'medium' ELSE 'low' END AS grid_impact_proxy
FROM sessions""", SESSIONS))
def behavior_rules(spark, sf):
    base = adapters.plain_sessions(spark, sf).withColumns(energy.behavior_rules())
    cols = ["urgency_score", "flexibility_index", "habit_stability", "grid_impact_proxy"]
    return _rounded(base.select("sessionID", *cols), cols[1:3], 9)


@B.query("urgency_band", with_ctes("""
SELECT "sessionID", CASE WHEN urgency_score >= 75 THEN 'very high' WHEN urgency_score >= 60 THEN 'high'
  WHEN urgency_score >= 45 THEN 'medium' ELSE 'low' END AS band FROM sessions""", SESSIONS))
def urgency_band(spark, sf):
    return adapters.sessions(spark, sf).select("sessionID", energy.urgency_band("urgency_score").alias("band"))


REPLIES = SESSIONS + """,
parts AS (
  SELECT event_id, "sessionID", '"urgency_score": '||(event_id % 101)||', "flexibility_index": 0.'||(event_id % 97)
      ||', "habit_stability": 0.'||(event_id % 13) AS head,
    ', "grid_impact_proxy": "'||(['low', 'medium', 'high'])[event_id % 3 + 1]||'"' AS tail FROM sessions),
replies AS (
  SELECT event_id, "sessionID", CASE event_id % 7
    WHEN 0 THEN '{"augmented_rows": [{'||head||tail||'}]}'
    WHEN 1 THEN '<think>maybe [{"a": 1}]</think> Here:'||chr(10)||'```json'||chr(10)||'[{'||head||tail||'}]'||chr(10)||'``` done'
    WHEN 2 THEN 'Sure'||chr(10)||'```'||chr(10)||'[{'||head||tail||'}]'||chr(10)||'```'
    WHEN 3 THEN '[{'||head||tail||'}]'
    WHEN 4 THEN 'I cannot answer that.'
    WHEN 5 THEN '[{'||head||'}]'
    ELSE replace(replace(replace('[{'||head||tail||'}]', '_score', ''), '_index', ''), '_stability', '') END AS content
  FROM parts),
bodies AS (SELECT *, trim(list_last(string_split(content, '</think>')), ' '||chr(10)) AS body FROM replies),
payloads AS (
  SELECT event_id, "sessionID", CASE WHEN json_valid(p) THEN p END AS payload FROM (
    SELECT *, trim(CASE WHEN contains(body, '```json') THEN string_split(string_split(body, '```json')[2], '```')[1]
      WHEN contains(body, '```') THEN string_split(body, '```')[2] ELSE body END, ' '||chr(10)) AS p FROM bodies))
"""


@B.query("extract_json_reply", with_ctes('SELECT "sessionID", payload FROM payloads', REPLIES))
def extract_json_reply(spark, sf):
    replies = adapters.replies(adapters.sessions(spark, sf))
    return jsontext.extract_json_reply(replies).select("sessionID", "payload")


@B.query("merge_augmented", with_ctes("""
SELECT "sessionID", used_rules, CASE WHEN used_rules THEN urgency_score ELSE u END AS urgency_score,
  round(CASE WHEN used_rules THEN flexibility_index ELSE f END, 9) AS flexibility_index,
  round(CASE WHEN used_rules THEN habit_stability ELSE h END, 9) AS habit_stability,
  CASE WHEN used_rules THEN CASE WHEN coalesce(nullif("parsed_kWhRequested", 0), 10e0) > 30 THEN 'high'
    WHEN coalesce(nullif("parsed_kWhRequested", 0), 10e0) > 10 THEN 'medium' ELSE 'low' END ELSE g END AS grid_impact_proxy
FROM (
  SELECT s.*, r.u, r.f, r.h, r.g, coalesce(r.u IS NULL OR r.f IS NULL OR r.h IS NULL OR r.g IS NULL, TRUE) AS used_rules
  FROM sessions s LEFT JOIN (
    SELECT "sessionID", coalesce(row->>'urgency_score', row->>'urgency')::INT AS u,
      coalesce(row->>'flexibility_index', row->>'flexibility')::DOUBLE AS f,
      coalesce(row->>'habit_stability', row->>'habit')::DOUBLE AS h, row->>'grid_impact_proxy' AS g
    FROM (SELECT "sessionID", coalesce(payload->'augmented_rows', payload::JSON)->0 AS row FROM payloads)) r
  USING ("sessionID"))""", REPLIES))
def merge_augmented(spark, sf):
    df = adapters.sessions(spark, sf)
    replies = jsontext.extract_json_reply(adapters.retried(adapters.replies(df)))
    merged = jsontext.merge_augmented(df, replies, order="attempt").select(
        "sessionID", "used_rules", "urgency_score", "flexibility_index", "habit_stability", "grid_impact_proxy")
    return _rounded(merged, ["flexibility_index", "habit_stability"], 9)


PARSED = """
forms AS (
  SELECT *, CASE WHEN event_id % 67 = 0 OR event_id % 61 = 0 OR event_id % 59 = 0 OR event_id % 53 = 0
      OR event_id % 47 = 0 OR event_id % 43 = 0 OR event_id % 41 = 0 THEN 'blank'
    WHEN event_id % 37 = 0 THEN 'bad' WHEN event_id % 31 = 0 THEN 'single' WHEN event_id % 29 = 0 THEN 'no_object'
    ELSE 'list' END AS form FROM base)
"""


@B.query("parse_user_inputs", with_ctes("""
SELECT "sessionID", CASE WHEN form IN ('single', 'list') THEN "parsed_userID" END AS "userID",
  CASE WHEN form IN ('single', 'list') THEN round("parsed_milesRequested", 6) END AS "milesRequested",
  CASE WHEN form IN ('single', 'list') THEN "parsed_minutesAvailable" END AS "minutesAvailable",
  CASE form WHEN 'single' THEN 1 WHEN 'no_object' THEN 2 WHEN 'list' THEN "revisionCount" END::INT AS "revisionCount"
FROM forms""", BASE, PARSED))
def parse_user_inputs(spark, sf):
    texts = adapters.input_texts(adapters.plain_sessions(spark, sf))
    parsed = jsontext.parse_user_inputs(texts.select("sessionID", "userInputs"))
    return parsed.select("sessionID", "latest.userID", F.round("latest.milesRequested", 6).alias("milesRequested"),
                         "latest.minutesAvailable", "revisionCount")


@B.query("normalize_user_inputs", with_ctes("""
SELECT "sessionID", CASE WHEN form <> 'bad' AND form <> 'no_object' THEN "parsed_userID" END AS "parsed_userID",
  CASE WHEN form <> 'bad' AND form <> 'no_object' THEN round("parsed_milesRequested", 6) END AS "parsed_milesRequested",
  CASE WHEN form <> 'bad' AND form <> 'no_object' THEN "parsed_WhPerMile" END AS "parsed_WhPerMile",
  CASE WHEN form <> 'bad' AND form <> 'no_object' THEN "parsed_minutesAvailable" END AS "parsed_minutesAvailable",
  CASE WHEN form <> 'bad' AND form <> 'no_object' THEN round("parsed_kWhRequested", 6) END AS "parsed_kWhRequested",
  CASE WHEN form <> 'bad' AND form <> 'no_object' THEN date_trunc('second', "disconnectTime") END AS "requestedDeparture",
  CASE form WHEN 'single' THEN 1 WHEN 'no_object' THEN 2 WHEN 'list' THEN "revisionCount" END::INT AS "revisionCount",
  dayname("connectionTime") AS day_of_week
FROM forms WHERE form <> 'blank'""", BASE, PARSED))
def normalize(spark, sf):
    base = adapters.plain_sessions(spark, sf)
    texts = adapters.input_texts(base).select("sessionID", "connectionTime", "userInputs")
    out = normalize_user_inputs(drop_empty_json(texts, "userInputs")).select(
        "sessionID", "parsed_userID", "parsed_milesRequested", "parsed_WhPerMile", "parsed_minutesAvailable",
        "parsed_kWhRequested", "requestedDeparture", "revisionCount", "day_of_week")
    return _rounded(out, ["parsed_milesRequested", "parsed_kWhRequested"])


@B.query("flatten_struct", with_ctes("""
SELECT 'id'||"sessionID" AS "item__id", "sessionID" AS "item_sessionID", "stationID" AS "item_stationID",
  strftime("connectionTime", '%a, %-d %b %Y %H:%M:%S GMT') AS "item_connectionTime",
  CASE WHEN event_id % 67 <> 0 THEN "parsed_userID" END AS "last_userID",
  CASE WHEN event_id % 67 <> 0 THEN "parsed_minutesAvailable" END AS "last_minutesAvailable" FROM base""", BASE))
def flatten(spark, sf):
    items = adapters.raw_items(adapters.plain_sessions(spark, sf))
    nested = items.select("item", F.try_element_at("item.userInputs", F.lit(-1)).alias("last"))
    return flatten_struct(nested, "_").select(
        "item__id", "item_sessionID", "item_stationID", "item_connectionTime", "last_userID", "last_minutesAvailable")


@B.query("explode_user_inputs", with_ctes("""
SELECT "sessionID", r::INT AS revision, "parsed_userID" AS "userID",
  round("parsed_milesRequested" + ("revisionCount" - r - 1), 6) AS "milesRequested"
FROM base, (SELECT unnest(range(5)) AS r) WHERE event_id % 67 <> 0 AND r < "revisionCount\"""", BASE))
def explode_inputs(spark, sf):
    df = adapters.user_inputs(adapters.plain_sessions(spark, sf))
    return explode_user_inputs(df).select("sessionID", "revision", "userID",
                                          F.round("milesRequested", 6).alias("milesRequested"))


@B.query("round_outputs", """
SELECT event_id, round(v / 3, 4) AS pred_point, round(v / 7, 2) AS power_kw, round(v / 11, 3) AS energy_kwh,
  round(v / 13, 1) AS urgency FROM (
  SELECT event_id, value + ('0x'||substr(md5('noise|'||event_id), 1, 15))::BIGINT::DOUBLE / 1152921504606846976e0 AS v FROM events)""")
def round_outputs(spark, sf):
    v = F.col("value") + hash_fraction("noise", "event_id")
    df = table(spark, sf, "events").select(
        "event_id", (v / 3).alias("pred_point"), (v / 7).alias("power_kw"), (v / 11).alias("energy_kwh"),
        (v / 13).alias("urgency"))
    return energy.round_columns(df, {"pred_point": 4, "power_kw": 2, "energy_kwh": 3, "urgency": 1})
