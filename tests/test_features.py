from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chargeframe.functions import energy, jsontext, timestamps
from chargeframe.plans.prepare import add_features, normalize_user_inputs, session_table
from chargeframe.operators import cleaning


def test_golden_row(spark):
    start = dt.datetime(2019, 1, 1, 18, 0)
    row = spark.createDataFrame(
        [(80.0, 222.0, 514.0, 17.76, 1, 30, 0.71, 0.9, "high", 17.76 - 5.226, start,
          start + dt.timedelta(hours=8, minutes=30, seconds=15))],
        "parsed_milesRequested double, parsed_WhPerMile double, parsed_minutesAvailable double,"
        " parsed_kWhRequested double, revisionCount int, urgency_score int, flexibility_index double,"
        " habit_stability double, grid_impact_proxy string, kWhDelivered double, connectionTime timestamp_ntz,"
        " disconnectTime timestamp_ntz")
    got = add_features(row).first()
    assert got["urgency_flex_interaction"] == 21.299999999999997
    assert got["revision_urgency"] == 30.0
    assert got["habit_grid"] == 1.8
    assert got["energy_per_minute"] == 0.0345525285106512
    assert got["request_efficiency"] == 0.3603603441279124
    assert (got["hour"], got["is_peak"]) == (18, 1)
    assert got["hour_sin"] == -1.0
    assert got["hour_cos"] == -1.8369701987210297e-16
    assert got["charging_efficiency"] == pytest.approx(0.7057432432432432, abs=1e-15)
    assert got["requested_gap"] == pytest.approx(5.226, abs=1e-12)
    assert got["duration_hours"] == pytest.approx(8.504166666666666, abs=1e-12)
    assert got["day_of_week_encoded"] == 1


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_parse_utc_does_not_depend_on_the_session_zone(spark, zone):
    texts = ["Tue, 1 Jan 2019 00:00:00 GMT", "2019-01-01T10:00:00-08:00", "2019-01-01 10:00:00", "2019-01-01",
             "2019-11-03T09:30:00Z", "garbage", "", None]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(timestamps.parse_utc("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    day = dt.datetime(2019, 1, 1)
    assert got == [day, day + dt.timedelta(hours=18), day + dt.timedelta(hours=10), day,
                   dt.datetime(2019, 11, 3, 9, 30), None, None, None]


def test_rules_at_the_edges(spark):
    nan = float("nan")
    rows = [(None, None, None), (0.0, 0.0, 0), (nan, nan, None), (2000.0, 30.0, 7), (100.0, 30.5, 5), (14.0, 10.0, 1)]
    df = spark.createDataFrame(rows, "parsed_minutesAvailable double, parsed_kWhRequested double, revisionCount int")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in energy.behavior_rules().items()]).collect()]
    default = (95, 0.2, 1.0, "low")
    assert got[:3] == [default] * 3
    assert got[3] == (0, 1.0, 0.0, "medium")
    assert got[4][0] == int(100 * (1 - 100 / 1440)) and got[4][3] == "high" and got[4][2] == 0.0
    assert got[5][3] == "low" and math.isclose(got[5][1], 14 / 300)


def test_input_texts(spark):
    texts = [None, "", "  ", "[]", "{}", "nan", "None", "[{\"userID\": 1", "{\"userID\": 7}",
             "[{\"userID\": 1}, {\"userID\": 2}]", "[{\"userID\": 1}, 5]", "[5, {\"userID\": 3}]", "\n[{\"userID\": 4}]\t",
             "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, userInputs string")
    got = {r["i"]: (r["latest"]["userID"] if r["latest"] else None, r["revisionCount"])
           for r in jsontext.parse_user_inputs(df).collect()}
    assert [got[i] for i in range(8)] == [(None, None)] * 8
    assert got[8] == (7, 1) and got[9] == (2, 2) and got[10] == (None, 2) and got[11] == (3, 2) and got[12] == (4, 1)
    assert got[13] == (None, None)
    kept = {r["i"] for r in cleaning.drop_empty_json(df, "userInputs").collect()}
    assert kept == {7, 8, 9, 10, 11, 12, 13}


def test_replies(spark):
    full = '{"urgency_score": 40, "flexibility_index": 0.5, "habit_stability": 0.25, "grid_impact_proxy": "low"}'
    replies = {
        "list": f"[{full}]",
        "wrapped": f'{{"augmented_rows": [{full}]}}',
        "thought": f"<think>a</think>b</think>```json\n[{full}]\n```",
        "two": f"[{full}, {full}]",
        "object": full,
        "broken": f"[{full}",
        "null": f"[{full.replace('40', 'null')}]",
        "short": '[{"urgency": 41, "flexibility": 0.5, "habit": 0.25, "grid_impact_proxy": "low"}]',
    }
    sessions = spark.createDataFrame([(k, 60.0, 20.0, 1) for k in [*replies, "none"]],
                                     "sessionID string, parsed_minutesAvailable double, parsed_kWhRequested double,"
                                     " revisionCount int")
    texts = spark.createDataFrame(list(replies.items()), "sessionID string, content string")
    merged = jsontext.merge_augmented(sessions, jsontext.extract_json_reply(texts))
    got = {r["sessionID"]: (r["used_rules"], r["urgency_score"], r["grid_impact_proxy"]) for r in merged.collect()}
    rules = (True, 95, "medium")
    for k in ("list", "wrapped", "thought"):
        assert got[k] == (False, 40, "low")
    for k in ("two", "object", "broken", "none"):
        assert got[k] == rules, k
    assert got["null"] == (False, None, "low")
    assert got["short"] == (False, 41, "low")


def test_ordinal_and_bands(spark):
    df = spark.createDataFrame([("low", 75), ("medium", 60), ("high", 45), ("other", 44), (None, None)], "c string, u int")
    got = [tuple(r) for r in df.select(energy.ordinal("c"), energy.urgency_band("u")).collect()]
    assert got == [(0, "very high"), (1, "high"), (2, "medium"), (None, "low"), (None, "low")]


def test_defaults_and_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, None, "x"), (3, 1.0, " \t")], "i int, v double, s string")
    filled = cleaning.fill_defaults(df, {"v": 5.0, "w": 7.0}).orderBy("i").collect()
    assert [(r["v"], r["w"]) for r in filled] == [(5.0, 7.0), (5.0, 7.0), (1.0, 7.0)]
    assert [r["i"] for r in cleaning.drop_missing(df, ["v"]).collect()] == [3]
    assert [r["i"] for r in cleaning.drop_blank(df, "s").collect()] == [2]
    census = {r["column"]: (r["n_null"], r["n_empty"]) for r in cleaning.missing_counts(df, ["v", "s"]).collect()}
    assert census == {"v": (2, 0), "s": (1, 0)}
    assert tuple(cleaning.blank_report(df, "s").first()) == (3, 1, 2)


def test_preparation_is_one_plan(spark):
    raw = spark.createDataFrame(
        [("a", "Tue, 1 Jan 2019 08:00:00 GMT", "Tue, 1 Jan 2019 12:00:00 GMT", "2019-01-01 11:00:00", 5.0,
          '[{"userID": 1, "milesRequested": 10, "WhPerMile": 250, "minutesAvailable": 120}]'),
         ("b", "Tue, 1 Jan 2019 08:00:00 GMT", None, "  ", 5.0, '[{"userID": 1}]'),
         ("c", "Tue, 1 Jan 2019 08:00:00 GMT", None, "x", 5.0, "[]")],
        "sessionID string, connectionTime string, disconnectTime string, doneChargingTime string, kWhDelivered double,"
        " userInputs string")
    rows = session_table(raw).collect()
    assert [r["sessionID"] for r in rows] == ["a"]
    assert rows[0]["parsed_kWhRequested"] == 2.5 and rows[0]["day_of_week"] == "Tuesday"
    assert rows[0]["urgency_score"] == int(100 * (1 - 120 / 1440))
    assert normalize_user_inputs(raw.withColumn("connectionTime", timestamps.parse_utc("connectionTime"))).count() == 3
    assert F is not None
