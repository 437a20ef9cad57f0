"""Scans, sources and sinks, each checked by a round trip through storage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeframe import adapters
from chargeframe.functions.energy import add_energy
from chargeframe.operators import aggregates
from chargeframe.registry.book import Book, table
from chargeframe.registry.sql import BASE, PREDICTIONS, SESSIONS, with_ctes
from chargeframe.runtime import scratch_path
from chargeframe.schemas import RUN_LOG
from chargeframe.sources import readers, writers

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

_CHECKED = ["sessionID", "parsed_userID", "connectionTime", "disconnectTime", "doneChargingTime", "day_of_week",
            "kWhDelivered", "revisionCount", "urgency_score", "grid_impact_proxy"]
_CHECKED_SQL = ", ".join(f'round("{c}", 6) AS "{c}"' if c == "kWhDelivered" else f'"{c}"' for c in _CHECKED)


def _checked(df):
    return df.select(*_CHECKED).withColumn("kWhDelivered", F.round("kWhDelivered", 6))


@B.query("scan_sessions_csv", with_ctes("SELECT " + _CHECKED_SQL.replace(
    '"doneChargingTime"', 'nullif("doneChargingTime", \'\') AS "doneChargingTime"') + " FROM sessions", SESSIONS))
def scan_sessions_csv(spark, sf):
    path = scratch_path(spark, "sessions-csv")
    writers.write_csv(adapters.main_columns(adapters.sessions(spark, sf)), path)
    return _checked(readers.read_sessions(spark, path, "csv"))


@B.query("scan_sessions_parquet", with_ctes(f"SELECT {_CHECKED_SQL} FROM sessions", SESSIONS))
def scan_sessions_parquet(spark, sf):
    path = scratch_path(spark, "sessions-parquet")
    writers.write_parquet(adapters.main_columns(adapters.sessions(spark, sf)), path)
    return _checked(readers.read_sessions(spark, path, "parquet"))


@B.query("scan_session_pages", with_ctes("""
SELECT 'id'||"sessionID" AS "_id", "sessionID", "stationID",
  strftime("connectionTime", '%a, %-d %b %Y %H:%M:%S GMT') AS "connectionTime", round("kWhDelivered", 6) AS "kWhDelivered",
  CASE WHEN event_id % 67 <> 0 THEN "revisionCount" END AS n_inputs FROM base""", BASE))
def scan_session_pages(spark, sf):
    path = scratch_path(spark, "pages")
    adapters.session_pages(adapters.plain_sessions(spark, sf)).write.json(path)
    items = readers.read_session_pages(spark, path, multiline=False)
    n = F.when(F.col("userInputs").isNotNull(), F.size("userInputs"))
    return items.select("_id", "sessionID", "stationID", "connectionTime",
                        F.round("kWhDelivered", 6).alias("kWhDelivered"), n.alias("n_inputs"))


@B.query("time_range_filter", """
SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""")
def time_range_filter(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return readers.between_times(events, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))


@B.query("sink_csv", with_ctes("""
SELECT "sessionID", round("true_kWh", 6) AS "true_kWh", round(pred_median, 6) AS pred_median,
  round(pred_05, 6) AS pred_05, round(pred_95, 6) AS pred_95 FROM pred""", PREDICTIONS))
def sink_csv(spark, sf):
    path = scratch_path(spark, "predictions-csv")
    cols = ["true_kWh", "pred_median", "pred_05", "pred_95"]
    pred = adapters.naive_predictions(adapters.sessions(spark, sf)).select("sessionID", *cols)
    writers.write_csv(pred, path)
    back = spark.read.options(**readers.TEXT_OPTIONS).schema(pred.schema).csv(path)
    return back.select("sessionID", *[F.round(c, 6).alias(c) for c in cols])


@B.query("sink_parquet", """
SELECT o_orderkey, o_totalprice, o_orderdate, month(o_orderdate)::INT AS "month" FROM orders""")
def sink_parquet(spark, sf):
    path = scratch_path(spark, "orders-parquet")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate",
                                               F.month("o_orderdate").alias("month"))
    writers.write_parquet(orders, path, ["month"])
    return spark.read.schema(orders.schema).parquet(path)


@B.query("append_run_log", with_ctes(" UNION ALL ".join(f"""
SELECT '{name}' AS experiment, {n}::INT AS n_features, round(avg(abs("true_kWh" - {p})), 6) AS test_mae,
  round(sqrt(avg(("true_kWh" - {p}) ** 2)), 6) AS test_rmse,
  round(1 - sum(("true_kWh" - {p}) ** 2) / (count(*) * var_pop("true_kWh")), 6) AS test_r2, TRUE AS has_timestamp
FROM pred""" for name, n, p in [("median", 23, "pred_median"), ("low", 19, "pred_05")]), PREDICTIONS))
def append_run_log(spark, sf):
    path = scratch_path(spark, "run-log")
    pred = adapters.naive_predictions(adapters.sessions(spark, sf))
    for name, n, column in [("median", 23, "pred_median"), ("low", 19, "pred_05")]:
        m = aggregates.regression_metrics(pred, "true_kWh", column)
        writers.log_run(m.select(F.lit(name).alias("experiment"), F.lit(n).alias("n_features"),
                                 F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"),
                                 F.col("r2").alias("test_r2")), path)
    log = spark.read.schema(RUN_LOG).parquet(path)
    return log.select("experiment", "n_features", *[F.round(c, 6).alias(c) for c in ("test_mae", "test_rmse", "test_r2")],
                      F.col("timestamp").isNotNull().alias("has_timestamp"))


@B.query("export_json_records", with_ctes("""
SELECT coalesce(CASE WHEN event_id % 131 <> 0 THEN "sessionID" END,
    'session_'||(row_number() OVER (ORDER BY "connectionTime", event_id) - 1)) AS "sessionID",
  strftime("connectionTime", '%Y-%m-%d %H:%M:%S.%f') AS "connectionTime",
  round("parsed_kWhRequested", 6) AS "parsed_kWhRequested", urgency_score::DOUBLE AS urgency_score,
  round("kWhDelivered" / nullif("parsed_kWhRequested", 0), 6) AS charging_efficiency
FROM sessions""", SESSIONS))
def export_json_records(spark, sf):
    path = scratch_path(spark, "records")
    df = add_energy(adapters.sessions(spark, sf)).withColumns({
        "sessionID": F.when(F.col("event_id") % 131 != 0, F.col("sessionID")),
        "urgency_score": F.col("urgency_score").cast("double")})
    columns = ["sessionID", "connectionTime", "parsed_kWhRequested", "urgency_score", "charging_efficiency"]
    writers.write_json_records(df, path, ["connectionTime", "event_id"], columns)
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("sessionID", "connectionTime") else T.DoubleType())
                           for c in columns])
    back = spark.read.schema(schema).json(path)
    return back.withColumns({c: F.round(c, 6) for c in ("parsed_kWhRequested", "charging_efficiency")})

