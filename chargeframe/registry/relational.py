"""Projection, predicates, joins, aggregates, ordering and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.functions.energy import add_energy
from chargeframe.functions.jsontext import parse_user_inputs
from chargeframe.operators import aggregates, cleaning, encoding, joins, ordering
from chargeframe.registry.book import Book, table
from chargeframe.registry.sql import ACTIVE, BASE, PREDICTIONS, SESSIONS, seeded_hash, with_ctes
from chargeframe.runtime import materialize, union_all

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

# --- projection, predicates, nulls --------------------------------------------

SESSION_COLUMNS = ["kWhDelivered", "parsed_milesRequested", "parsed_WhPerMile", "parsed_minutesAvailable",
                   "parsed_kWhRequested", "revisionCount", "connectionTime", "disconnectTime", "parsed_userID"]


def _gappy_predictions(spark, sf):
    """Predictions of all sessions with a delivered amount, and of some where it is NaN, which must not count."""
    return adapters.naive_predictions(adapters.with_nan(adapters.sessions(spark, sf), "kWhDelivered"))


def _r(c, n=6):
    return F.round(c, n)


@B.query("project_columns", with_ctes(f"SELECT {', '.join(chr(34) + c + chr(34) for c in SESSION_COLUMNS)} FROM base", BASE))
def project_columns(spark, sf):
    return cleaning.project(adapters.sessions(spark, sf), SESSION_COLUMNS)


@B.query("drop_missing", with_ctes("""
SELECT "sessionID", "kWhDelivered", "parsed_minutesAvailable" FROM base
WHERE "kWhDelivered" IS NOT NULL AND "parsed_minutesAvailable" IS NOT NULL AND NOT isnan("kWhDelivered")""", BASE))
def drop_missing(spark, sf):
    cols = ["kWhDelivered", "parsed_minutesAvailable"]
    return cleaning.drop_missing(adapters.sessions(spark, sf), cols).select("sessionID", *cols)


@B.query("drop_empty_inputs", """
SELECT event_id::VARCHAR AS "sessionID" FROM events
WHERE event_id % 67 <> 0 AND event_id % 61 <> 0 AND event_id % 59 <> 0 AND event_id % 53 <> 0
  AND event_id % 47 <> 0 AND event_id % 43 <> 0 AND event_id % 41 <> 0""")
def drop_empty_inputs(spark, sf):
    texts = adapters.input_texts(adapters.plain_sessions(spark, sf))
    return cleaning.drop_empty_json(texts, "userInputs").select("sessionID")


@B.query("drop_blank_text", with_ctes("""
SELECT "sessionID", "doneChargingTime" FROM base WHERE trim("doneChargingTime") <> ''""", BASE))
def drop_blank_text(spark, sf):
    return cleaning.drop_blank(adapters.sessions(spark, sf), "doneChargingTime").select("sessionID", "doneChargingTime")


@B.query("drop_blank_report", with_ctes("""
SELECT count(*) AS rows_before, count(*) FILTER (trim("doneChargingTime") <> '') AS rows_after,
  count(*) - count(*) FILTER (trim("doneChargingTime") <> '') AS rows_removed FROM base""", BASE))
def drop_blank_report(spark, sf):
    return cleaning.blank_report(adapters.sessions(spark, sf), "doneChargingTime")


CENSUS = ["doneChargingTime", "kWhDelivered", "parsed_minutesAvailable", "day_of_week"]


@B.query("missing_census", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS n_null, "
    f"count(*) FILTER (\"{c}\"::VARCHAR = '') AS n_empty FROM base" for c in CENSUS), BASE))
def missing_census(spark, sf):
    return cleaning.missing_counts(adapters.sessions(spark, sf), CENSUS)


@B.query("select_day", """
SELECT event_id, ts, user_id FROM events WHERE ts::DATE = DATE '2024-01-17'""")
def select_day(spark, sf):
    return cleaning.on_day(table(spark, sf, "events"), "ts", "2024-01-17").select("event_id", "ts", "user_id")


@B.query("active_sessions", with_ctes("""
SELECT "sessionID", round("remaining_kWh", 6) AS "remaining_kWh", minutes_left FROM active""", ACTIVE))
def active_sessions(spark, sf):
    return cleaning.active_sessions(adapters.with_nan(adapters.sessions(spark, sf), "kWhDelivered", "parsed_minutesAvailable")).select(
        "sessionID", _r("remaining_kWh").alias("remaining_kWh"), "minutes_left")


@B.query("fill_defaults", with_ctes("""
SELECT "sessionID", coalesce("kWhDelivered", 0e0) AS "kWhDelivered",
  coalesce("parsed_minutesAvailable", 0e0) AS "parsed_minutesAvailable", 50e0 AS urgency_score,
  1e0 AS flexibility_index, 1e0 AS grid_impact_proxy, 1e0 AS habit_stability, 0e0 AS station_encoded FROM base""", BASE))
def fill_defaults(spark, sf):
    base = adapters.plain_sessions(spark, sf)
    defaults = {"kWhDelivered": 0.0, "parsed_minutesAvailable": 0.0, **cleaning.SERVING_DEFAULTS, "station_encoded": 0.0}
    return cleaning.fill_defaults(base, defaults).select("sessionID", *defaults)


LOOKUP_IDX = 321


@B.query("lookup_row", f"""
SELECT event_id, ts, user_id, value FROM (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i = {LOOKUP_IDX}""")
def lookup_row(spark, sf):
    return ordering.row_at(table(spark, sf, "events"), ["ts", "event_id"], LOOKUP_IDX).select(
        "event_id", "ts", "user_id", "value")


@B.query("slice_rows", """
SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 250 OFFSET 100""")
def slice_rows(spark, sf):
    return ordering.slice_rows(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 100, 350)


@B.query("assign_row_id", with_ctes("""
SELECT "sessionID", row_number() OVER (ORDER BY "connectionTime", event_id) - 1 AS row_id
FROM base WHERE trim("doneChargingTime") <> ''""", BASE))
def assign_row_id(spark, sf):
    kept = cleaning.drop_blank(adapters.sessions(spark, sf), "doneChargingTime")
    return ordering.with_row_id(kept.select("sessionID", "connectionTime", "event_id"),
                                ["connectionTime", "event_id"]).select("sessionID", "row_id")


@B.query("rename_prefix", """
SELECT event_id, user_id AS "userInput_user_id", value AS "userInput_value" FROM events""")
def rename_prefix(spark, sf):
    return cleaning.prefixed(table(spark, sf, "events").select("event_id", "user_id", "value"),
                             ["user_id", "value"], "userInput_")


# --- joins ----------------------------------------------------------------------

def _unit_price():
    return F.col("l_extendedprice") / F.col("l_quantity")


def _encoding_sql(train: str, col: str, y: str) -> str:
    """Smoothed encoding over all rows of ``train``."""
    return f"""
g AS (SELECT avg({y}) AS gmean, var_pop({y}) AS gvar FROM {train}),
enc AS (
  SELECT {col}, lam * cmean + (1 - lam) * gmean AS encoded FROM (
    SELECT {col}, cmean, gmean, coalesce(n * gvar / nullif(n * gvar + cvar, 0), 0) AS lam FROM (
      SELECT {col}, count({y}) AS n, avg({y}) AS cmean, var_pop({y}) AS cvar FROM {train} GROUP BY {col}), g))"""


@B.query("encode_lookup", with_ctes("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round(coalesce(e.encoded, g.gmean), 4) AS part_encoded
FROM lineitem l CROSS JOIN g LEFT JOIN enc e ON e.l_partkey = l.l_partkey""", """
train AS (SELECT l_partkey, l_extendedprice / l_quantity AS y FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')""",
    _encoding_sql("train", "l_partkey", "y")))
def encode_lookup(spark, sf):
    items = table(spark, sf, "lineitem")
    before = items.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    enc, default = encoding.full_encoding(before.withColumn("y", _unit_price()), "l_partkey", "y")
    return joins.apply_encoding(items.select("l_orderkey", "l_linenumber", "l_partkey"), enc, "l_partkey", default,
                                "part_encoded").withColumn("part_encoded", _r("part_encoded", 4))


ORDER_SPLIT = f"""
hashed AS (SELECT *, month(o_orderdate)::INT AS "month", {seeded_hash(42, 'o_orderkey')} AS h FROM orders),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "month" ORDER BY h, o_orderkey) AS rn,
    count(*) OVER (PARTITION BY "month") AS n FROM hashed),
split AS (
  SELECT o_orderkey, o_totalprice, "month", CASE WHEN rn <= 4 * n // 10 THEN 'test'
    WHEN rn <= 4 * n // 10 + n // 10 THEN 'val' ELSE 'train' END AS split FROM ranked)"""


def _orders_by_month(spark, sf):
    return table(spark, sf, "orders").withColumn("month", F.month("o_orderdate"))


def _order_split(spark, sf):
    return ordering.stratified_split(_orders_by_month(spark, sf), "month", "o_orderkey")


@B.query("split_membership", with_ctes("SELECT o_orderkey, o_totalprice, split FROM split", ORDER_SPLIT))
def split_membership(spark, sf):
    taken = _order_split(spark, sf).filter("split <> 'train'").select("o_orderkey", "split")
    return joins.split_of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), taken, "o_orderkey")


@B.query("attach_columns", with_ctes("""
SELECT "sessionID", site, round("parsed_milesRequested", 6) AS "userInput_milesRequested",
  "parsed_minutesAvailable" AS "userInput_minutesAvailable"
FROM base WHERE event_id % 67 <> 0""", BASE))
def attach_columns(spark, sf):
    base = adapters.plain_sessions(spark, sf)
    listed = adapters.user_inputs(base).filter(F.col("userInputs").isNotNull())
    parsed = parse_user_inputs(listed.select("sessionID", F.to_json("userInputs").alias("userInputs"))).select(
        "sessionID", _r("latest.milesRequested").alias("milesRequested"), "latest.minutesAvailable")
    cols = cleaning.prefixed(parsed, ["milesRequested", "minutesAvailable"], "userInput_")
    return joins.attach(base.select("sessionID", "site"), cols, "sessionID")


@B.query("align_predictions", with_ctes("""
SELECT p."sessionID", b."connectionTime" AS "timestamp", round(p."true_kWh", 6) AS "true_kWh",
  round(p.pred_median, 6) AS pred_median
FROM pred p JOIN base b ON b."sessionID" = p."sessionID\"""", PREDICTIONS))
def align_predictions(spark, sf):
    df = adapters.sessions(spark, sf)
    pred = adapters.naive_predictions(df).select("sessionID", _r("true_kWh").alias("true_kWh"),
                                                 _r("pred_median").alias("pred_median"))
    return joins.align_predictions(pred, df).select("sessionID", "timestamp", "true_kWh", "pred_median")


@B.query("align_unmatched", with_ctes("""
SELECT count(*) AS n_unmatched FROM pred p WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b."sessionID" = p."sessionID" AND trim(b."doneChargingTime") <> '')""", PREDICTIONS))
def align_unmatched(spark, sf):
    df = adapters.sessions(spark, sf)
    return joins.unmatched_count(adapters.naive_predictions(df), cleaning.drop_blank(df, "doneChargingTime"))


@B.query("resume_antijoin", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@B.query("session_slots", """
SELECT event_id, t AS time_slot FROM events, (SELECT unnest(range(32))::INT AS t)""")
def session_slots(spark, sf):
    return joins.session_slots(table(spark, sf, "events").select("event_id"))


# --- aggregates -------------------------------------------------------------------

@B.query("value_counts", with_ctes("SELECT grid_impact_proxy, count(*) AS n FROM sessions GROUP BY 1", SESSIONS))
def value_counts(spark, sf):
    return aggregates.value_counts(adapters.sessions(spark, sf), "grid_impact_proxy")


@B.query("value_counts_nulls", with_ctes("SELECT day_of_week, count(*) AS n FROM base GROUP BY 1", BASE))
def value_counts_nulls(spark, sf):
    return aggregates.value_counts(adapters.sessions(spark, sf), "day_of_week")


@B.query("describe_text", with_ctes("""
SELECT sum(n)::BIGINT AS "count", count(*) AS "unique", (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top,
  max(n) AS freq FROM c""", """
c AS (SELECT text AS v, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)"""))
def describe_text(spark, sf):
    return aggregates.describe_text(table(spark, sf, "documents"), "text")


_METRICS = """
  round(avg(abs("true_kWh" - pred_median)), 6) AS mae,
  round(sqrt(avg(("true_kWh" - pred_median) ** 2)), 6) AS rmse,
  round(1 - sum(("true_kWh" - pred_median) ** 2) / (count(*) * var_pop("true_kWh")), 6) AS r2"""


@B.query("regression_metrics", with_ctes(f"""
SELECT 'all' AS site, {_METRICS} FROM pred UNION ALL SELECT site, {_METRICS} FROM pred GROUP BY site""", PREDICTIONS))
def regression_metrics(spark, sf):
    out = aggregates.metrics_with_total(_gappy_predictions(spark, sf), "true_kWh", "pred_median", "site")
    return out.select("site", _r("mae").alias("mae"), _r("rmse").alias("rmse"), _r("r2").alias("r2"))


@B.query("interval_metrics", with_ctes("""
SELECT site, round(avg(("true_kWh" BETWEEN pred_05 AND pred_95)::INT), 6) AS coverage,
  round(avg(pred_95 - pred_05), 6) AS width FROM pred GROUP BY site""", PREDICTIONS))
def interval_metrics(spark, sf):
    pred = adapters.naive_predictions(adapters.sessions(spark, sf))
    return aggregates.interval_metrics(pred, "true_kWh", "pred_05", "pred_95", ["site"]).select(
        "site", _r("coverage").alias("coverage"), _r("width").alias("width"))


_CQR = 'greatest(pred_05 - "true_kWh", "true_kWh" - pred_95)'


@B.query("conformal_quantile", with_ctes(f"""
SELECT 'reference' AS mode, round(quantile_cont(abs("true_kWh" - pred_median), 0.9), 6) AS q_hat FROM pred
UNION ALL
SELECT 'cqr', round(s, 6) FROM (
  SELECT {_CQR} AS s, row_number() OVER (ORDER BY {_CQR}) AS rn, count(*) OVER () AS n FROM pred)
WHERE rn = ((n + 1) * 9 + 9) // 10""", PREDICTIONS))
def conformal_quantile(spark, sf):
    pred = materialize(_gappy_predictions(spark, sf), "predictions")
    ref = aggregates.conformal_radius(pred, aggregates.absolute_score(), 0.90, "reference")
    cqr = aggregates.conformal_radius(pred, aggregates.cqr_score(), 0.90, "cqr")
    return spark.sql("SELECT inline(array(named_struct('mode', 'reference', 'q_hat', round(:ref, 6)),"
                     " named_struct('mode', 'cqr', 'q_hat', round(:cqr, 6))))", args={"ref": ref, "cqr": cqr})


@B.query("target_stats", with_ctes("""
SELECT l_suppkey, n, round(mean, 4) AS mean, round(var, 3) AS var, round(gm, 4) AS global_mean, round(gv, 3) AS global_var
FROM (SELECT l_suppkey, count(*) AS n, avg(y) AS mean, var_pop(y) AS var FROM p GROUP BY 1),
  (SELECT avg(y) AS gm, var_pop(y) AS gv FROM p)""",
    "p AS (SELECT l_suppkey, l_extendedprice / l_quantity AS y FROM lineitem)"))
def target_stats(spark, sf):
    items = table(spark, sf, "lineitem").select("l_suppkey", _unit_price().alias("y"))
    return encoding.target_stats(items, "l_suppkey", "y").select(
        "l_suppkey", "n", _r("mean", 4).alias("mean"), _r("var", 3).alias("var"),
        _r("global_mean", 4).alias("global_mean"), _r("global_var", 3).alias("global_var"))


MOMENTS = ["parsed_kWhRequested", "parsed_milesRequested", "parsed_minutesAvailable", "urgency_score"]


@B.query("feature_moments", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(\"{c}\"), 6) AS mean, round(stddev_pop(\"{c}\"), 6) AS std FROM sessions"
    for c in MOMENTS), SESSIONS))
def feature_moments(spark, sf):
    return aggregates.scaler_stats(adapters.sessions(spark, sf), MOMENTS).select(
        "feature", _r("mean").alias("mean"), _r("std").alias("std"))


@B.query("standardize", with_ctes("SELECT \"sessionID\", " + ", ".join(
    f"round((\"{c}\" - m.\"m_{c}\") / m.\"s_{c}\", 6) AS \"{c}\"" for c in MOMENTS) + " FROM sessions, m", SESSIONS,
    "m AS (SELECT " + ", ".join(f"avg(\"{c}\") AS \"m_{c}\", stddev_pop(\"{c}\") AS \"s_{c}\"" for c in MOMENTS)
    + " FROM sessions)"))
def standardize(spark, sf):
    df = adapters.sessions(spark, sf)
    z = aggregates.standardize(df, aggregates.scaler_stats(df, MOMENTS))
    return z.select("sessionID", *[_r(c).alias(c) for c in MOMENTS])


@B.query("pinball_loss", with_ctes(" UNION ALL ".join(
    f"SELECT {a}e0 AS alpha, round(avg(greatest({a}e0 * (\"true_kWh\" - {q}), ({a}e0 - 1) * (\"true_kWh\" - {q}))), 6)"
    f" AS pinball FROM pred" for a, q in [(0.05, "pred_05"), (0.5, "pred_median"), (0.95, "pred_95")]), PREDICTIONS))
def pinball_loss(spark, sf):
    columns = {0.05: "pred_05", 0.5: "pred_median", 0.95: "pred_95"}
    return aggregates.pinball_levels(_gappy_predictions(spark, sf), "true_kWh", columns).select("alpha", _r("pinball").alias("pinball"))


@B.query("conformal_interval", with_ctes("""
SELECT p."sessionID", round(pred_05 - q, 5) AS lower_conformal, round(pred_95 + q, 5) AS upper_conformal
FROM pred p, (SELECT quantile_cont(abs("true_kWh" - pred_median), 0.9) AS q FROM pred)""", PREDICTIONS))
def conformal_interval(spark, sf):
    pred = materialize(adapters.naive_predictions(adapters.sessions(spark, sf)), "predictions")
    q_hat = aggregates.conformal_radius(pred, aggregates.absolute_score())
    return aggregates.conformalize(pred, q_hat).select(
        "sessionID", _r("lower_conformal", 5).alias("lower_conformal"), _r("upper_conformal", 5).alias("upper_conformal"))


@B.query("ablation_summary", with_ctes("""
SELECT metric, round(a, 6) AS "WITH", round(b, 6) AS "WITHOUT", round(b - a, 6) AS delta FROM (
  SELECT 'mae' AS metric, (SELECT avg(abs(y - p)) FROM w) AS a, (SELECT avg(abs(y - p)) FROM wo) AS b
  UNION ALL SELECT 'rmse', (SELECT sqrt(avg((y - p) ** 2)) FROM w), (SELECT sqrt(avg((y - p) ** 2)) FROM wo)
  UNION ALL SELECT 'r2', (SELECT 1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) FROM w),
    (SELECT 1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) FROM wo))""", PREDICTIONS, """
w AS (SELECT "true_kWh" AS y, pred_median AS p FROM pred)""", """
wo AS (SELECT "true_kWh" AS y, pred_05 AS p FROM pred)"""))
def ablation_summary(spark, sf):
    pred = adapters.naive_predictions(adapters.sessions(spark, sf))
    summary = aggregates.ablation_of_predictions(pred, "true_kWh", "pred_median", "pred_05")
    return summary.select("metric", *[_r(c).alias(c) for c in ("WITH", "WITHOUT", "delta")])


@B.query("split_census", with_ctes("""
SELECT "month", count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test FROM split GROUP BY 1""", ORDER_SPLIT))
def split_census(spark, sf):
    return aggregates.split_counts(_order_split(spark, sf))


# --- order-dependent ------------------------------------------------------------

@B.query("month_stratified_split", with_ctes('SELECT o_orderkey, "month", split FROM split', ORDER_SPLIT))
def month_stratified_split(spark, sf):
    return _order_split(spark, sf).select("o_orderkey", "month", "split")


@B.query("hash_threshold_split", f"""
SELECT o_orderkey, CASE WHEN h < 0.4e0 THEN 'test' WHEN h < 0.5e0 THEN 'val' ELSE 'train' END AS split FROM (
  SELECT o_orderkey, ({seeded_hash(42, 'o_orderkey')})::DOUBLE / 1152921504606846976e0 AS h FROM orders)""")
def hash_threshold_split(spark, sf):
    return ordering.stratified_split(_orders_by_month(spark, sf), "month", "o_orderkey", exact=False).select(
        "o_orderkey", "split")


@B.query("seeded_sample", with_ctes(f"""
SELECT "sessionID", site FROM base ORDER BY {seeded_hash(42, '"sessionID"')}, "sessionID" LIMIT 500""", BASE))
def seeded_sample(spark, sf):
    return ordering.sample_n(adapters.sessions(spark, sf).select("sessionID", "site"), "sessionID", 500)


@B.query("factorize_first_seen", with_ctes("""
SELECT s."sessionID", s.day_of_week, c.code AS day_of_week_code FROM named s JOIN (
  SELECT day_of_week, (row_number() OVER (ORDER BY f, i) - 1)::INT AS code FROM (
    SELECT day_of_week, min("connectionTime") AS f, arg_min(event_id, "connectionTime") AS i FROM named GROUP BY 1)) c
USING (day_of_week)""", BASE, """
named AS (SELECT event_id, "sessionID", "connectionTime", coalesce(day_of_week, 'Monday') AS day_of_week FROM base)"""))
def factorize_first_seen(spark, sf):
    df = adapters.sessions(spark, sf).select("sessionID", "event_id", "connectionTime", "day_of_week")
    return ordering.factorize(df.fillna("Monday", ["day_of_week"]), "day_of_week", ["connectionTime", "event_id"]).select(
        "sessionID", "day_of_week", "day_of_week_code")


@B.query("latest_revision", """
SELECT conv_id, turn, role, text, n AS n_revisions FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn = 1""")
def latest_revision(spark, sf):
    return ordering.latest_by(table(spark, sf, "conversations"), "conv_id", "turn")


_FOLD = seeded_hash(42, "l_orderkey", "l_linenumber")
_OOF = f"""
p AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice / l_quantity AS y,
    l_shipdate < TIMESTAMP '1998-01-01' AS is_train,
    CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN ({_FOLD}) % 5 ELSE -1 END AS fold FROM lineitem),
f AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold),
g AS (SELECT f.fold, avg(y) AS gm, var_pop(y) AS gv FROM f JOIN p ON p.is_train AND p.fold <> f.fold GROUP BY 1),
c AS (SELECT f.fold, l_suppkey, count(*) AS n, avg(y) AS cm, var_pop(y) AS cv
  FROM f JOIN p ON p.is_train AND p.fold <> f.fold GROUP BY 1, 2),
e AS (SELECT fold, l_suppkey, lam * cm + (1 - lam) * gm AS encoded FROM (
  SELECT c.*, gm, coalesce(n * gv / nullif(n * gv + cv, 0), 0) AS lam FROM c JOIN g USING (fold)))"""


@B.query("target_encode_oof", with_ctes("""
SELECT p.l_orderkey, p.l_linenumber, p.l_suppkey, p.is_train, round(coalesce(e.encoded, g.gm), 4) AS supplier_encoded
FROM p JOIN g USING (fold) LEFT JOIN e ON e.fold = p.fold AND e.l_suppkey = p.l_suppkey""", _OOF))
def target_encode_oof(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", _unit_price().alias("y"),
        (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_train"))
    out = encoding.target_encode(items, {"supplier_encoded": "l_suppkey"}, "y", ["l_orderkey", "l_linenumber"],
                                 F.col("is_train"))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "is_train", _r("supplier_encoded", 4).alias("supplier_encoded"))


@B.query("micro_batches", """
SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS batch_id FROM events""")
def micro_batches(spark, sf):
    return ordering.batch_id(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 64).select(
        "event_id", "batch_id")


# --- sorts, limits, set operations --------------------------------------------------

@B.query("sort_by_time", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def sort_by_time(spark, sf):
    return ordering.sort_by_time(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", "event_id")


@B.query("head_rows", with_ctes("""
SELECT "sessionID", "doneChargingTime", round("kWhDelivered", 6) AS "kWhDelivered" FROM base
WHERE trim("doneChargingTime") <> '' ORDER BY event_id LIMIT 3""", BASE))
def head_rows(spark, sf):
    kept = cleaning.drop_blank(adapters.sessions(spark, sf), "doneChargingTime")
    return ordering.head(kept, ["event_id"], 3).select("sessionID", "doneChargingTime", _r("kWhDelivered").alias("kWhDelivered"))


@B.query("top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15")
def top_users(spark, sf):
    return ordering.top_k(table(spark, sf, "events"), "user_id", 15)


_TRIALS = [0.6, 0.7, 0.8, 0.9, 1.0]


@B.query("best_trial", with_ctes("SELECT share, round(mae, 6) AS mae FROM t ORDER BY mae, share LIMIT 1", PREDICTIONS,
    "t AS (" + " UNION ALL ".join(
        f"SELECT {s}e0 AS share, avg(abs(\"true_kWh\" - pred_median * {s}e0)) AS mae FROM pred" for s in _TRIALS) + ")"))
def best_trial(spark, sf):
    pred = adapters.naive_predictions(adapters.sessions(spark, sf))
    losses = [F.struct(F.lit(s).alias("share"),
                       F.avg(F.abs(F.col("true_kWh") - F.col("pred_median") * s)).alias("mae")) for s in _TRIALS]
    trials = pred.agg(F.array(*losses).alias("t")).select(F.inline("t"))
    return aggregates.best_trial(trials, ["share"]).select("share", _r("mae").alias("mae"))


@B.query("union_pages", """
SELECT event_id, user_id, value, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN event_type END AS event_type FROM events""")
def union_pages(spark, sf):
    events, cut = table(spark, sf, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    early = events.filter(F.col("ts") < cut).select("event_id", "user_id", "value")
    late = events.filter(F.col("ts") >= cut).select("event_id", "user_id", "value", "event_type")
    return union_all(early, late)


@B.query("exclude_sampled", with_ctes("SELECT o_orderkey, o_totalprice FROM split WHERE split <> 'test'", ORDER_SPLIT))
def exclude_sampled(spark, sf):
    test = _order_split(spark, sf).filter("split = 'test'")
    return joins.exclude_keys(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), test, "o_orderkey")
