"""Sessions derived from the ``events`` table.

The values are synthetic but every one is computed from the event, so the
sessions grow with the table. They exercise computation, not forecasting
skill. Each rule has an SQL twin in ``registry.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeframe.functions.energy import behavior_rules
from chargeframe.functions.hashing import hash_fraction
from chargeframe.schemas import SESSION

STATIONS, SITES = 53, 5
#: kW a session draws on average, for delivered energy and naive forecasts.
MEAN_KW = 6.6

RFC1123 = "EEE, d MMM yyyy HH:mm:ss 'GMT'"
ISO = "yyyy-MM-dd HH:mm:ss"


def _every(n: int):
    return F.col("event_id") % n == 0


def base_sessions(events: DataFrame) -> DataFrame:
    """Sessions before augmentation."""
    k = F.get_json_object("props", "$.k").cast("int")
    minutes = F.when(_every(89), None).when(_every(83), 0.0).otherwise((F.lit(15) + F.lit(6) * k).cast("double"))
    miles = F.lit(10.0) + F.col("value") % F.lit(120.0)
    wh = (F.lit(200) + F.lit(20) * (F.col("user_id") % 10)).cast("double")
    df = events.select(
        "event_id", F.col("event_id").cast("string").alias("sessionID"),
        (F.col("event_id") % STATIONS).cast("string").alias("stationID"),
        F.concat(F.lit("S"), (F.col("event_id") % STATIONS % SITES).cast("string")).alias("site"),
        F.to_date("ts").alias("date"),
        F.col("user_id").alias("parsed_userID"), F.col("ts").alias("connectionTime"),
        minutes.alias("parsed_minutesAvailable"), miles.alias("parsed_milesRequested"), wh.alias("parsed_WhPerMile"),
        (F.lit(1) + F.col("event_id") % 5).cast("int").alias("revisionCount"),
        F.when(~_every(71), F.date_format("ts", "EEEE")).alias("day_of_week"))
    stay = F.coalesce("parsed_minutesAvailable", F.lit(60.0)) + F.col("event_id") % 61
    done = F.timestamp_add("MINUTE", F.floor(stay / 2).cast("int"), F.col("connectionTime"))
    df = df.withColumns({
        "parsed_kWhRequested": F.col("parsed_milesRequested") * F.col("parsed_WhPerMile") / F.lit(1000.0),
        "disconnectTime": F.timestamp_add("MINUTE", stay.cast("int"), F.col("connectionTime")),
        "doneChargingTime": (F.when(_every(97), None).when(_every(101), "").when(_every(103), "   ")
                             .otherwise(F.date_format(done, ISO))),
        "_hours": stay / F.lit(60.0),
    })
    taken = F.least(F.col("parsed_kWhRequested"), F.lit(MEAN_KW) * F.col("_hours"))
    return df.withColumn("kWhDelivered", F.when(~_every(79), taken * (
        F.lit(0.6) + F.lit(0.4) * hash_fraction("kwh", "event_id")))).drop("_hours")


def augmented(base: DataFrame) -> DataFrame:
    """Sessions with rule-based behaviour columns."""
    df = base.withColumns(behavior_rules())
    return df.withColumn("grid_impact_proxy", F.when(_every(73), "unknown").otherwise(F.col("grid_impact_proxy")))


def plain_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events table before augmentation."""
    return base_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmented(plain_sessions(spark, sf_dir))


def main_columns(df: DataFrame) -> DataFrame:
    """Only the columns of the session schema, in its order."""
    return df.select(*[f.name for f in SESSION.fields])


def user_inputs(base: DataFrame) -> DataFrame:
    """``userInputs`` as an array of revisions whose last one is the current input."""
    def revision(i):
        back = F.col("revisionCount") - i
        miles = F.col("parsed_milesRequested") + back
        return F.struct(
            F.col("parsed_userID").alias("userID"), miles.alias("milesRequested"),
            F.col("parsed_WhPerMile").alias("WhPerMile"), F.col("parsed_minutesAvailable").alias("minutesAvailable"),
            (miles * F.col("parsed_WhPerMile") / F.lit(1000.0)).alias("kWhRequested"),
            F.date_format(F.timestamp_add("MINUTE", i, F.col("connectionTime")), RFC1123).alias("modifiedAt"),
            F.date_format("disconnectTime", RFC1123).alias("requestedDeparture"))

    inputs = F.transform(F.sequence(F.lit(1), F.col("revisionCount")), revision)
    return base.withColumn("userInputs", F.when(~_every(67), inputs))


def input_texts(base: DataFrame) -> DataFrame:
    """``userInputs`` as JSON text, with the forms that occur in practice."""
    df = user_inputs(base)
    text = F.to_json("userInputs")
    one = F.to_json(F.element_at("userInputs", -1))
    forms = (F.when(_every(67), None).when(_every(61), "None").when(_every(59), "nan").when(_every(53), "{}")
             .when(_every(47), "[]").when(_every(43), "  ").when(_every(41), "")
             .when(_every(37), F.concat(F.lit('[{"userID": 1,'), F.lit("")))
             .when(_every(31), one)
             .when(_every(29), F.concat(F.lit("["), one, F.lit(", 5]"))).otherwise(text))
    return df.withColumn("userInputs", forms)


def raw_items(base: DataFrame) -> DataFrame:
    """Sessions as the service delivers them, one struct per session."""
    df = user_inputs(base)
    return df.select("event_id", F.struct(
        F.concat(F.lit("id"), "sessionID").alias("_id"), "sessionID", "stationID",
        F.col("parsed_userID").cast("string").alias("userID"),
        F.date_format("connectionTime", RFC1123).alias("connectionTime"),
        F.date_format("disconnectTime", RFC1123).alias("disconnectTime"),
        "doneChargingTime", "kWhDelivered", "userInputs").alias("item"))


def session_pages(base: DataFrame, page_size: int = 25) -> DataFrame:
    """Pages of ``page_size`` sessions with a link to the next page."""
    items = raw_items(base).withColumn("page", F.floor(F.col("event_id") / page_size))
    link = F.struct(F.struct(F.concat(F.lit("sessions?page="), (F.col("page") + 1).cast("string")).alias("href")).alias("next"))
    return items.groupBy("page").agg(F.collect_list("item").alias("_items")).select("_items", link.alias("_links"))


def replies(augmented_sessions: DataFrame) -> DataFrame:
    """Text replies of an augmentation service, in seven forms."""
    urgency = F.col("event_id") % 101
    flex, habit = F.col("event_id") % 97, F.col("event_id") % 13
    impact = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("event_id") % 3 + 1).cast("int"))

    def obj(u="urgency_score", f="flexibility_index", h="habit_stability", with_impact=True):
        tail = F.concat(F.lit(', "grid_impact_proxy": "'), impact, F.lit('"}')) if with_impact else F.lit("}")
        return F.concat(F.lit(f'{{"{u}": '), urgency.cast("string"), F.lit(f', "{f}": 0.'), flex.cast("string"),
                        F.lit(f', "{h}": 0.'), habit.cast("string"), tail)

    listed = F.concat(F.lit("["), obj(), F.lit("]"))
    form = F.col("event_id") % 7
    content = (F.when(form == 0, F.concat(F.lit('{"augmented_rows": '), listed, F.lit("}")))
               .when(form == 1, F.concat(F.lit('<think>maybe [{"a": 1}]</think> Here:\n```json\n'), listed, F.lit("\n``` done")))
               .when(form == 2, F.concat(F.lit("Sure\n```\n"), listed, F.lit("\n```")))
               .when(form == 3, listed)
               .when(form == 4, F.lit("I cannot answer that."))
               .when(form == 5, F.concat(F.lit("["), obj(with_impact=False), F.lit("]")))
               .otherwise(F.concat(F.lit("["), obj("urgency", "flexibility", "habit"), F.lit("]"))))
    return augmented_sessions.select("sessionID", content.alias("content"))


def retried(answers: DataFrame) -> DataFrame:
    """Replies with the attempt they came from: some sessions got an unusable first one."""
    number = F.col("sessionID").cast("long")
    first = answers.filter(number % 11 == 0).select("sessionID", F.lit("Please try again later.").alias("content"), F.lit(1).alias("attempt"))
    return answers.withColumn("attempt", F.lit(2)).unionByName(first)


def with_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN in place of half of the nulls of the given columns, as other sources write missing numbers."""
    odd = F.pmod(F.xxhash64("sessionID"), F.lit(2)) == 0
    return df.withColumns({c: F.when(F.col(c).isNull() & odd, float("nan")).otherwise(F.col(c)) for c in cols})


def naive_predictions(df: DataFrame) -> DataFrame:
    """Predictions by a fixed formula, for the evaluation operators."""
    taken = F.least(F.col("parsed_kWhRequested"),
                    F.lit(MEAN_KW) * F.coalesce("parsed_minutesAvailable", F.lit(60.0)) / F.lit(60.0))
    return df.filter(F.col("kWhDelivered").isNotNull()).select(
        "sessionID", "site", F.col("kWhDelivered").alias("true_kWh"),
        (taken * F.lit(0.8)).alias("pred_median"), (taken * F.lit(0.65)).alias("pred_05"),
        (taken * F.lit(0.95)).alias("pred_95"))
