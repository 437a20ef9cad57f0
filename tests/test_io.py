from __future__ import annotations

import json

from pyspark.sql import functions as F

from chargeframe import adapters
from chargeframe.sources import readers, writers
from tests.conftest import SF


def test_corrupt_csv_records_are_kept(spark, tmp_path):
    header = ",".join(f.name for f in readers.SESSION.fields)
    good = "s1,st,1,2024-01-01T00:00:00.000000,2024-01-01T01:00:00.000000,,Monday,1.5,2.5,60.0,10.0,250.0,1,50,0.5,0.8,low"
    bad = good.replace("s1", "s2").replace("1.5", "oops")
    (tmp_path / "s.csv").write_text("\n".join([header, good, bad]) + "\n")
    rows = {r["sessionID"]: r for r in readers.read_sessions(spark, str(tmp_path), keep_corrupt=True).collect()}
    assert rows["s1"][readers.CORRUPT] is None and rows["s1"]["kWhDelivered"] == 1.5
    assert rows["s2"][readers.CORRUPT] == bad and rows["s2"]["kWhDelivered"] is None


def test_pages_one_per_file(spark, tmp_path):
    page = {"_items": [{"_id": "1", "sessionID": "a", "userInputs": [{"userID": 4}, {"userID": 5}]},
                       {"_id": "2", "sessionID": "b", "userInputs": None}], "_links": {"next": {"href": "p2"}}}
    last = {"_items": [{"_id": "3", "sessionID": "c"}]}
    (tmp_path / "1.json").write_text(json.dumps(page, indent=2))
    (tmp_path / "2.json").write_text(json.dumps(last, indent=2))
    items = readers.read_session_pages(spark, str(tmp_path))
    assert sorted(r["sessionID"] for r in items.collect()) == ["a", "b", "c"]
    got = sorted((r["sessionID"], r["revision"], r["userID"]) for r in readers.explode_user_inputs(items).collect())
    assert got == [("a", 0, 4), ("a", 1, 5)]


def test_flatten_names_and_missing_objects(spark):
    df = spark.createDataFrame([(1, (2, (3,))), (4, None)], "a int, b struct<c:int,d:struct<e:int>>")
    flat = readers.flatten_struct(df)
    assert flat.columns == ["a", "b.c", "b.d.e"]
    assert sorted(map(tuple, flat.collect()), key=lambda r: r[0]) == [(1, 2, 3), (4, None, None)]


def test_partitioned_write_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("month", F.month("o_orderdate"))
    writers.write_parquet(orders, path, ["month"])
    back = spark.read.parquet(path).filter("month = 3")
    assert back.count() == orders.filter("month = 3").count()
    assert len(back.inputFiles()) == 12
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()


def test_filters_reach_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    from chargeframe.operators.cleaning import on_day
    plan = on_day(events, "ts", "2024-01-17").select("event_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_day_bounds_do_not_depend_on_the_session_zone(spark):
    from chargeframe.operators.cleaning import on_day

    rows = [(i, f"2024-01-16T{22 + i}:30:00" if i < 2 else f"2024-01-17T0{i}:30:00") for i in range(4)]
    df = spark.createDataFrame(rows, "i int, s string").select("i", F.col("s").cast("timestamp_ntz").alias("ntz"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = df.withColumn("ltz", F.col("ntz").cast("timestamp"))
        stored = df.collect()
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert sorted(r["i"] for r in on_day(df, "ntz", "2024-01-17").collect()) == [2, 3]
        instants = spark.sql("SELECT timestamp_seconds(col1) AS t FROM VALUES (1705447800), (1705455000), (1705534200), (1705537800)")
        assert on_day(instants, "t", "2024-01-17").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(stored) == 4


def test_json_records_name_missing_ids(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "sessionID string, o int")
    got = [json.loads(r["record"])["sessionID"] for r in writers.to_json_records(df, ["o"], ["sessionID", "o"]).collect()]
    assert sorted(got) == ["a", "c", "session_1"]


def test_adapter_matches_the_schema(spark):
    df = adapters.main_columns(adapters.sessions(spark, SF))
    assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in readers.SESSION.fields]
