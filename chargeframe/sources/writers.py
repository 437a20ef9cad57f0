"""Writers for tables, run logs and JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.operators.ordering import global_row_number
from chargeframe.schemas import RUN_LOG
from chargeframe.sources.readers import NTZ_PATTERN, TEXT_OPTIONS

# Columns of the exported session records.
RECORD_COLUMNS = [
    "sessionID", "parsed_kWhRequested", "parsed_minutesAvailable", "connectionTime", "disconnectTime",
    "charging_efficiency", "requested_gap", "urgency_score",
    "pred_median", "lower_conformal", "upper_conformal",
]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**TEXT_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "errorifexists") -> None:
    """Parquet, optionally partitioned.

    The rebalance hint brings the rows of a partition value together in files
    of the advisory size and splits a value that holds many rows.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def log_run(metrics: DataFrame, path: str) -> None:
    """Append metric rows, stamped with the current time, to a run log."""
    stamped = metrics.withColumn("timestamp", F.current_timestamp())
    stamped.select([F.col(f.name).cast(f.dataType) for f in RUN_LOG.fields]).write.mode("append").parquet(path)


def _text_value(name: str, kind: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else F.col(name)


def to_json_records(df: DataFrame, order: list[str], columns: list[str] = RECORD_COLUMNS,
                    key: str = "sessionID") -> DataFrame:
    """One JSON object per row; a missing id becomes ``session_<position>``."""
    named = df.select(*dict.fromkeys([*columns, *order]))
    if not df.filter(F.col(key).isNull()).isEmpty():  # positions are needed only then
        position = F.concat(F.lit("session_"), F.col("_i").cast("string"))
        named = global_row_number(named, order, "_i").withColumn(key, F.coalesce(F.col(key), position))
    kinds = dict(named.dtypes)
    return named.select(F.to_json(F.struct(*[_text_value(c, kinds[c]).alias(c) for c in columns])).alias("record"))


def write_json_records(df: DataFrame, path: str, order: list[str], columns: list[str] = RECORD_COLUMNS,
                       key: str = "sessionID", mode: str = "errorifexists") -> None:
    to_json_records(df, order, columns, key).write.mode(mode).text(path)


__all__ = ["NTZ_PATTERN", "RECORD_COLUMNS", "log_run", "to_json_records", "write_csv",
           "write_json_records", "write_parquet"]
