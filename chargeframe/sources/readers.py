"""Session tables and landed JSON pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeframe.functions.timestamps import utc_literal
from chargeframe.schemas import SESSION, SESSION_PAGE

CORRUPT = "_corrupt"
#: Keeps microseconds, which the default pattern for writing drops.
NTZ_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TEXT_OPTIONS = {
    "header": "true",
    "timestampNTZFormat": NTZ_PATTERN,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "escape": '"',
}


def read_sessions(spark: SparkSession, path: str, fmt: str = "csv",
                  schema: T.StructType = SESSION, keep_corrupt: bool = False) -> DataFrame:
    """Sessions from CSV or Parquet under a declared schema.

    Blank CSV fields read as null. Malformed CSV records become nulls; with
    ``keep_corrupt`` their text is kept in ``_corrupt``.
    """
    if fmt == "csv":
        reader = spark.read.options(**TEXT_OPTIONS).option("mode", "PERMISSIVE")
        if keep_corrupt:
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        return reader.schema(schema).csv(path)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def read_session_pages(spark: SparkSession, path: str, multiline: bool = True,
                       schema: T.StructType = SESSION_PAGE) -> DataFrame:
    """Items of all landed pages, one row each.

    ``multiline``: one page per file; otherwise one page per line, which
    Spark can split.
    """
    pages = spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)
    return pages.select(F.explode("_items").alias("i")).select("i.*")


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """One column per leaf of every struct; arrays stay as they are."""
    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = path + (field.name,)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select([
        F.col(".".join(f"`{part}`" for part in path)).alias(sep.join(path))
        for path in leaves(df.schema, ())
    ])


def explode_user_inputs(df: DataFrame, inputs: str = "userInputs", key: str = "sessionID") -> DataFrame:
    """One row per session and revision; sessions without inputs drop out."""
    return df.select(key, F.posexplode(inputs).alias("revision", "input")).select(key, "revision", "input.*")


def between_times(df: DataFrame, ts: str, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    """Rows with ``lo <= ts <= hi``; the bounds reach the Parquet scan."""
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(utc_literal(lo, kind), utc_literal(hi, kind)))
