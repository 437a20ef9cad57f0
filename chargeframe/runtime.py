"""Session settings, shared storage and size-checked joins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side that is broadcast, in bytes of its column values.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "chargeframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else one below the warehouse.

    Both are places that all executors reach; a folder of the driver machine
    is never taken.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows to the shared folder as Parquet and read them back.

    For tables that several later passes read a few columns of: unlike a
    checkpoint, Parquet lets each pass read only its columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks that a fit runs over its rows in, unless ``spark.chargeframe.fit.partitions`` says
#: otherwise. It is a setting, not derived from cores or rows: bagging draws per partition, so
#: the same setting gives the same model everywhere.
FIT_PARTITIONS = 8


def durable_spread(df: DataFrame, *by: str) -> DataFrame:
    """``durable`` for rows that a fit runs over again and again, dealt by a hash of ``by``."""
    parts = int(df.sparkSession.conf.get("spark.chargeframe.fit.partitions", str(FIT_PARTITIONS)))
    return durable(df.repartition(parts, *by).sortWithinPartitions(*by))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a hash of ``by`` to a task per core at least.

    For files whose rows lie in few row groups, which would be read, and kept after each
    narrow step, by as few tasks.
    """
    scanned = 0 if df.isStreaming else df.rdd.getNumPartitions()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, scanned), *by)


def _value_bytes(df: DataFrame):
    """Bytes of all values: 8 per number, the length of texts and binaries, JSON length of nested ones."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            own = F.octet_length(column)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            own = 8 * F.greatest(F.size(column), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            own = F.octet_length(F.to_json(F.struct(column)))
        else:
            own = F.lit(8)
        size = size + F.coalesce(own.cast("long"), F.lit(0).cast("long"))
    return F.coalesce(F.sum(size), F.lit(0).cast("long"))


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only when its measured size allows it.

    The rows are written once to the shared folder, so that measuring them
    does not compute them twice. A larger table stays as it is and joins by
    shuffle, where adaptive execution splits skewed partitions.
    """
    kept = durable(df)
    measured = kept.agg(_value_bytes(kept).alias("b")).first()["b"]
    return F.broadcast(kept) if measured <= max_bytes else kept


def attach_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join whose right side is broadcast after a check of its size."""
    return big.join(small_side(small, max_bytes), on, how)


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
