"""Row numbers, selection by rank, splits, samples and top-k.

Nothing here orders a whole table, or one large group of it, in a single
task. Global positions come from a range-partitioned sort plus the running
total of the partition sizes; exact samples come from a histogram of hash
prefixes, so that only the rows near a cut are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chargeframe.functions.hashing import HASH_BITS, seeded_hash
from chargeframe.runtime import attach_small, durable, small_side

#: Hash prefixes counted per stratum when an exact cut is looked for.
PREFIX_BITS = 16
#: Up to this many rows a single top-k task is fine.
TOP_K_ROWS = 10_000


def _sorted_parts(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows sorted across partitions, written once, with their partition number."""
    return durable(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()))


def _part_offsets(parts: DataFrame, weight: Column) -> DataFrame:
    """Running total before each partition; as many rows as partitions."""
    totals = parts.groupBy("_pid").agg(weight.alias("_w"))
    return totals.select("_pid", "_w", (F.sum("_w").over(W.orderBy("_pid")) - F.col("_w")).alias("_before"))


def global_row_number(df: DataFrame, order: list[str | Column], name: str = "row_id", start: int = 0) -> DataFrame:
    """Consecutive numbers in the given order, which must be unique."""
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = durable(df.orderBy(*order).withColumns({"_pid": F.spark_partition_id(), "_pos": in_part}))
    offsets = _part_offsets(parts, F.count("*")).select("_pid", "_before")
    return (parts.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_before") + F.col("_pos") + F.lit(start))
            .drop("_pid", "_pos", "_before"))


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense 0-based id."""
    return global_row_number(df, order, name)


def batch_id(df: DataFrame, order: list[str], size: int, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows."""
    return (global_row_number(df, order, "_n")
            .withColumn(name, F.floor(F.col("_n") / F.lit(size)).cast("long")).drop("_n"))


def slice_rows(df: DataFrame, order: list[str], start: int, end: int, top_k_rows: int | None = None) -> DataFrame:
    """Rows at positions [start, end) of the order, which must be unique.

    Beyond ``top_k_rows`` only the order columns are sorted and numbered; the slice's keys
    then pick the rows."""
    if end <= (TOP_K_ROWS if top_k_rows is None else top_k_rows):
        return df.orderBy(*order).offset(start).limit(max(end - start, 0))
    numbered = global_row_number(df.select(*order), order, "_n")
    keys = [f"_k{i}" for i in range(len(order))]
    wanted = small_side(numbered.filter((F.col("_n") >= start) & (F.col("_n") < end)).select(*order).toDF(*keys))
    same = [df[c].eqNullSafe(wanted[k]) for c, k in zip(order, keys)]
    return df.join(wanted, same, "left_semi")


def row_at(df: DataFrame, order: list[str], idx: int) -> DataFrame:
    """The row at position ``idx``; IndexError outside the table."""
    found = durable(slice_rows(df, order, idx, idx + 1)) if idx >= 0 else None
    if found is None or found.isEmpty():
        raise IndexError(f"no row {idx}")
    return found


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_by_time(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.orderBy(ts, key)


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(k))


def latest_by(df: DataFrame, key: str, order: str, count: str = "n_revisions") -> DataFrame:
    """The row with the highest ``order`` per key, and the number of rows."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"), F.count("*").alias(count))
            .select(key, "_r.*", count))


def factorize(df: DataFrame, col: str, order: list[str], name: str | None = None) -> DataFrame:
    """Code each value by the rank of its first appearance."""
    name = name or f"{col}_code"
    first = df.groupBy(col).agg(F.min(F.struct(*order)).alias("_first"))
    codes = global_row_number(first, ["_first"], name).select(col, F.col(name).cast("int").alias(name))
    kept = small_side(codes.withColumnRenamed(col, "_value"))
    return df.join(kept, F.col(col).eqNullSafe(F.col("_value")), "left").drop("_value")


def _hash_cuts(df: DataFrame, strata: list[str], key: list[str], seed, quotas: dict[str, Column]) -> DataFrame:
    """Per stratum and quota the (hash, key) of the last row inside it.

    Quotas are cumulative row counts as expressions over ``_n``, the rows of
    the stratum. First the rows per hash prefix are counted; then only rows
    that share a prefix with a cut are ranked. Both passes read just the
    strata and key columns.
    """
    hashed = df.select(*strata, *key, seeded_hash(seed, *key).alias("_h"))
    hashed = hashed.withColumn("_b", F.shiftright("_h", HASH_BITS - PREFIX_BITS))
    per_prefix = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    running = per_prefix.select(*strata, "_b", "_c", F.sum("_c").over(w.orderBy("_b")).alias("_upto"),
                                F.sum("_c").over(w).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(q).alias("quota"), e.cast("long").alias("upto")) for q, e in quotas.items()])
    marks = (running.withColumn("_q", F.explode(wanted))
             .filter((F.col("_q.upto") > F.col("_upto") - F.col("_c")) & (F.col("_q.upto") <= F.col("_upto")))
             .select(*strata, "_b", F.col("_q.quota").alias("_quota"),
                     (F.col("_q.upto") - F.col("_upto") + F.col("_c")).alias("_need")))
    edge = hashed.join(small_side(marks), [*strata, "_b"])
    ranked = edge.withColumn("_rn", F.row_number().over(
        W.partitionBy(*strata, "_quota").orderBy("_h", *key)))
    last = ranked.filter(F.col("_rn") == F.col("_need"))
    return last.groupBy(*strata).agg(*[
        F.max(F.when(F.col("_quota") == q, F.struct("_h", *key))).alias(f"_cut_{q}") for q in quotas])


def stratified_split(df: DataFrame, strata: str, key: str, test: tuple[int, int] = (4, 10),
                     val: tuple[int, int] = (1, 10), seed=42, name: str = "split",
                     exact: bool = True) -> DataFrame:
    """Label rows test, val or train within each stratum.

    ``exact``: ⌊n·test⌋ test and ⌊n·val⌋ validation rows per stratum, in the
    order of a seeded hash of the key, with the shares as integer fractions.
    Otherwise each row is labelled by its own hash alone: no extra pass, and
    the sizes hold on average. Rows without a stratum are train rows.
    """
    if not exact:
        share = seeded_hash(seed, key).cast("double") / F.lit(float(1 << HASH_BITS))
        t, v = test[0] / test[1], test[0] / test[1] + val[0] / val[1]
        label = F.when(F.col(strata).isNull(), "train").when(share < t, "test").when(share < v, "val")
        return df.withColumn(name, label.otherwise("train"))
    n = F.col("_n")
    n_test = F.floor(n * F.lit(test[0]) / F.lit(test[1]))
    n_val = F.floor(n * F.lit(val[0]) / F.lit(val[1]))
    cuts = _hash_cuts(df.filter(F.col(strata).isNotNull()), [strata], [key], seed,
                      {"test": n_test, "val": n_test + n_val})
    at = F.struct(seeded_hash(seed, key).alias("_h"), F.col(key))
    label = (F.when(F.coalesce(at <= F.col("_cut_test"), F.lit(False)), "test")
             .when(F.coalesce(at <= F.col("_cut_val"), F.lit(False)), "val").otherwise("train"))
    return attach_small(df, cuts, [strata]).withColumn(name, label).select(*df.columns, name)


def sample_n(df: DataFrame, key: str, n: int, seed=42, top_k_rows: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows, those with the smallest seeded hash; rows that share a key are equally good."""
    if n <= (TOP_K_ROWS if top_k_rows is None else top_k_rows):
        return df.orderBy(seeded_hash(seed, key), key).limit(n)
    cut = _hash_cuts(df, [], [key], seed, {"take": F.least(F.lit(n), F.col("_n"))}).first()["_cut_take"]
    if cut is None:
        return df.limit(0)
    last = F.struct(F.lit(cut["_h"]).alias("_h"), F.lit(cut[key]).alias(key))
    place = F.struct(seeded_hash(seed, key).alias("_h"), F.col(key))
    before = df.filter(place < last)
    return before.union(df.filter(place == last).limit(max(n - before.count(), 0)))


def sorted_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their counts, sorted across partitions and kept."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    return _sorted_parts(counted, ["_v"])


def order_statistics(counts: DataFrame, ranks: list[int]) -> DataFrame:
    """The values at the given 0-based ranks of ``sorted_counts``, exactly.

    Equal values were counted before the sort, and only the sorted partitions
    that hold a wanted rank are looked into.
    """
    offsets = _part_offsets(counts, F.sum("_c"))
    hit = offsets.withColumn("rank", F.explode(F.array(*[F.lit(r).cast("long") for r in sorted(set(ranks))])))
    hit = hit.filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_w")))
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy("rank").orderBy("_v"))
    return (counts.join(F.broadcast(hit), "_pid").withColumn("_upto", upto)
            .filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
            .select("rank", F.col("_v").alias("value")))
