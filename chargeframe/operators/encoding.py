"""Target statistics and out-of-fold target encoding.

Counts, means and squared deviations are first aggregated per (value, fold),
so a hot value never meets in one task; what follows works on at most
``folds`` entries per value. Folds are merged from their moments, which keeps
precision where sums of squares would cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.functions.hashing import hash_fold
from chargeframe.runtime import durable, materialize, small_side


def target_stats(df: DataFrame, col: str, y: str) -> DataFrame:
    """Per value n, mean and population variance, with the global mean and variance.

    The rows are read once; the global moments are merged from those of the values."""
    per = durable(df.groupBy(col).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")))
    mean = per.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).cast("double")).first()[0]
    off = F.col("mean") - F.lit(mean).cast("double")
    var = per.agg(F.try_divide(F.sum(F.col("n") * (F.col("var") + off * off)), F.sum("n")).cast("double")).first()[0]
    return per.withColumns({"global_mean": F.lit(mean).cast("double"), "global_var": F.lit(var).cast("double")})


def _merged(parts: Column, keep) -> Column:
    """n, mean and variance of the fold entries that ``keep`` selects."""
    def moments(kept: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
        total = F.aggregate(kept, zero, lambda a, p: F.struct(
            (a["n"] + p["n"]).alias("n"), (a["s"] + p["n"] * p["mean"]).alias("s")))
        mean = F.try_divide(total["s"], total["n"])
        m2 = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["n"] * (p["var"] + (p["mean"] - mean) * (p["mean"] - mean)))
        return F.struct(total["n"].alias("n"), mean.alias("mean"), F.try_divide(m2, total["n"]).alias("var"))

    return moments(F.filter(parts, keep))


def _fold_moments(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    per = df.groupBy(*keys, "_fold").agg(F.count(y).alias("_n"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_var"))
    entry = F.struct("_fold", F.col("_n").alias("n"), F.col("_mean").alias("mean"), F.col("_var").alias("var"))
    return per.filter(F.col("_n") > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_parts"))


def fold_encodings(train: DataFrame, col: str, y: str, folds: int, fold: Column) -> tuple[DataFrame, list]:
    """Smoothed encodings that leave out one fold each, and the defaults.

    ``_fold`` −1 stands for the encoding over all train rows. With n rows of
    a value, variance v inside it and V overall, the weight of its own mean is
    λ = n·V / (n·V + v). The defaults are the overall means for −1, 0, 1, …;
    only these folds + 1 pairs of moments come to the driver.
    """
    folded = train.select(col, y, fold.alias("_fold"))
    left_out = F.explode(F.sequence(F.lit(-1), F.lit(folds - 1)))

    def without_fold(frame: DataFrame, keys: list[str]) -> DataFrame:
        merged = frame.select(*keys, "_parts", left_out.alias("_fold"))
        own = F.col("_fold")
        return merged.select(*keys, "_fold", _merged(F.col("_parts"), lambda p: p["_fold"] != own).alias("_m"))

    total = without_fold(_fold_moments(folded, [], y), []).select("_fold", "_m.mean", "_m.var").orderBy("_fold").collect()
    means, variances = [r["mean"] for r in total], [r["var"] for r in total]
    overall_mean, overall_var = pick(means, F.col("_fold")), pick(variances, F.col("_fold"))
    own = F.col("_m.n") * overall_var
    lam = F.coalesce(F.try_divide(own, own + F.col("_m.var")), F.lit(0.0))
    encoded = lam * F.col("_m.mean") + (F.lit(1.0) - lam) * overall_mean
    per = without_fold(_fold_moments(folded, [col], y), [col]).filter(F.col("_m.n") > 0)
    return per.select(col, "_fold", encoded.alias("encoded")), means


def pick(values: list, fold: Column) -> Column:
    """The entry of a short list that belongs to a fold, where −1 comes first."""
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), fold + F.lit(1))


def target_encode(df: DataFrame, cols: dict[str, str], y: str, key: list[str], is_train: Column,
                  folds: int = 5, seed=42) -> DataFrame:
    """Encode columns, given as {output: column}.

    Train rows get an encoding without their own fold, other rows the one over
    all train rows. The folds, labels and encoded columns of the train rows are
    written once, and every encoding is computed in passes over its own column
    of these, before anything is joined. A missing value is a value of its own.
    """
    fold = hash_fold(seed, folds, *key)
    out = df.withColumn("_fold", F.when(is_train, fold).otherwise(F.lit(-1)))
    train = materialize(df.filter(is_train).select(*dict.fromkeys([*cols.values(), y]), fold.alias("_fold")), "folds")
    for name, col in cols.items():
        encodings, means = fold_encodings(train, col, y, folds, F.col("_fold"))
        side = small_side(encodings.select(F.col(col).alias("_value"), F.col("_fold").alias("_f"), "encoded"))
        same = F.col(col).eqNullSafe(F.col("_value")) & (F.col("_fold") == F.col("_f"))
        out = (out.join(side, same, "left").withColumn(name, F.coalesce("encoded", pick(means, F.col("_fold"))))
               .drop("_value", "_f", "encoded"))
    return out.select(*df.columns, *cols)


def full_encoding(train: DataFrame, col: str, y: str) -> tuple[DataFrame, float]:
    """The encoding over all train rows as (``col``, ``encoded``), and its default."""
    encodings, means = fold_encodings(train, col, y, 1, F.lit(0))
    return encodings.filter("_fold = -1").select(col, "encoded"), means[0]
