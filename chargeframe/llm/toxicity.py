"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and the beginnings of longer words, hashed to buckets. The buckets that
tell the classes apart, and the most frequent ones, whose effect may lie in combinations only, are
the features; the machine learns a weight for each and, through its factors, one for each
pair. Everything runs in Spark's own functions and MLlib.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.sampling import hash_sample
from chargeframe.runtime import durable

#: Buckets that terms are hashed to, and characters of a word's beginning.
BUCKETS, PREFIX = 1 << 20, 5
#: Labelled rows (about) the model is fitted on, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: Features: buckets with the largest difference between the classes, which must be this many
#: standard errors, and the most frequent of the others, in at most this share of the texts.
TELLING, ERRORS, FREQUENT, SHARE = 384, 4.0, 32, 0.5
#: Texts that a bucket must be in.
LEAST = 3
FACTORS, ROUNDS, STEP, PENALTY, SEED = 4, 120, 0.1, 1e-4, 11


def terms(text: Column) -> Column:
    """Distinct buckets of a text's words and of the beginnings of its longer words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    begins = F.transform(F.filter(words, lambda w: F.length(w) >= PREFIX),
                         lambda w: F.concat(F.substring(w, 1, PREFIX), F.lit("*")))
    return F.array_distinct(F.transform(F.concat(words, F.array_distinct(begins)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))))


def held_out(key: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, divisible by 5; null ids are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Scorer:
    """A fitted machine; with a constant in place of it where there is nothing to learn."""

    def __init__(self, vocabulary: list[str], model, constant: float) -> None:
        self.vocabulary, self.model, self.constant = vocabulary, model, constant

    def _features(self, rows: DataFrame) -> DataFrame:
        wanted = F.array(*(F.lit(int(v)).cast("long") for v in self.vocabulary))
        chosen = rows.withColumn("__terms", F.array_intersect("__terms", wanted).cast("array<string>"))
        counts = CountVectorizerModel.from_vocabulary(self.vocabulary, "__terms", "__features").setBinary(True)
        return counts.transform(chosen)

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Adds score."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.constant))
        out = self.model.transform(self._features(rows.withColumn("__terms", terms(F.col(text)))))
        return out.withColumn("score", F.get(vector_to_array("__probability"), F.lit(1))).drop(
            "__terms", "__features", "__raw", "__probability", "__predicted")


def _vocabulary(rows: DataFrame) -> list[str]:
    """Buckets that serve as features, at most TELLING + FREQUENT, from rows (toxic, __terms)."""
    n, ones = rows.agg(F.count("*"), F.sum("toxic")).first()
    counts = durable(rows.select("toxic", F.explode("__terms").alias("b")).groupBy("b").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("ones")).filter(F.col("n") >= LEAST))
    share = F.col("n") / n
    gap = F.col("ones") / ones - (F.col("n") - F.col("ones")) / (n - ones)
    errors = F.abs(gap) / F.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)) + 1e-12)
    telling = counts.filter(errors >= ERRORS).orderBy(errors.desc(), "b").limit(TELLING)
    frequent = counts.filter(share <= SHARE).orderBy(F.desc("n"), "b").limit(FREQUENT)
    return [str(r["b"]) for r in telling.select("b").union(frequent.select("b")).distinct().orderBy("b").collect()]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Scorer:
    """A machine learnt from labelled rows that are not held out.

    Of several labels of an id the highest counts; null labels do not count; ids with
    several texts are learnt with each. With rows of one class only, or none, the score is constant.
    """
    known = labels.filter("toxic is not null").groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = hash_sample(known.filter(~held_out(key)), key, train_rows)
    rows = durable(docs.select(key, text).join(F.broadcast(sample), key).select("toxic", terms(F.col(text)).alias("__terms")))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if ones in (0, n):
        return Scorer([], None, 1.0 if ones else 0.0)
    vocabulary = _vocabulary(rows)
    if not vocabulary:
        return Scorer([], None, ones / n)
    learner = FMClassifier(featuresCol="__features", labelCol="toxic", predictionCol="__predicted", probabilityCol="__probability",
                           rawPredictionCol="__raw", factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=PENALTY, seed=SEED)
    scorer = Scorer(vocabulary, None, 0.0)
    scorer.model = learner.fit(durable(scorer._features(rows).select("toxic", "__features")))
    return scorer


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A score for every whole text.

    Returns per row: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts
    have no term and get the machine's intercept. Repeated rows and null ids each give a
    row; an empty table gives none; other columns are never looked at.
    """
    scored = fit(docs, labels, key=key, text=text).score(docs.select(key, text), text)
    return scored.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
