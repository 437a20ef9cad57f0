from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe.llm import toxicity


def test_long_texts_and_clashing_columns(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit("x").alias("text"))
    got = toxicity.rate(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.filter("score is null or score < 0 or score > 1").isEmpty()
