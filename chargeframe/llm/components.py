"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.runtime import durable


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links every neighbour of a node to the smallest of them; the small star looks at smaller neighbours only."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    turned = near.join(low, "u")
    if small:
        new = turned.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        new = turned.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return new.filter("a <> b").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of a link (a, b): the smallest node it is connected with.

    A group of any size is handled by aggregates and joins only; the steps end when the
    links are stars around the smallest nodes."""
    edges = durable(links.select("a", "b").filter("a <> b").distinct())
    seen = _print(edges)
    while True:
        edges = durable(_star(_star(edges, False), True))
        now = _print(edges)
        if now == seen:
            break
        seen = now
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centres)
