"""Applies decisions per document to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.runtime import durable, small_side


def keep_rows(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", once: bool = False) -> DataFrame:
    """The documents that decisions (doc_id, kept) keep, with all their columns.

    Rows that share an id are one document: they stay if one of them is kept. With ``once``,
    rows that are equal in all columns stay once. Only the ids of dropped documents meet
    the texts, broadcast below a checked size; beyond it the join shuffles. Null ids are matched
    like others.
    """
    ids = durable(decisions.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    dropped = small_side(ids.filter("not kept").select("doc_id"))
    out = docs.join(dropped, docs[key].eqNullSafe(dropped["doc_id"]), "left_anti")
    again = ids.filter("kept and n > 1").select("doc_id")
    if not once or again.isEmpty():
        return out
    again = small_side(again)
    same = out[key].eqNullSafe(again["doc_id"])
    return out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates())
