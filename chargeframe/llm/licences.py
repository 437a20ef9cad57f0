"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by templates.

A sparse logistic regression over hashed word n-grams, fitted on varied template notices
and ordinary paragraphs, names the licence family of a paragraph. A second regression on
held-back rows turns its margin over the unknown class into a calibrated probability.
What passes is compared with the family's templates. Lines are judged, and where a word pair of a
notice stands, so are the words from there over the next lines, since notices are often wrapped.
DataFrame functions and MLlib only; a paragraph is judged where it is read, and only what was found is shuffled.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargeframe.llm.sampling import hash_sample
from chargeframe.runtime import durable

# Notices by which works state their licence.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License, see the file LICENSE for details.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "You may not use this file except in compliance with the License. You may obtain a copy of the License "
                   "at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "You can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or any later version."],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved."],
}
#: Sentences that share words with notices without stating a licence.
ORDINARY = ["He lost his driving license on the way to work.", "The general public may use the library under supervision.",
            "Human rights are reserved for nobody and belong to all.", "A new version of the software was released in May.",
            "The file is subject to change without notice.", "MIT and Stanford released a study of public work.",
            "The Apache people live in the southwest.", "All of the terms of the agreement are under review.",
            "Creative work is common in the attribution of art.", "The source of the river is under the mountain."]

#: Buckets of n-grams; varied copies per template; documents that ordinary paragraphs come
#: from (chosen by a hash of their id); share of the words a copy loses.
BUCKETS, COPIES, SAMPLE_DOCS, LOST = 1 << 18, 40, 400, 0.12
#: Similarity to a template that confirms a family, and calibrated probability that names it.
SIMILARITY, PROBABILITY = 0.6, 0.5
PENALTY, ROUNDS = 1e-3, 60


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def _hashed(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS))


def bigrams(w: Column) -> Column:
    n = F.size(w) - 1
    return F.when(n > 0, F.zip_with(F.slice(w, 1, F.greatest(n, F.lit(0))), F.slice(w, 2, F.greatest(n, F.lit(0))),
                                    lambda a, b: _hashed(a, b))).otherwise(F.array().cast("array<bigint>"))


def grams(w: Column) -> Column:
    """Distinct buckets of a paragraph's words and word pairs."""
    return F.array_distinct(F.concat(F.transform(w, lambda x: _hashed(x)), bigrams(w)))


def _literal(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, body) for each line that is not blank; paragraph counts all lines from 0."""
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(lines).alias("paragraph", "body")).filter(F.col("body").rlike(r"[\p{L}\p{N}]"))


def stretches(docs: DataFrame, pairs: list[int], longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, uid, paragraph, last, w): the words of each line, and of stretches that go over lines.

    Stretches start where a line has its first pair of words of a notice and end at a blank line or after as many words
    as notices have: 12 and its doubles up to the first that holds the longest."""
    sizes = [12]
    while sizes[-1] < longest:
        sizes.append(2 * sizes[-1])
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    # an empty word stands for a line without words and pairs with none
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.transform(
        lines, lambda x: F.when(x.rlike(r"[\p{L}\p{N}]"), words(x)).otherwise(F.array(F.lit("")))).alias("lw"))
    rows = rows.withColumn("all", F.flatten("lw")).withColumn("pairs", bigrams(F.col("all")))
    known = F.array(*(F.lit(b) for b in pairs))
    spotted = (F.size("lw") > 1) & F.arrays_overlap("pairs", known)
    nothing = F.array().cast("array<int>")
    rows = rows.withColumn("marks", F.when(spotted, F.filter(
        F.transform("pairs", lambda b, i: F.when(F.array_contains(known, b), i).otherwise(F.lit(-1))), lambda i: i >= 0)).otherwise(nothing))
    rows = rows.withColumn("line", F.when(F.size("marks") > 0, F.flatten(F.transform(
        "lw", lambda x, i: F.array_repeat(i, F.size(x))))).otherwise(nothing))
    rows = rows.withColumn("marks", F.filter("marks", lambda m, k: (k == 0) | (F.get("line", F.get("marks", k - 1)) != F.get("line", m))))

    def over(size: int) -> Column:
        cut = F.transform("marks", lambda m: F.struct(m.alias("m"), F.slice("all", m + 1, F.lit(size)).alias("w")))
        cut = F.transform(cut, lambda s: F.struct(s["m"].alias("m"), F.when(
            F.array_position(s["w"], "") > 0, F.slice(s["w"], F.lit(1), F.array_position(s["w"], "").cast("int") - 1)).otherwise(s["w"]).alias("w")))
        return F.filter(F.transform(cut, lambda s: F.struct(
            F.get("line", s["m"]).alias("paragraph"), F.get("line", s["m"] + F.size(s["w"]) - 1).alias("last"), s["w"].alias("w"))),
            lambda s: s["last"] > s["paragraph"])

    single = F.filter(F.transform("lw", lambda x, i: F.struct(i.alias("paragraph"), i.alias("last"), x.alias("w"))), lambda s: F.get(s["w"], F.lit(0)) != "")
    return rows.select("doc_id", "uid", F.explode(F.concat(single, *map(over, sizes))).alias("s")).select("doc_id", "uid", "s.*")


def _best(found: DataFrame) -> DataFrame:
    """Of what overlaps in a text the most similar, then the shortest; what no template confirms gives way to a confirmed stretch."""
    order = [F.desc("similarity"), F.size("__w"), F.desc("probability"), F.col("last")]
    found = found.withColumn("__nth", F.row_number().over(Window.partitionBy("uid", "paragraph", "family").orderBy(*order))).filter("__nth = 1")
    near = Window.partitionBy("uid", "family").orderBy("paragraph")
    one = F.struct("paragraph", "last", "similarity", F.size("__w").alias("n"))
    found = found.withColumns({"__before": F.lag(one).over(near), "__after": F.lead(one).over(near), "__covered": F.max(
        F.when((F.col("last") > F.col("paragraph")), F.col("last"))).over(
        Window.partitionBy("uid").orderBy("paragraph").rangeBetween(Window.unboundedPreceding, 0))})
    size = F.size("__w")
    lost = ((F.col("__before.last") >= F.col("paragraph")) & (
        (F.col("__before.similarity") > F.col("similarity")) | ((F.col("__before.similarity") == F.col("similarity")) & (F.col("__before.n") <= size)))) | (
        (F.col("__after.paragraph") <= F.col("last")) & (
            (F.col("__after.similarity") > F.col("similarity")) | ((F.col("__after.similarity") == F.col("similarity")) & (F.col("__after.n") < size))))
    hidden = (F.col("similarity") < SIMILARITY) & (F.coalesce(F.col("__covered"), F.lit(-1)) >= F.col("paragraph"))
    return found.filter(~F.coalesce(lost, F.lit(False)) & ~hidden)


def training_rows(docs: DataFrame, families: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, w, part): varied notices and ordinary paragraphs; label 0 is unknown, part 0 fits and 1 calibrates."""
    spark = docs.sparkSession
    notices = _literal(spark, [{"label": families.index(f) + 1, "body": t} for f, ts in TEMPLATES.items() for t in ts]
                       + [{"label": 0, "body": t} for t in ORDINARY], "label:int,body:string")
    copies = notices.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("w", words(F.col("body")))

    def chance(*parts) -> Column:
        return F.pmod(F.xxhash64("body", "copy", *parts), F.lit(10_000)) / 10_000

    kept = F.filter("w", lambda x, i: (F.col("copy") == 0) | (chance(i) >= LOST))
    # words of other lines before and after, as a notice stands within a longer paragraph
    around = F.array(*map(F.lit, "from the editors of this page with many thanks to all who read it".split()))
    before = F.slice(around, 1, (chance(F.lit("before")) * 8).cast("int"))
    after = F.slice(F.reverse(around), 1, (chance(F.lit("after")) * 8).cast("int"))
    varied = copies.select("label", F.when(F.col("copy") == 0, F.col("w")).otherwise(F.concat(before, kept, after)).alias("w"))
    chosen = hash_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", SAMPLE_DOCS)
    ordinary = paragraphs(chosen, "k", "t").select(F.lit(0).alias("label"), words(F.col("body")).alias("w"))
    spotted = F.arrays_overlap(bigrams(F.col("w")), F.array(*(F.lit(b) for b in _template_bigrams(spark))))
    rows = varied.unionByName(ordinary.filter(~F.coalesce(spotted, F.lit(False))))
    return rows.withColumn("part", (F.pmod(F.xxhash64("w"), F.lit(4)) == 0).cast("int"))


def _template_table(spark: SparkSession) -> list:
    """(family, words and pairs, pairs) of each template; as many rows as there are templates."""
    rows = _literal(spark, [{"family": f, "body": t} for f, ts in TEMPLATES.items() for t in ts], "family:string,body:string")
    return rows.withColumn("w", words(F.col("body"))).select("family", grams(F.col("w")).alias("g"), bigrams(F.col("w")).alias("b")).collect()


def _template_bigrams(spark: SparkSession) -> list[int]:
    """Pairs of words that only notices are made of: those of the templates that no ordinary sentence has."""
    common = _literal(spark, [{"body": t} for t in ORDINARY], "body:string").select(bigrams(words(F.col("body"))).alias("b")).collect()
    return sorted({x for r in _template_table(spark) for x in r["b"]} - {x for r in common for x in r["b"]})


class Classifier:
    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        spark = docs.sparkSession
        self.families = list(TEMPLATES)
        self.templates = _template_table(spark)
        self.vocabulary = sorted({x for r in self.templates for x in r["g"]})
        self.counts = CountVectorizerModel.from_vocabulary([str(v) for v in self.vocabulary], "__grams", "__features").setBinary(True)
        rows = durable(self._features(training_rows(docs, self.families, key, text).withColumn("g", grams(F.col("w")))).select("label", "part", "__features"))
        learner = LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw",
                                     predictionCol="__predicted", family="multinomial", regParam=PENALTY, maxIter=ROUNDS)
        self.model = learner.fit(rows.filter("part = 0"))
        held = self._margin(self.model.transform(rows.filter("part = 1"))).select(
            (F.col("label") > 0).cast("int").alias("is"), F.array("__margin").alias("m"))
        calibrator = LogisticRegression(featuresCol="v", labelCol="is", regParam=PENALTY, maxIter=ROUNDS)
        fitted = calibrator.fit(durable(held.select("is", array_to_vector("m").alias("v"))))
        self.slope, self.shift = float(fitted.coefficients[0]), float(fitted.intercept)

    def _features(self, rows: DataFrame) -> DataFrame:
        wanted = F.array(*(F.lit(v) for v in self.vocabulary))
        known = rows.withColumn("g", F.array_intersect("g", wanted)).filter(F.size("g") > 0)
        return self.counts.transform(known.withColumn("__grams", F.col("g").cast("array<string>")))

    def _margin(self, rows: DataFrame) -> DataFrame:
        """Adds the best family's number and its log-probability over that of the unknown class."""
        out = rows.withColumn("__p", vector_to_array("__probability"))
        best = F.array_max(F.slice("__p", 2, len(self.families)))
        return out.withColumn("__margin", F.log(best + 1e-9) - F.log(F.get("__p", F.lit(0)) + 1e-9)).withColumn(
            "__best", F.array_position(F.slice("__p", 2, len(self.families)), best))

    def name(self, rows: DataFrame, column: str = "w") -> DataFrame:
        """Adds family, probability and similarity to paragraphs' words; only those with a word or pair of a notice remain."""
        known = self._features(rows.withColumn("__w", F.col(column)).withColumn("g", grams(F.col("__w"))))
        judged = self._margin(self.model.transform(known))
        family = F.get(F.array(*map(F.lit, self.families)), (F.col("__best") - 1).cast("int"))
        pairs = bigrams(F.col("__w"))
        shares = [F.lit(0.0)]
        for r in self.templates:
            own = F.array(*(F.lit(b) for b in sorted(set(r["b"]))))
            shares.append(F.when(F.col("family") == r["family"], F.size(F.array_intersect(own, "__pairs")) / float(len(set(r["b"])))).otherwise(0.0))
        probability = 1 / (1 + F.exp(-(F.col("__margin") * self.slope + self.shift)))
        return judged.withColumns({"family": family, "probability": probability, "__pairs": pairs}).filter(
            F.col("probability") >= PROBABILITY).withColumn("similarity", F.greatest(*shares))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices in every whole text, on one line or wrapped over several.

    Returns per notice that the classifier gives to a family: doc_id, paragraph (number of its first
    line from 0), family, probability (calibrated), similarity (share of the best template's
    word pairs) and confirmed. Notices over several lines must be confirmed; a blank line ends them. Null, empty
    and blank texts have no paragraph. Repeated rows and null ids are judged like others; an empty table gives
    none; other columns are ignored.
    """
    classifier = Classifier(docs, key, text)
    longest = max(len(r["b"]) + 1 for r in classifier.templates)
    rows = stretches(docs, _template_bigrams(docs.sparkSession), longest, key, text)
    named = _best(classifier.name(rows).filter((F.col("last") == F.col("paragraph")) | (F.col("similarity") >= SIMILARITY)))
    return named.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= SIMILARITY).alias("confirmed"))
