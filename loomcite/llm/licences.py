"""Licence scan of paragraphs: a trained classifier, confirmed by templates.

A paragraph is a line with a word; its features are its distinct word pairs and triples that
some template has. A multinomial logistic regression tells licence families and the class
"unknown" apart; it is trained on spans of the templates and on a bounded sample of the
corpus's own paragraphs that hold no template triple. One temperature, fitted on spans that
were not trained on, calibrates the probabilities. A paragraph is judged by overlapping windows of
twice the longest template's words, so that a statement inside a long line stands in one of them
whole. A predicted family is confirmed if the window and one of the family's templates share
enough of their pairs and triples, or enough of the template's are in the window; the window
that is most like a template speaks for the paragraph. A window without any such feature has
the intercepts alone and is unknown; a paragraph of such windows gives no row.

Everything runs as column expressions, aggregates and joins. The feature table is as large
as the templates, whatever the corpus, and is the only side that is broadcast.

Rules for odd rows: null and empty texts have no paragraph; repeated rows are scanned each;
a null id stays null; without documents the result is empty.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

UNKNOWN = "unknown"
#: Bound of the corpus paragraphs that are learned from as unknown.
NEGATIVES = 1500
CONFIRM_FROM = 0.5
HEATS = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)
#: What stands between words; dots and hyphens inside a word, as in 2.0, belong to it.
BETWEEN = r"[.\-]*[^a-z0-9.\-]+[.\-]*"
EDGES = " \t\r\x0b\x0c.-,;:!?()[]\"'"
#: Shortest span of a template that is trained on, as a share of its words.
SPAN_FROM = 0.5

#: Wordings by which texts state their licence.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
        "Released under the BSD 3-Clause License.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "No rights reserved; released into the public domain."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Sentences with words of licences that state none.
LOOKALIKES = [
    "The driver lost his license and had to renew it at the office.", "The permission of the author is not required for quotes.", "All rights and duties of the members are listed below.",
    "The general public was invited to the free concert.", "Version 3 of the report was released in May.", "You may use this form to apply for a copy.", "The work is under way and the terms of the contract are known.",
]


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (index of its line in the text), body."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "body"))
    return rows.filter(F.btrim("body") != "")


def _words(body: str) -> Column:
    return F.split(F.btrim(F.lower(body), F.lit(EDGES)), BETWEEN)


#: Words between the beginnings of two windows; a window has twice as many.
STEP = max(len(re.split(BETWEEN, b.lower().strip(EDGES))) for bodies in TEMPLATES.values() for b in bodies)


def with_windows(rows: DataFrame, known: list[int]) -> DataFrame:
    """``rows`` once for each window of ``body``, with window (0, 1, ..) and f (see ``with_features``); any STEP words in a row are in one window.

    Only bodies with a pair of words among the features ``known``: each of their triples begins with one of their pairs.
    """
    # a generator, so that the filter below reads the array instead of making it again
    rows = rows.withColumn("f", F.explode_outer(F.array(F.transform(_words("body"), lambda w: F.xxhash64(w)))))
    rows = rows.filter(F.arrays_overlap(F.zip_with("f", _later(1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), F.lit(known)))
    last = F.greatest(F.lit(0), F.ceil((F.size("f") - 2 * STEP) / STEP).cast("int"))
    # here and below the outer form, as of a plain explode Spark infers a filter on the array and puts it below the steps that make the array
    rows = rows.withColumn("window", F.explode_outer(F.sequence(F.lit(0), last)))
    return _paired(rows.withColumn("f", F.slice("f", F.col("window") * STEP + 1, F.lit(2 * STEP))))


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` with f: the hashes of the distinct word pairs and triples of ``body``, in lower case."""
    return _paired(rows.withColumn("f", F.transform(_words("body"), lambda w: F.xxhash64(w))))


def _later(by: int) -> Column:
    """The words of ``f`` from the ``by``-th after the first on."""
    return F.slice("f", by + 1, F.greatest(F.size("f") - by, F.lit(0)))


def _paired(rows: DataFrame) -> DataFrame:
    twos = F.zip_with("f", _later(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.transform(twos, lambda x: F.when(x["b"].isNotNull(), F.xxhash64(x["a"], x["b"])))
    triples = F.zip_with(twos, _later(2), lambda x, c: F.when(c.isNotNull(), F.xxhash64(x["a"], x["b"], c)))
    return rows.withColumn("f", F.array_distinct(F.array_compact(F.concat(pairs, triples))))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(k, FAMILIES.index(family), body) for k, (family, body) in enumerate((f, b) for f, bodies in TEMPLATES.items() for b in bodies)]
    return spark.createDataFrame(rows, "template int, family int, body string")


def vocabulary(spark: SparkSession) -> DataFrame:
    """h, place (0, 1, ..), templates (those that have it), written: some hundred rows, fixed by TEMPLATES."""
    from pyspark.sql import Window

    rows = with_features(_templates(spark)).select("template", F.explode_outer("f").alias("h")).filter("h is not null")
    rows = rows.groupBy("h").agg(F.array_sort(F.collect_set("template")).alias("templates"))
    return durable(rows.select("h", (F.row_number().over(Window.orderBy("h")) - 1).alias("place"), "templates").coalesce(1))


def _spans(spark: SparkSession) -> DataFrame:
    """Training paragraphs from the templates: all spans of half a template's words or more, alone and with other words around."""
    words = F.split(F.regexp_replace("body", "[.]$", ""), " ")
    rows = _templates(spark).select("family", words.alias("w")).select("family", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("a"))
    rows = rows.select("family", "w", "a", F.explode(F.sequence("a", F.size("w"))).alias("b"))
    rows = rows.filter((F.col("b") - F.col("a") + 1 >= SPAN_FROM * F.size("w")) & (F.col("b") > F.col("a")))
    rows = rows.select("family", F.array_join(F.slice("w", F.col("a"), F.col("b") - F.col("a") + 1), " ").alias("body"))
    return rows.unionByName(rows.select("family", F.concat(F.lit("copyright notice "), "body", F.lit(" see below")).alias("body")))


def negatives(docs: DataFrame, known: DataFrame, most: int = NEGATIVES) -> DataFrame:
    """Of the ``most`` different corpus paragraphs with the smallest hash those with two template features or fewer, and the lookalikes."""
    spark = docs.sparkSession
    rows = paragraphs(docs).select("body", F.xxhash64("body").alias("hash"))
    # copies are put together by their hashes, so that no text is shuffled
    last = rows.select("hash").distinct().orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    kept = durable(rows.filter(F.col("hash") <= F.lit(last).cast("bigint")).select("body").distinct())
    met = with_features(kept).select("body", F.explode_outer("f").alias("h")).join(F.broadcast(known.select("h")), "h").groupBy("body").count().filter(F.col("count") > 2)
    rows = kept.join(met.select("body"), "body", "left_anti")
    return rows.unionByName(spark.createDataFrame([(b,) for b in LOOKALIKES], "body string")).select(F.lit(0).alias("family"), "body")


class LicenceModel:
    """Coefficients (family by place), intercepts and temperature."""

    def __init__(self, coefficients: list[list[float]], intercepts: list[float], temperature: float = 1.0):
        self.coefficients, self.intercepts, self.temperature = coefficients, intercepts, temperature

    def probabilities(self, sums: Column, heat: float | None = None) -> Column:
        """Array of class probabilities from the array of summed coefficients."""
        z = F.zip_with(sums, F.array(*map(F.lit, self.intercepts)), lambda a, b: (a + b) / (heat or self.temperature))
        return F.transform(z, lambda x: F.exp(x - F.array_max(z)))

    def weights(self, known: DataFrame) -> DataFrame:
        """h, w (coefficients by class), templates: as many rows as the vocabulary."""
        rows = [(r["h"], [c[r["place"]] for c in self.coefficients], r["templates"]) for r in known.collect()]
        return known.sparkSession.createDataFrame(rows, "h bigint, w array<double>, templates array<int>")


def _class_sums() -> list[Column]:
    return [F.sum(F.coalesce(F.get("w", F.lit(f)), F.lit(0.0))).alias(f"w{f}") for f in range(len(FAMILIES))]


def _share(weighted: Column, which: Column) -> Column:
    return F.get(weighted, which) / F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def fit_licences(docs: DataFrame, known: DataFrame) -> LicenceModel:
    spark = docs.sparkSession
    size = known.count()
    rows = _spans(spark).unionByName(negatives(docs, known))
    rows = rows.select("family", "body", (F.pmod(F.xxhash64("body"), F.lit(4)) == 0).alias("apart")).distinct()
    rows = durable(with_features(rows))
    places = rows.select("body", F.explode_outer("f").alias("h")).join(F.broadcast(known.select("h", "place")), "h").groupBy("body").agg(F.collect_set("place").alias("places"))
    x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.array_contains(F.coalesce("places", F.array().cast("array<int>")), k).cast("double"))
    rows = durable(rows.join(places, "body", "left").select(F.col("family").cast("double").alias("label"), "body", "apart", "f", x.alias("x")).coalesce(2))
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=60, featuresCol="features").fit(rows.filter(~F.col("apart")).select("label", array_to_vector("x").alias("features")))
    model = LicenceModel(fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist())
    apart = rows.filter("apart").select(F.col("label").cast("int").alias("label"), "body", F.explode_outer("f").alias("h"))
    apart = apart.join(F.broadcast(model.weights(known)), "h", "left").groupBy("label", "body").agg(*_class_sums())
    apart = durable(apart.select("label", F.array(*[f"w{f}" for f in range(len(FAMILIES))]).alias("sums")))
    losses = []
    for heat in HEATS:
        own = apart.select("label", model.probabilities(F.col("sums"), heat).alias("p")).select(F.avg(-F.log(F.greatest(_share(F.col("p"), F.col("label")), F.lit(1e-12)))))
        losses.append(own.first()[0])
    model.temperature = HEATS[min(range(len(HEATS)), key=lambda k: math.inf if losses[k] is None else losses[k])]
    return model


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each paragraph with a template feature: doc_id, paragraph, family, probability, template, similarity, confirmed.

    ``family`` is the likeliest class, "unknown" included; ``template`` is the closest one of
    the family (null if unknown), ``similarity`` the greater of the share of common features
    (Dice) and the share of the template's features that are there, in the best window.
    """
    known = vocabulary(docs.sparkSession)
    model = fit_licences(docs, known)
    weights = F.broadcast(model.weights(known))
    templates = _template_sizes(docs.sparkSession)
    lines = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    lines = lines.filter(F.btrim("body") != "")
    met = with_windows(lines, [r[0] for r in known.select("h").collect()]).select("uid", "doc_id", "paragraph", "window", F.size("f").alias("n"), F.explode_outer("f").alias("h")).join(weights, "h")
    common = [F.count_if(F.array_contains("templates", F.lit(k))).alias(f"t{k}") for k, _, _ in templates]
    sums = met.groupBy("uid", "paragraph", "window").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), *_class_sums(), *common)
    alike = F.array(*[F.struct(F.lit(family).alias("family"), (F.col(f"t{k}") / F.least((F.col("n") + size) / 2, F.lit(float(size)))).alias("s"), F.lit(k).alias("k")) for k, family, size in templates])
    rows = sums.select("uid", "doc_id", "paragraph", "window", alike.alias("alike"), F.array(*[f"w{f}" for f in range(len(FAMILIES))]).alias("sums"))
    rows = rows.select("uid", "doc_id", "paragraph", "window", "alike", model.probabilities(F.col("sums")).alias("p"))
    rows = rows.withColumn("class", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    own = F.transform(F.filter("alike", lambda x: x["family"] == F.col("class")), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k")))
    rows = rows.withColumn("best", F.array_max(own)).withColumn("similarity", F.coalesce("best.s", F.lit(0.0)))
    said = F.struct("similarity", (-F.col("window")).alias("before"), "class", _share(F.col("p"), F.col("class")).alias("probability"), F.col("best.k").alias("template"))
    rows = rows.groupBy("uid", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.max(said).alias("said")).select("doc_id", "paragraph", "said.*")
    return rows.select(
        "doc_id", "paragraph", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("class") + 1).alias("family"), "probability", "template",
        "similarity", ((F.col("class") > 0) & (F.col("similarity") >= CONFIRM_FROM)).alias("confirmed"),
    )


def _template_sizes(spark: SparkSession) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in with_features(_templates(spark)).select("template", "family", F.size("f")).orderBy("template").collect()]
