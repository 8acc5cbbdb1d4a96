"""Licence families of paragraphs: a trained classifier proposes, comparison with templates confirms."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingualoom.llm.words import let, words
from lingualoom.session import discard, stage

# Notices as the licences themselves, or their publishers, word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "This project is released under the Apache 2.0 license."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "This software is available under the terms of the MIT license."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "Licensed under the GPL, version 2 or later."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("public_domain", "This is free and unencumbered software released into the public domain."),
    ("public_domain", "SPDX-License-Identifier: CC0-1.0"),
    ("public_domain", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."),
)
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
UNKNOWN = "unknown"
# Words that never occur in a negative example; they also mark a paragraph as one about licences.
TELLING = r"(?i)licen[sc]e|copyright|spdx|redistribut|public domain|creative commons|\bGPL\b|\bMIT\b"

# Bounds of the fit: altered versions of each template, and documents that negatives are taken from.
VARIANTS = 40
NEGATIVE_DOCS = 400
# Hashed n-grams; the share of held-out negatives that may pass, the least probability, the least share of template pairs.
SLOTS = 1 << 16
FALSE_SHARE = 0.001
LEAST = 0.5
CONFIRMED = 0.6
# Words of a stretch of a long paragraph, which starts at every half of it; the longest template fits in a half.
STRETCH = 64
# Tasks that share the bounded fitting rows.
PARTS = 16
GAPS = r"[^\p{L}\p{N}]+"


_BREAK = r"\r\n|\r|\n"


def paragraphs(text: Column) -> Column:
    """What stands between blank lines, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?:{_BREAK})(?:[\x20\t]*(?:{_BREAK}))+"), lambda p: p.rlike(r"\S"))


def _stretches(p: Column, tokens: Column) -> Column:
    """Runs of words of a paragraph that are judged each: its lines, and the whole of it in stretches that overlap by half."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - STRETCH // 2, F.lit(1)), F.lit(STRETCH // 2))
    lines = F.transform(F.split(p, _BREAK), _tokens)
    return F.array_distinct(F.concat(F.transform(starts, lambda i: F.slice(tokens, i, STRETCH)), F.filter(lines, lambda w: F.size(w) > 0)))


def _grams(tokens: Column) -> Column:
    """Hashes of all words and pairs of neighbouring words."""
    return F.concat(F.transform(tokens, lambda w: F.xxhash64(w)), _pairs(tokens))


def _pairs(tokens: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(tokens) - 2)
    pair = lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1))
    return F.when(F.size(tokens) > 1, F.transform(starts, pair)).otherwise(F.array().cast("array<bigint>"))


def _slot(gram: Column) -> Column:
    return F.pmod(gram, F.lit(SLOTS)).cast("int")


def _tokens(text: Column) -> Column:
    return words(F.lower(text), GAPS)


def template_pairs(spark: SparkSession) -> list[list[list[int]]]:
    """The distinct word pairs of each template, by family: a few hundred numbers, made once."""
    row = spark.range(1).select(*[F.array_sort(F.array_distinct(_pairs(_tokens(F.lit(t))))).alias(f"t{i}") for i, (_, t) in enumerate(TEMPLATES)]).first()
    return [[list(row[i]) for i, (f, _) in enumerate(TEMPLATES) if f == family] for family in FAMILIES]


def _share(own: Column, pairs: list[int]) -> Column:
    """Which share of a template's pairs is among a paragraph's."""
    return F.size(F.array_intersect(_constant(pairs, "bigint"), own)) / F.lit(float(len(pairs)))


@dataclass(frozen=True)
class Model:
    features: tuple[int, ...]  # hashes, in the order of the weights
    weights: tuple[tuple[float, ...], ...]  # for each feature one weight per class: none, then FAMILIES
    constants: tuple[float, ...]
    least: float  # probability below which a family isn't trusted
    pairs: tuple[tuple[tuple[int, ...], ...], ...]  # of each family's templates


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(1 + FAMILIES.index(f)).alias("y"), F.lit(t).alias("p")) for f, t in TEMPLATES])
    return spark.range(1).select(F.inline(rows))


def fit(docs: DataFrame, text_col: str = "text", variants: int = VARIANTS, negative_docs: int = NEGATIVE_DOCS) -> Model:
    """Multinomial logistic regression on sparse words and word pairs.

    Positives are the templates and versions of them without some of their words, every other one amid words
    of a negative example; negatives are the paragraphs of at most ``negative_docs`` documents, those with the
    smallest hash of their text, unless a telling word or most of a template is in them.  A quarter is held out; the
    probability that all but FALSE_SHARE of the held-out negatives stay below is the least one to trust.
    """
    spark = docs.sparkSession
    known = template_pairs(spark)
    texts = docs.select(F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))
    # Distinct texts; a number each, and at most `negative_docs` of them.
    chosen = texts.select("h").distinct().orderBy("h").limit(negative_docs)
    some = texts.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).repartition(PARTS, "h")
    plain = some.select(F.explode(paragraphs(F.col("t"))).alias("p")).filter(~F.col("p").rlike(TELLING))
    # Written down, so that what reads the words reads a column and not the pattern that makes them.
    told = stage(plain.select(_tokens(F.col("p")).alias("w")), "license-words")
    negatives = told.repartition(PARTS, F.xxhash64("w")).select(F.lit(0).alias("y"), "w")
    cut = F.filter(F.col("w"), lambda w, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(F.col("v"), i, w), F.lit(8)) != 0))
    positives = _templates(spark).select("y", _tokens(F.col("p")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(variants))).alias("v"))
    positives = positives.select("y", "v", cut.alias("own"))
    # Notices without a telling word are no negatives either.
    likest = let(_pairs(F.col("w")), lambda own: F.greatest(*[_share(own, pairs) for family in known for pairs in family]))
    negatives = stage(negatives.withColumn("_likest", likest).filter(F.col("_likest") < CONFIRMED).drop("_likest"), "license-negatives")
    discard(told)
    # One paragraph for each odd version, the same for all templates.
    amid = negatives.filter(F.size("w") >= 8).distinct().orderBy(F.xxhash64("w"), "w").limit(variants)
    amid = amid.select(F.explode(F.array(F.slice("w", 1, STRETCH // 4))).alias("before"), F.slice(F.reverse("w"), 1, STRETCH // 4).alias("after"))
    amid = amid.select("before", "after", (F.row_number().over(Window.orderBy(F.xxhash64("before"), "before", "after")) * 2 - 1).alias("v"))
    none = F.array().cast("array<string>")
    mixed = F.concat(F.coalesce("before", none), F.col("own"), F.coalesce(F.reverse("after"), none))
    positives = positives.join(F.broadcast(amid), "v", "left").select("y", mixed.alias("w"), "own")

    def named(tokens: Column) -> Column:
        return F.transform(F.array_distinct(_grams(tokens)), lambda s: s.cast("string"))

    rows = positives.unionByName(negatives.withColumn("own", F.col("w"))).select(
        "y", named(F.col("w")).alias("grams"), named(F.col("own")).alias("own"), (F.pmod(F.xxhash64("w"), F.lit(4)) == 0).alias("held")
    )
    rows = stage(rows, "license-fit")
    # Only n-grams of the templates weigh anything, and of those that share a slot none.
    grams = rows.filter("y > 0").select(F.explode("own").alias("gram")).groupBy("gram").count().orderBy(F.desc("count"), "gram").collect()
    slots = Counter(int(r["gram"]) % SLOTS for r in grams)
    kept = [r["gram"] for r in grams if slots[int(r["gram"]) % SLOTS] == 1]
    vocabulary = CountVectorizerModel.from_vocabulary(kept, inputCol="grams", outputCol="features")
    vocabulary.setBinary(True)
    ready = vocabulary.transform(rows)
    # Each class weighs the same altogether.
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    for y, n in counts.items():
        weight = F.when(F.col("y") == y, F.lit(100.0 / n)).otherwise(weight)
    ready = ready.withColumn("weight", weight)
    fitted = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=60).fit(ready.filter("not held or y > 0"))
    guess = fitted.transform(ready.filter("held and y = 0")).select(vector_to_array("probability").alias("p"))
    top = guess.select(F.array_max(F.slice("p", 2, len(FAMILIES))).alias("top")).agg(F.percentile("top", 1 - FALSE_SHARE)).first()[0]
    matrix = fitted.coefficientMatrix.toArray().T
    model = Model(
        tuple(int(s) for s in vocabulary.vocabulary), tuple(tuple(map(float, row)) for row in matrix),
        tuple(map(float, fitted.interceptVector.toArray())), max(LEAST, min(float(top or 0.0), 0.95)),
        tuple(tuple(map(tuple, family)) for family in known),
    )
    discard(rows, negatives)
    return model


def _constant(values: list, kind: str) -> Column:
    """A literal array; as text, which Spark turns into one value before it runs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def classified(text: Column, model: Model) -> Column:
    """``array<struct<paragraph, family, probability>>``: what each paragraph about a licence is under, once for each family.

    Lines and overlapping stretches of the paragraph are judged each.  ``family`` is one of FAMILIES if
    its probability reaches the trusted one and enough word pairs of one template of the family stand in
    the stretch; else, if in some stretch no licence at all is less likely than some licence and a
    telling word is in the paragraph, it is ``unknown``.
    """
    classes = len(FAMILIES) + 1
    place = [0] * SLOTS
    for i, s in enumerate(model.features):
        place[s % SLOTS] = i + 1
    places = _constant(place, "int")
    hashes = _constant([0, *model.features], "bigint")
    weights = _constant([0.0] * classes + [w for row in model.weights for w in row], "double")
    constants = _constant(list(model.constants), "double")
    names = _constant(list(FAMILIES), "string")

    def odds(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(classes - 1)),
            lambda c: F.aggregate(found, constants[c], lambda s, i: s + weights[i * classes + c]),
        )

    def chances(logits: Column) -> Column:
        def shares(e: Column) -> Column:
            return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

        return let(logits, lambda z: let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), shares)))

    def known(grams: Column) -> Column:
        """Numbers of the grams that are features; others in the slot of a feature are none."""
        # Place 0 holds the hash 0, so most grams need one look; the place is read again for those that are features.
        numbers = F.transform(grams, lambda g: F.when(F.get(hashes, F.get(places, _slot(g))) == g, F.get(places, _slot(g))))
        return F.filter(F.array_distinct(numbers), lambda i: i > 0)

    def confirmation(tokens: Column, family: Column) -> Column:
        """The largest share of the word pairs of one template that the paragraph has, over the family's templates."""

        def shares(own: Column) -> Column:
            chosen = F.lit(None).cast("double")
            for i, templates in enumerate(model.pairs):
                of_family = [_share(own, list(t)) for t in templates]
                chosen = F.when(family == i, F.greatest(*of_family) if len(of_family) > 1 else of_family[0]).otherwise(chosen)
            return chosen

        return let(_pairs(tokens), shares)

    def judged(tokens: Column, probability: Column) -> Column:
        families = F.slice(probability, 2, classes - 1)

        def named(best: Column) -> Column:
            which = F.array_position(families, best).cast("int") - 1
            sure = (best >= model.least) & (confirmation(tokens, which) >= CONFIRMED)
            family = F.when(sure, names[which]).when(probability[0] < 0.5, F.lit(UNKNOWN))
            return F.struct(family.alias("family"), best.alias("probability"))

        return let(F.array_max(families), named)

    def scored(tokens: Column) -> Column:
        return let(known(_grams(tokens)), lambda f: let(chances(odds(f)), lambda q: judged(tokens, q)))

    def summed(p: Column, found: Column, telling: Column) -> Column:
        """One entry per family with its largest probability; ``unknown`` only if there is no other."""
        sure = F.array_distinct(F.transform(F.filter(found, lambda r: r["family"] != UNKNOWN), lambda r: r["family"]))
        maybe = F.when(telling & F.exists(found, lambda r: r["family"] == UNKNOWN), F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<string>"))

        def entry(name: Column) -> Column:
            most = F.array_max(F.transform(F.filter(found, lambda r: r["family"] == name), lambda r: r["probability"]))
            return F.struct(p.alias("paragraph"), name.alias("family"), most.alias("probability"))

        return F.transform(F.when(F.size(sure) > 0, sure).otherwise(maybe), entry)

    def one(p: Column) -> Column:
        def stretched(tokens: Column) -> Column:
            # No template has fewer than three pairs, so what is confirmed has two at least; what is unknown has a telling word.
            worth = p.rlike(TELLING) | (F.size(known(_pairs(tokens))) >= 2)
            runs = F.when(worth, _stretches(p, tokens)).otherwise(F.array().cast("array<array<string>>"))
            return let(F.transform(runs, scored), lambda found: summed(p, found, p.rlike(TELLING)))

        return let(_tokens(p), stretched)

    return F.flatten(F.transform(paragraphs(text), one))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, licenses`` per row; ``licenses`` as ``classified`` gives it.

    Null and blank texts have no paragraphs.  Repeated rows are judged each and alike.  An empty
    table gives an empty result; the model is then fitted on the templates alone.
    """
    model = fit(docs, text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.size(paragraphs(F.col(text_col))).cast("long").alias("n_paragraphs"), classified(F.col(text_col), model).alias("licenses")
    )
