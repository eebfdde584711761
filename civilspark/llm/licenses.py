"""Licence scan by a trained paragraph classifier.

A paragraph is a line.  Its features are the words and word pairs that occur in the
licence templates below; a multinomial logistic regression with an L1 penalty, trained
here, weighs them for each licence family and for ``unknown``.  Its probabilities are
calibrated by a temperature fitted on held-out paragraphs.  A prediction other than
``unknown`` that is likely enough is confirmed by comparison with the family's templates: the share
of a template's word pairs that occur in the paragraph.

Most lines never reach the classifier: a confirmed line shares at least ``SIMILARITY``
of some template's word pairs, so it holds one of the template's gate words, which are
chosen to touch more pairs than a confirmed line may miss.  The gate loses nothing.

Training data are the templates with words left out and with ordinary words around
them, and for ``unknown`` ordinary lines (at most ``ORDINARY_LINES`` of the scanned
table), lines of template words in random order and short cuts from templates.

Null and empty texts have no paragraphs.  Null ids pass through as null, repeated rows
are scanned as often as they come; an empty table gives an empty result.  Only the
named columns are used.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.session import materialise

UNKNOWN = "unknown"
SIMILARITY = 0.6
PROBABILITY = 0.5
ORDINARY_LINES = 1000
VARIANTS = 12
SEED = 3
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)

# Short notices by which works name their licence.
TEMPLATES = {
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL version 3.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
        " International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright to this work"
        " under CC0 1.0 Universal.",
        "Dedicated to the public domain under CC0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the"
        " terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 2.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted.",
        "Released under the ISC License.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL version 3.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
    ),
}
# Words too common in prose to make a gate.
PROSE = set(
    "a all and any are as be by for form free in is it may not of or person possible"
    " provided source subject terms that the this to use using with without work you"
    " can following conditions extent law author file files under version public".split()
)


def line_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def word_pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def gate_words() -> list[str]:
    """Words one of which every confirmable line holds.

    For each template, words are added until the pairs without any of them are fewer
    than the share a confirmed line must have.
    """
    chosen: set[str] = set()
    templates = [line_words(t) for group in TEMPLATES.values() for t in group]
    for words in templates:
        pairs = word_pairs(words)
        order = sorted(set(words), key=lambda w: (w not in chosen, w in PROSE, -len(w), w))
        for word in order:
            left = [p for p in pairs if not chosen.intersection(p.split())]
            if len(left) < SIMILARITY * len(pairs):
                break
            chosen.add(word)
    return sorted(chosen)


def _words(text: Column) -> Column:
    # other letters than a-z part words here as in line_words
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _grams(words: Column) -> Column:
    """Distinct words and neighbouring pairs."""
    pairs = F.when(
        F.size(words) > 1,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # the last one is unknown
    weights: tuple[tuple[str, tuple[float, ...]], ...]  # per gram, of the families
    biases: tuple[float, ...]
    temperature: float


def training_lines(ordinary: list[str]) -> list[tuple[str, str]]:
    """``(line, family)`` from the templates and ordinary lines; always the same."""
    rng = random.Random(SEED)
    prose = [w for line in ordinary for w in line_words(line)] or ["lorem", "ipsum", "dolor"]
    all_words = sorted({w for g in TEMPLATES.values() for t in g for w in line_words(t)})
    out = [(line, UNKNOWN) for line in ordinary]
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = line_words(template)
            out.append((template, family))
            for k in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.08 * (k % 3)] or words
                before, after = (rng.choices(prose, k=rng.randrange(0, 3 * k + 1)) for _ in "ab")
                out.append((" ".join([*before, *kept, *after]), family))
            for _ in range(VARIANTS // 2):
                cut = rng.randrange(len(words))
                some = words[cut : cut + max(1, len(words) // 5)]
                out.append((" ".join(rng.choices(prose, k=8) + some), UNKNOWN))
                out.append((" ".join(rng.sample(all_words, 8)), UNKNOWN))
    return out


def train(
    spark: SparkSession, docs: DataFrame, text: str = "text", lines: int = ORDINARY_LINES
) -> Classifier:
    """Fit weights, biases and the temperature."""
    gate = _gate()
    # A bounded sample: ordinary lines of the documents with the smallest text hashes.
    parts = 1_000_000
    share = -(-2 * lines * parts // max(1, docs.count()))
    heads = (
        docs.where(F.pmod(F.xxhash64(text), F.lit(parts)) < share)
        .select(F.substring(text, 1, 400).alias("text"))  # a sample needs no more
        .where("text is not null")
        .limit(4 * lines)
    )
    ordinary = [
        line
        for row in sorted(heads.collect())
        for line in row.text.split("\n")[:2]
        if line.strip() and not re.search(gate, line)
    ][:lines]
    families = (*sorted(TEMPLATES), UNKNOWN)
    rows = [
        (i % 4 == 0, line, float(families.index(family)))
        for i, (line, family) in enumerate(training_lines(ordinary))
    ]
    grams = sorted(
        {
            g
            for group in TEMPLATES.values()
            for t in group
            for g in {*line_words(t), *word_pairs(line_words(t))}
        }
    )
    vectors = CountVectorizerModel.from_vocabulary(grams, "grams", "features")
    vectors = vectors.setBinary(True)
    table = spark.createDataFrame(rows, "held boolean, line string, label double")
    table = vectors.transform(table.withColumn("grams", _grams(_words(F.col("line"))))).coalesce(1)
    table = table.cache()
    regression = LogisticRegression(
        family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=60
    )
    model = regression.fit(table.where("not held"))
    raw = model.transform(table.where("held")).select(
        vector_to_array("rawPrediction").alias("z"), F.col("label").cast("int").alias("k")
    )

    def loss(t: float) -> Column:
        scaled = F.transform("z", lambda z: z / t)
        top = F.array_max(scaled)
        total = F.aggregate(scaled, F.lit(0.0), lambda a, z: a + F.exp(z - top))
        return F.sum(F.log(total) + top - F.element_at(scaled, F.col("k") + 1))

    fits = raw.select(*[loss(t).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    table.unpersist()
    temperature = min(zip(fits, TEMPERATURES))[1]
    matrix = model.coefficientMatrix.toArray()
    weights = tuple(
        (gram, tuple(float(w) for w in matrix[:, i]))
        for i, gram in enumerate(grams)
        if matrix[:, i].any()
    )
    return Classifier(families, weights, tuple(map(float, model.interceptVector)), temperature)


def _gate() -> str:
    words = "|".join(gate_words())
    return rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"


def scan(
    spark: SparkSession,
    docs: DataFrame,
    model: Classifier,
    doc_id: str = "doc_id",
    text: str = "text",
    probability: float = PROBABILITY,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_id, paragraph, family, probability, similarity, line)`` of confirmed lines.

    ``paragraph`` numbers the lines of a text from 0.  The model and the template pairs
    have a few hundred rows and are broadcast; text is never shuffled.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the gate is sound from a similarity of {SIMILARITY}")
    gate = _gate()
    lines = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .where(F.col("text").rlike(gate))
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line"))
        .where(F.col("line").rlike(gate))
        .withColumn("grams", _grams(_words(F.col("line"))))
        .withColumn("row", F.xxhash64("line"))
    )
    lines = materialise(lines, "gated-lines")
    weights = spark.createDataFrame(list(model.weights), "gram string, w array<double>")
    k = len(model.families)
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)]
    pairs, totals = [], {}
    for family, templates in sorted(TEMPLATES.items()):
        for number, template in enumerate(templates):
            own = word_pairs(line_words(template))
            totals[family, number] = len(own)
            pairs += [(p, f"{family}#{number}", len(own)) for p in own]
    compare = spark.createDataFrame(pairs, "gram string, template string, size int")
    # Equal lines are judged once.
    distinct = lines.select("line", "row", "grams").groupBy("row", "line").agg(
        F.first("grams").alias("grams")
    )
    grams = distinct.select("row", "line", F.explode("grams").alias("gram"))
    scores = grams.join(F.broadcast(weights), "gram").groupBy("row", "line").agg(*sums)
    z = F.array(
        *[(F.col(f"s{i}") + F.lit(b)) / F.lit(model.temperature) for i, b in enumerate(model.biases)]
    )
    scores = scores.select("row", "line", z.alias("z"))
    top = F.array_max("z")
    shares = F.transform("z", lambda v: F.exp(v - top))
    shares = F.transform(shares, lambda v: v / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))
    best = F.array_position("z", top)
    names = F.array(*[F.lit(f) for f in model.families])
    judged = scores.select(
        "row",
        "line",
        F.element_at(names, best.cast("int")).alias("family"),
        F.element_at(shares, best.cast("int")).alias("probability"),
    ).where((F.col("family") != UNKNOWN) & (F.col("probability") >= probability))
    matched = (
        grams.join(F.broadcast(compare), "gram")
        .groupBy("row", "line", "template")
        .agg((F.count(F.lit(1)) / F.first("size")).alias("similarity"))
        .select(
            F.col("row").alias("m_row"),
            F.col("line").alias("m_line"),
            F.substring_index("template", "#", 1).alias("m_family"),
            "similarity",
        )
        .groupBy("m_row", "m_line", "m_family")
        .agg(F.max("similarity").alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
    confirmed = judged.join(
        matched,
        (F.col("row") == F.col("m_row"))
        & (F.col("line") == F.col("m_line"))
        & (F.col("family") == F.col("m_family")),
    ).select(
        F.col("row").alias("c_row"), F.col("line").alias("c_line"), "family", "probability", "similarity"
    )
    return lines.join(
        confirmed, (F.col("row") == F.col("c_row")) & (F.col("line") == F.col("c_line"))
    ).select("doc_id", "paragraph", "family", "probability", "similarity", "line")
