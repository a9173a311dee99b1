"""Licence scan: a trained paragraph classifier (DataFrame and SQL functions, Spark's own ML stages).

A paragraph is a block of lines that hold a word, up to a line without one.
Each of its lines is a passage, and so is each line joined with its next lines
as far as a notice wrapped from it can reach.  A passage becomes its lower-cased
words and word pairs, hashed into a sparse vector, and a multinomial logistic
regression names the licence family, or class 0, unknown.  It is fitted on the notices in
``NOTICES`` and variants of them, against a bounded sample of the corpus's own
paragraphs as unknown.  A held-out third of the variants and paragraphs calibrates it: the
temperature of least log loss turns scores into probabilities.  A family is
reported only if its probability reaches ``THRESHOLD`` and the passage holds
the word pairs of one of the family's notices to ``CONFIRM`` or more, and no
like notice of another family to more.  The GPL's grant reads alike in all its
versions and kinds, so a wrapped line may hold too little to tell: the kind or
version that the paragraph states names the family (``STATED_FAMILY``); a
grant without one counts as the family that the classifier gave it.  Passages without any word that such a
share needs (``needed``) can't be reported and aren't scored; the others are
scored from their first to their last word pair that some notice has.

Scanning is one pass; each document's findings are combined in the task that
reads it, so what is shuffled is about one small row a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, materialize, text_or_empty

# Customary notices of public licence families.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Apache License Version 2.0, January 2004",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 2-Clause License.",
        "Licensed under the BSD License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl-2.0": [
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Licensed under the MIT License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "This work is released under CC0 1.0 Universal, public domain dedication.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
# Licence-like sentences that grant nothing: unknown, whatever the corpus holds.
UNLICENSED = [
    "A driving license is required to operate this vehicle on public roads.",
    "The shop was licensed under the old rules of the city council.",
    "He asked for permission to use the software of the library for any purpose.",
    "The general public was free to use the library and to copy what it liked.",
    "The program is free of charge and open to any person without conditions.",
    "The software is provided as is, without warranty of any kind, express or implied.",
    "The rights of the author were reserved for the first version of the work.",
    "The license agreement was signed in January and may be terminated by either party.",
]
# The families that share one grant, by the kind or else the version that its paragraph states of the first general public licence.
STATED_FAMILY = {"lesser": "lgpl", "library": "lgpl", "affero": "agpl-3.0", "2": "gpl-2.0", "3": "gpl-3.0"}
SHARED_GRANT = ["gpl-2.0", "gpl-3.0"]
STATED = (r"(?i)(?:(lesser|library|affero)[^\p{L}\p{N}]+)?general[^\p{L}\p{N}]+public[^\p{L}\p{N}]+licen[cs]e"
          r"(?:(?:[^\p{L}\p{N}]+\p{L}+){0,10}?[^\p{L}\p{N}]+v(?:ersion)?[^\p{L}\p{N}]*([23])(?![\p{L}\p{N}]))?")
FAMILIES = ["unknown", *sorted(NOTICES)]
FEATURES = 1 << 15
SAMPLE = 6000       # paragraphs of the corpus that train and calibrate the unknown class, at most
THRESHOLD = 0.5
CONFIRM = 0.8
SEED = 23
BLANK = r"\n[^\p{L}\p{N}]*\n"  # between paragraphs: one or more lines without a word
# Tried last as words that a notice needs: plain prose has them too.
COMMON = frozenset("a any are be by for free in is it may no not of or part person program public that the this to under use with without work you".split())
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def notice_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


LONGEST = max(len(notice_words(t)) for texts in NOTICES.values() for t in texts)

PAIRS = sorted({f"{a} {b}" for texts in NOTICES.values() for w in map(notice_words, texts) for a, b in zip(w, w[1:])})


def word_pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def needed(confirm: float) -> list[str] | None:
    """Words of which every text has at least one that holds a share of ``confirm`` of some notice's word pairs; None if there are none."""
    out = set()
    for text in (t for texts in NOTICES.values() for t in texts):
        w = notice_words(text)
        size, left = len(w) - 1, set(zip(w, w[1:]))
        for word in sorted(set(w), key=lambda x: (x in COMMON, -len(x), x)):
            if len(left) / size < confirm:
                break
            out.add(word)
            left = {p for p in left if word not in p}
        if len(left) / size >= confirm:
            return None
    return sorted(out)


def _trimmed(w: Column) -> Column:
    """``w`` from its first to its last word pair that some notice has; empty without one."""
    known = F.array(*map(F.lit, PAIRS))
    pairs = word_pairs(w)

    def before(pairs: Column) -> Column:  # how many come before the first known one
        return F.array_position(pairs, F.try_element_at(F.array_intersect(pairs, known), F.lit(1))).cast("int") - 1

    def cut(pairs: Column) -> Column:
        skip = before(pairs)
        return F.slice(w, skip + 1, F.size(w) - skip - before(F.reverse(pairs)))

    return F.coalesce(F.element_at(F.transform(F.array(pairs), cut), 1), F.array().cast("array<string>"))


def _passages(lines: Column, hits: Callable[[Column], Column], trim: Callable[[Column], Column]) -> Column:
    """(last, start, words) of each line, and of each line joined with its next lines, where ``hits`` holds.

    A notice that begins in a line and goes on after it has at most ``LONGEST - 1``
    words on either side of the line's end, so a joined passage keeps no more.
    """
    reach = LONGEST - 1
    none = F.array().cast("array<int>")

    def after(i: Column, j: Column) -> Column:  # the words of lines i + 1 to j
        return F.flatten(F.slice(lines, i + 1, j - i))

    def passage(last: Column, start: Column, w: Column) -> Column:
        return F.struct(last.alias("last"), start.alias("start"), w.alias("words"))

    def of(i: Column) -> Column:
        first = F.element_at(lines, i)
        tail = F.slice(first, F.greatest(F.size(first) - reach + 1, F.lit(1)), F.lit(reach))
        last = F.least(i + reach, F.size(lines))
        ends = F.when(last > i, F.filter(F.sequence(i + 1, last), lambda j: F.size(after(i, j - 1)) < reach)).otherwise(none)
        joined = F.transform(ends, lambda j: passage(j, i, F.concat(tail, F.slice(after(i, j), 1, reach))))
        found = F.filter(F.concat(F.array(passage(i, i, first)), joined), lambda p: hits(p["words"]))
        return F.transform(found, lambda p: passage(p["last"], p["start"], trim(p["words"])))

    return F.when(F.size(lines) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(lines)), of)))


def passages(docs: DataFrame, id_col: str, text_col: str, confirm: float) -> DataFrame:
    """(doc_id, paragraph, first, n, stated, last, start, words): the passages to score of every paragraph.

    ``n`` is the paragraph's number of words, ``stated`` the kind or
    version that it states of a general public licence ('' if none), ``last``
    and ``start`` the passage's lines.  A paragraph without a passage to score has a row with no
    words; ``first`` marks one row a paragraph.
    """
    marks = needed(confirm)
    hits, trim = (lambda w: F.arrays_overlap(w, F.array(*map(F.lit, marks)))), _trimmed
    if marks is None:
        hits, trim = (lambda w: F.size(w) > 0), (lambda w: w)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    blocks = rows.select("doc_id", "row", F.posexplode(F.split("text", BLANK)).alias("k", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), words), lambda w: F.size(w) > 0)
    found = F.when(hits(words(F.col("block"))), F.element_at(F.transform(F.array(lines), lambda x: _passages(x, hits, trim)), 1))
    every = blocks.select("doc_id", F.struct("row", "k").alias("paragraph"), F.size(words(F.col("block"))).alias("n"),
                          F.coalesce(F.nullif(F.lower(F.regexp_extract("block", STATED, 1)), F.lit("")), F.regexp_extract("block", STATED, 2)).alias("stated"),
                          F.posexplode_outer(found).alias("i", "p"))
    return every.select("doc_id", "paragraph", (F.coalesce("i", F.lit(0)) == 0).alias("first"), "n", "stated", "p.last", "p.start",
                        F.coalesce("p.words", F.array().cast("array<string>")).alias("words"))


def _featured(df: DataFrame) -> DataFrame:
    """``df`` with its words' pairs and the hashed vector of both."""
    paired = NGram(n=2, inputCol="words", outputCol="pairs").transform(df)
    both = paired.withColumn("grams", F.concat("words", "pairs"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(both)


def confirmed(pairs: Column, family: Column, confirm: float) -> Column:
    """Whether ``pairs`` hold the share ``confirm`` of the word pairs of a notice of the family, and of its rivals no more.

    A notice's rivals are those of other families that hold this share of it themselves.
    """
    pairs_of = {f: [[f"{a} {b}" for a, b in zip(w, w[1:])] for w in map(notice_words, texts)] for f, texts in NOTICES.items()}
    lit = lambda n: F.array(*map(F.lit, n))
    held = lambda n: F.size(F.array_intersect(n, pairs)) / F.size(n)

    def notice(f: str, n: list[str]) -> Column:
        rivals = [r for g, ns in pairs_of.items() if g != f for r in ns if len({*n} & {*r}) / len(n) >= confirm]
        return F.struct(lit(n).alias("pairs"), F.array(*map(lit, rivals)).cast("array<array<string>>").alias("rivals"))

    every = F.create_map(*[x for f, ns in pairs_of.items() for x in (F.lit(f), F.array(*[notice(f, n) for n in ns]))])
    return F.exists(F.element_at(every, family), lambda n: (held(n["pairs"]) >= confirm) & F.forall(n["rivals"], lambda r: held(r) <= held(n["pairs"])))


def examples(docs: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(label, words, held): notices, notices without each one word, and notices amid words of the corpus; licence-like sentences and paragraphs as unknown."""
    spark = docs.sparkSession
    given = [(FAMILIES.index(f), t) for f, texts in NOTICES.items() for t in texts] + [(0, t) for t in UNLICENSED]
    notices = spark.createDataFrame(given, "label int, text string")
    notices = notices.select("label", words(F.col("text")).alias("words"))
    lines = docs.select(F.explode(F.split(text_or_empty(text_col), "\n")).alias("line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    known = F.array(*[F.lit(w) for w in ("licensed", "license", "licence", "copyright", "rights", "spdx")])
    drawn = first_by_hash(lines, sample, SEED, "line").select(words(F.col("line")).alias("words"))
    # nor are the lines that a notice is wrapped into unknown: half their word pairs, or their only word, are a notice's
    pairs, alone = word_pairs(F.col("words")), F.array(*map(F.lit, sorted({w for p in PAIRS for w in p.split()})))
    part = F.when(F.size("words") > 1, 2 * F.size(F.filter(pairs, lambda p: p.isin(PAIRS))) >= F.size("words") - 1)
    drawn = drawn.where(~F.arrays_overlap("words", known) & ~part.otherwise(F.arrays_overlap("words", alone)))
    drawn = materialize(drawn, "unknown-paragraphs")
    place = notices.select("label", "words", F.posexplode("words").alias("i", "w"))
    shorter = place.where(F.size("words") > 3).select(
        "label", F.concat(F.slice("words", F.lit(1), F.col("i")), F.slice("words", F.col("i") + 2, F.size("words"))).alias("words"))
    # without a word some notices are another family's
    shorter = shorter.join(F.broadcast(notices.select("words")), "words", "left_anti").select("label", "words")
    around = drawn.select(F.slice("words", 1, 6).alias("around"), F.xxhash64("words").alias("u")).orderBy("u", "around").limit(8)
    around = around.select("around", F.row_number().over(Window.orderBy("u", "around")).alias("k"))  # eight rows
    amid = (notices.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8)))).join(around, "k")
            .select("label", F.concat("around", "words", F.reverse("around")).alias("words")))
    drawn_from = shorter.unionByName(amid).unionByName(drawn.select(F.lit(0).alias("label"), "words"))
    third = F.pmod(F.xxhash64(F.lit(SEED + 1), "label", "words"), F.lit(3)) == 0
    every = notices.withColumn("held", F.lit(False)).unionByName(drawn_from.withColumn("held", third))
    return materialize(every, "licence-examples")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LogisticRegressionModel, float]:
    """The fitted model and its temperature."""
    rows = _featured(examples(docs, id_col, text_col, sample)).select("label", "features", "held")
    fit = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=1e-3, maxIter=60)
    model = fit.fit(rows.where(~F.col("held")))
    z = vector_to_array("rawPrediction")
    scored = model.transform(rows.where("held")).select("label", z.alias("z"))

    def loss(t: float) -> Column:
        top = F.array_max("z")
        return F.avg(F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - top) / t))) - (F.element_at("z", F.col("label") + 1) - top) / t)

    losses = scored.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    known = [(x, t) for x, t in zip(losses, TEMPERATURES) if x is not None]
    return model, (min(known)[1] if known else 1.0)


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
                 threshold: float = THRESHOLD, confirm: float = CONFIRM) -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, n_notices, families (sorted), licence, score.

    ``n_notices`` counts, family by family, the passages with a confirmed
    notice that share no line of the text.  ``licence`` is the family of the
    surest confirmed notice (ties to the later name; 'unknown' without one),
    ``score`` its probability (0.0 without one).  A null or empty text has no
    paragraphs; rows that share an id, or have none, stay apart.  An empty
    table gives an empty result.
    """
    model, t = train(docs, id_col, text_col, sample)
    scored = model.transform(_featured(passages(docs, id_col, text_col, confirm)))
    label = F.col("prediction").cast("int")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), label + 1)
    best = F.when((label > 0) & F.col("last").isNotNull(),
                  F.struct(family.alias("family"), vector_to_array("rawPrediction").alias("z"), "pairs"))
    named = scored.select("doc_id", "paragraph", "first", "n", "stated", "last", "start", best.alias("b"))
    probability = 1 / F.aggregate("b.z", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("b.z")) / t))
    sure = F.when(F.col("b").isNotNull(), (probability >= threshold) & confirmed(F.col("b.pairs"), F.col("b.family"), confirm))
    families = F.create_map(*[F.lit(x) for pair in STATED_FAMILY.items() for x in pair])
    stated = F.when(F.col("b.family").isin(SHARED_GRANT), F.try_element_at(families, F.col("stated")))
    notice = F.when(sure, F.struct(F.coalesce(stated, "b.family").alias("family"), "paragraph", "last", "start", F.round(probability, 6).alias("score")))
    found = named.select("paragraph.row", "doc_id", F.col("first") & (F.col("n") > 0), notice).toDF("row", "doc_id", "counts", "notice")
    every = found.groupBy("row", "doc_id").agg(F.count_if("counts").alias("n_paragraphs"), F.array_sort(F.collect_list("notice")).alias("notices"))
    top = F.array_max(F.transform("notices", lambda x: F.struct(x["score"].alias("score"), x["family"].alias("family"))))
    return every.select("doc_id", "n_paragraphs", _apart(F.col("notices")).alias("n_notices"),
                        F.array_sort(F.array_distinct("notices.family")).alias("families"),
                        F.coalesce(top["family"], F.lit("unknown")).alias("licence"), F.coalesce(top["score"], F.lit(0.0)).alias("score"))


def _apart(notices: Column) -> Column:
    """The most notices (in order of family, paragraph, last line) of which no two of a family share a line."""
    place = lambda x: F.struct(x["family"].alias("family"), x["paragraph"].alias("paragraph"))

    def step(s: Column, x: Column) -> Column:
        apart = s["at"].isNull() | (place(s["at"]) != place(x)) | (x["start"] > s["at"]["last"])
        return F.struct((s["n"] + apart.cast("bigint")).alias("n"), F.when(apart, x).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.try_element_at(F.slice(notices, 1, 0), F.lit(1)).alias("at"))  # no notice yet
    return F.aggregate(notices, start, step, lambda s: s["n"])
