"""Licence scan: a trained paragraph classifier with an unknown class and template confirmation.

A paragraph is a line, or a run of adjacent lines without a blank one (one without letters and digits), so
notices may be wrapped at any width.
1. Every line of every text is scored by a logistic model on single words; its door lies under all
   held-out slices of licence notices, so it passes on far more than licences.
2. Lines that pass, lines with a cue word and the runs of lines around them are described by word 1-, 2-
   and 3-grams over a sparse vocabulary, that of the licence templates.  Multinomial logistic regression,
   trained on slices of the templates, on non-licence sentences and on a bounded sample of corpus lines,
   gives each family a probability.  The threshold under which a paragraph is `unknown` is calibrated on
   held-out slices and on families that took no part in the training.
3. A predicted family is confirmed by how much of one of its templates the paragraph contains.
All of it runs as DataFrame operations and Spark's own JVM learner."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import keep_probable, least_hashes, materialise

#: Notices by which licences are usually granted, by family.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. This work is dedicated to the public domain."),
    ("proprietary", "All rights reserved."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied."),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed."),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("mit", "SPDX: MIT"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("proprietary", "Copyright holder. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
]
#: Sentences with cue words that grant nothing.
NON_LICENCES = [
    "He lost his driving licence last week.", "A fishing license is needed at the lake.", "The permission of the owner was asked for.",
    "Copyright law differs between countries.", "She has the right to ask for a copy.", "The licensed plumber came at noon.",
    "The commission released its report on public rights.", "The software is distributed by a reseller.", "They reserved a table for four.",
    "The source of the river is in the hills.", "The public was asked for permission to redistribute seats.", "Our license server is down today.",
]
#: Fixed value: a paragraph with one of these is listed even if no licence is recognised in it.
CUES = r"(?i)licen[cs]e|copyright|all rights|permission is|redistribut|public domain|free software|creative commons"

#: The same across line ends and comment signs.
SPREAD = CUES.replace(" ", r"[^\p{L}\p{N}]+")

NONE, UNKNOWN = "none", "unknown"
CORPUS_SAMPLE = 500  # lines of the corpus that train the class `none`
LEAST_WORDS = 2  # of a line that is listed for its probability alone
HELD_OUT = 4  # every so many families take no part in the training that calibrates the threshold
CONFIRM = 0.6


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits, with dots and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def ngrams(words: Column, least: int = 1, most: int = 3) -> Column:
    """All n-grams of a word array for n in least..most, joined by blanks."""
    def of(n):
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, f, t) for k, (f, t) in enumerate(TEMPLATES)], "k int, family string, template string").coalesce(1)
    return rows.withColumn("w", words_of(F.col("template")))


def grams(w: Column) -> Column:
    """Distinct 3-grams of a word array; of fewer words, all of them as one."""
    return F.array_distinct(F.when(F.size(w) >= 3, ngrams(w, 3, 3)).otherwise(F.array(F.array_join(w, " "))))


def every_gram(w: Column) -> Column:
    """What a template's grams() may be found in."""
    return F.concat(grams(w), w, ngrams(w, 2, 2))


def alike(held: Column, wanted: list[str]) -> Column:
    """Share of the grams `wanted` that are among `held`."""
    return F.size(F.array_intersect(held, F.array(*map(F.lit, wanted)))) / F.lit(len(wanted))


def _grams(spark: SparkSession) -> list[dict]:
    """family, n (words) and g (grams) of each template."""
    return [r.asDict() for r in _templates(spark).select("family", F.size("w").alias("n"), grams(F.col("w")).alias("g")).collect()]


class Classifier:
    """Vocabulary, regression model, class names and the calibrated threshold; the word model and its door."""

    def __init__(self, vocabulary, model, classes, threshold, words=None, word_model=None, door=0.0):
        self.vocabulary, self.model, self.classes, self.threshold = vocabulary, model, classes, threshold
        self.words, self.word_model, self.door = words, word_model, door

    def passed(self, rows: DataFrame) -> DataFrame:
        """rows (with `w`) and `passed`: whether the words of a line may be those of a licence."""
        out = self.word_model.transform(self.words.transform(rows))
        return out.withColumn("passed", (vector_to_array("probability")[1] >= self.door) & (F.size("w") >= LEAST_WORDS)).drop("single", "rawPrediction", "probability", "prediction")

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows (with `w`) and `family`, the likeliest class, and `probability`, its share."""
        out = self.model.transform(self.vocabulary.transform(rows.withColumn("_g", ngrams(F.col("w")))))
        p = vector_to_array("probability")
        names = F.array(*map(F.lit, self.classes))
        return out.withColumn("_p", p).withColumn("probability", F.array_max("_p")).withColumn("family", F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int"))).drop("_g", "features", "rawPrediction", "prediction", "_p")


def train(docs: DataFrame, text_col: str = "text", sample: int = CORPUS_SAMPLE) -> Classifier:
    """Fit on template slices and negatives; docs give at most `sample` lines, those of least hash."""
    spark = docs.sparkSession
    templates = _templates(spark)
    known = sorted(r[0] for r in templates.select(F.explode(F.array_distinct(ngrams(F.col("w")))).alias("g")).distinct().collect())
    known_words = {r[0] for r in templates.select(F.explode("w")).distinct().collect()}
    vocabulary = CountVectorizerModel.from_vocabulary(known, inputCol="_g", outputCol="features", minTF=1.0).setBinary(True)
    # slices without up to a quarter of the words at either end, and between words of the corpus
    n = F.size("w")
    cut = F.explode(F.sequence(F.lit(0), (n / 4).cast("int")))
    slices = templates.withColumn("a", cut).withColumn("b", cut).where("a + b <= size(w) / 4").select(F.col("family").alias("label_name"), F.slice("w", F.col("a") + 1, n - F.col("a") - F.col("b")).alias("w"))
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).where(F.length("line") > 20)
    lines = materialise(least_hashes(lines.select("line", F.xxhash64("line").alias("h")), "h", sample, lines.count()).withColumn("w", words_of(F.col("line"))), "license-lines")
    # lines of the sample that hold a notice are no negatives
    held = F.greatest(*(alike(F.col("held"), t["g"]) for t in _grams(spark)))
    corpus = lines.withColumn("held", every_gram(F.col("w"))).where((held < CONFIRM / 2) & ~F.col("line").rlike(CUES)).select(F.lit(NONE).alias("label_name"), "w")
    other = spark.createDataFrame([(NONE, t) for t in NON_LICENCES], "label_name string, t string").coalesce(1).select("label_name", words_of(F.col("t")).alias("w"))
    data = slices.unionByName(corpus).unionByName(other)
    families = sorted({f for f, _ in TEMPLATES})
    classes = sorted([*families, NONE])
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("label_name")).cast("double") - 1
    data = data.select("label_name", "w", label.alias("label"), F.pmod(F.xxhash64("label_name", "w"), F.lit(4)).alias("fold"), F.array_contains(F.array(*map(F.lit, families[::HELD_OUT])), F.col("label_name")).alias("away"))
    # families weigh the same, whatever their number of slices
    size = data.groupBy("label").agg((1.0 / F.count("*")).alias("weight"))
    data = materialise(data.join(F.broadcast(size), "label").coalesce(1).sort("label", "w"), "license-train")
    vectors = vocabulary.transform(data.withColumn("_g", ngrams(F.col("w"))))
    learner = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, weightCol="weight", featuresCol="features", labelCol="label")
    half = Classifier(vocabulary, learner.fit(vectors.where("fold <> 0 and not away")), classes, 0.0)
    held = half.probabilities(data.where("fold = 0 or away"))
    # the threshold lies above 99 % of what is wrong and not above 5 % of what is right
    wrong = F.percentile_approx(F.when((F.col("family") != NONE) & (F.col("family") != F.col("label_name")), F.col("probability")), 0.99)
    right = F.percentile_approx(F.when((F.col("family") != NONE) & (F.col("family") == F.col("label_name")), F.col("probability")), 0.05)
    low, high = held.agg(wrong, right).first()
    threshold = max(0.5, min(low if low is not None else 0.5, high if high is not None else 0.5))
    # the word model: licence or not, from single words; halves of notices stand for wrapped lines
    single = CountVectorizerModel.from_vocabulary(sorted(known_words), inputCol="w", outputCol="single", minTF=1.0).setBinary(True)
    part = lambda a, b: F.slice("w", a, b)
    middle = F.greatest((F.size("w") / 2).cast("int"), F.lit(1))
    notices = data.where(F.col("label_name") != NONE)
    halves = notices.select(F.explode(F.array(F.col("w"), part(F.lit(1), middle), part(middle + 1, F.size("w")))).alias("w")).where(F.size("w") >= LEAST_WORDS)
    yes_no = halves.distinct().select("w", F.lit(1.0).alias("label")).unionByName(data.where(F.col("label_name") == NONE).select("w", F.lit(0.0).alias("label")))
    yes_no = materialise(yes_no.withColumn("fold", F.pmod(F.xxhash64("w"), F.lit(4))).coalesce(1).sort("label", "w"), "license-words")
    word_learner = LogisticRegression(regParam=1e-3, maxIter=60, featuresCol="single", labelCol="label")
    half = word_learner.fit(single.transform(yes_no.where("fold <> 0")))
    lowest = half.transform(single.transform(yes_no.where("fold = 0 and label = 1"))).agg(F.min(vector_to_array("probability")[1])).first()[0]
    door = min(0.5, lowest if lowest is not None else 0.5)
    return Classifier(vocabulary, learner.fit(vectors), classes, threshold, single, word_learner.fit(single.transform(yes_no)), door)


def _paragraphs(docs: DataFrame, id_col: str, text_col: str, longest: int, wanted: Column, share, classifier: Classifier) -> DataFrame:
    """(key, block, id, a, b, base, passed, w): lines a..b of a document's block.  base marks lines with a
    cue, and pairs of lines that hold one only together; passed marks lines that the word model lets
    through; the others are runs of lines that hold enough of some template: share() of those of their grams
    that are among `wanted`.

    Every line of every text is scored; texts without any that passes and without a cue then leave.

    Runs end where the lines between the first and the last have half as many words again as the longest
    template, so each line starts a bounded number of them, and each occurrence of a template is in one."""
    most = longest + longest // 2
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("digest")).where("t is not null")
    # the cue is looked for once a text, below the explode
    scored = texts.withColumn("cue", F.col("t").rlike(SPREAD)).select("digest", "cue", F.explode(F.split("t", "\n")).alias("line")).withColumn("w", words_of(F.col("line")))
    some = materialise(classifier.passed(scored).where("cue or passed").select("digest").distinct(), "license-texts")
    texts = keep_probable(texts, "digest", some, some.count()).join(some, "digest", "left_semi")
    texts = materialise(texts.withColumn("key", F.monotonically_increasing_id()), "license-docs")
    lines = texts.select("key", "id", F.posexplode(F.split("t", "\n")).alias("a", "line")).withColumn("blank", ~F.col("line").rlike(r"[\p{L}\p{N}]"))
    lines = classifier.passed(lines.withColumn("w", words_of(F.col("line")))).withColumn("n", F.size("w")).drop("w")
    doc = Window.partitionBy("key").orderBy("a")
    lines = lines.withColumn("block", F.sum(F.col("blank").cast("int")).over(doc)).where("not blank").drop("blank")
    run = Window.partitionBy("key", "block").orderBy("a")
    lines = lines.withColumn("next", F.coalesce(F.lead("line").over(run), F.lit(""))).withColumn("cue", F.col("passed") | F.concat_ws(" ", "line", "next").rlike(SPREAD))
    # lines within `most` words of a line with a cue, forward or back
    lines = lines.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
    later, earlier = run.rowsBetween(0, Window.unboundedFollowing), run.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("reach", F.coalesce(F.min(F.when(F.col("cue"), F.col("before"))).over(later) < F.col("upto") + most, F.lit(False)))
    lines = lines.withColumn("behind", F.coalesce(F.max(F.when(F.col("cue"), F.col("upto"))).over(earlier) + most > F.col("before"), F.lit(False)))
    lines = lines.where("reach or behind")
    lines = lines.withColumn("ahead", F.collect_list(F.struct("a", "line", "before")).over(run.rowsBetween(0, most + 1))).where("reach")
    lines = lines.withColumn("ahead", F.filter("ahead", lambda x: (x.before < F.col("upto") + most)))
    joined = lambda last: F.array_join(F.transform(F.slice("ahead", 1, last), lambda x: x.line), " ")
    split = F.concat_ws(" ", "line", "next").rlike(SPREAD) & ~F.col("line").rlike(SPREAD) & ~F.col("next").rlike(SPREAD)
    base = F.when(F.col("line").rlike(CUES), 1).when(split, 2).when(F.col("passed"), 1)
    whole = lines.withColumn("base_size", base).withColumn("w", F.when(F.size("ahead") > 1, words_of(joined(F.size("ahead")))).otherwise(F.array().cast("array<string>")))
    # each in a projection of its own, so that the grams are made once a line and not once a template
    whole = whole.withColumn("held", every_gram(F.col("w"))).withColumn("held", F.array_intersect("held", wanted))
    runs = F.when(F.when(F.size("held") > 0, share(F.col("held"))).otherwise(0.0) >= CONFIRM, F.sequence(F.lit(1), F.size("ahead"))).otherwise(F.array().cast("array<int>"))
    sizes = F.array_distinct(F.concat(F.filter(F.array("base_size"), lambda x: x.isNotNull()), runs))
    each = whole.withColumn("size", F.explode(sizes)).withColumn("text", joined(F.col("size")))
    each = each.withColumn("cued", F.col("text").rlike(SPREAD)).withColumn("w", words_of(F.col("text")))
    first = F.coalesce(F.col("size") == F.col("base_size"), F.lit(False))
    return each.select("key", "block", "id", "a", F.element_at("ahead", F.col("size")).a.alias("b"), (first & F.col("cued")).alias("base"), (first & F.col("passed") & (F.col("size") == 1)).alias("passed"), "w")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """Each paragraph that is taken for a licence or has a cue word: id_col, paragraph (number of its first line from 0), family or
    `unknown`, probability, similarity (share of the closest template's 3-grams, or of all its words for
    shorter ones, that the paragraph contains) and confirmed.

    A notice wrapped over adjacent lines is one row.  Of confirmed paragraphs that overlap, the one that
    holds most 3-grams of a template is given, and of equal ones that of fewest lines.  Outside all of them,
    `unknown` are lines with a cue, and lines that are likely some licence but not confirmed by a
    template.  Null and empty texts and empty tables give no rows;
    null and repeated ids keep their rows; other columns are ignored."""
    classifier = classifier or train(docs, text_col)
    templates = _grams(docs.sparkSession)
    wanted = F.array(*map(F.lit, sorted({g for t in templates for g in t["g"]})))
    rows = _paragraphs(docs, id_col, text_col, max(t["n"] for t in templates), wanted, lambda held: F.greatest(*(alike(held, t["g"]) for t in templates)), classifier)
    scored = classifier.probabilities(materialise(rows, "license-lines")).withColumn("_all", every_gram(F.col("w"))).withColumn("_all", F.array_intersect("_all", wanted))
    similarity, held = F.lit(0.0), F.lit(0.0)
    for family in {t["family"]: None for t in templates}:
        each = [(alike(F.col("_all"), t["g"]), len(t["g"])) for t in templates if t["family"] == family]
        similarity = F.when(F.col("family") == family, F.greatest(F.lit(0.0), *(x for x, _ in each))).otherwise(similarity)
        held = F.when(F.col("family") == family, F.greatest(F.lit(0.0), *(F.when(x >= CONFIRM, x * n) for x, n in each))).otherwise(held)
    scored = scored.withColumn("similarity", similarity).withColumn("held", F.round(held))
    likely = (F.col("family") != NONE) & (F.col("probability") >= classifier.threshold)
    scored = scored.withColumn("sure", likely & (F.col("similarity") >= CONFIRM)).withColumn("base", F.col("base") | (F.col("passed") & likely)).where("sure or base")
    row = F.struct((-F.col("held")).alias("rank"), (F.col("b") - F.col("a")).alias("more"), "a", "b", "family", "probability", "similarity", "sure", "base")
    block = scored.groupBy("key", "block").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(row)).alias("rows"))
    apart = lambda some, x: ~F.exists(some, lambda p: (p.a <= x.b) & (x.a <= p.b))
    picked = F.aggregate(F.filter("rows", lambda x: x.sure), F.filter("rows", lambda x: F.lit(False)), lambda some, x: F.when(apart(some, x), F.concat(some, F.array(x))).otherwise(some))
    block = block.withColumn("picked", picked)
    block = block.withColumn("left", F.filter("rows", lambda x: x.base & apart(F.col("picked"), x)))
    out = block.select("id", F.explode(F.concat("picked", "left")).alias("x")).select("id", "x.*")
    return out.select(F.col("id").alias(id_col), F.col("a").alias("paragraph"), F.when(F.col("sure"), F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", F.col("sure").alias("confirmed"))
