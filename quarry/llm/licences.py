"""Licence scans: a trained paragraph classifier, confirmed by templates.

Lines are read one by one, long ones in overlapping windows, and joined: overlapping windows over a whole text
are searched for runs of lines (up to one without words) that hold a template together, so wrapped notices are
classified and confirmed whole. Sparse word n-grams feed a
multinomial logistic regression over licence families and an unknown class. It is trained on the
templates below, whole, in parts and in the company of corpus words, against a bounded sample of corpus
lines and shuffled templates. A held-back part calibrates the probability from which
a family is taken over unknown; a prediction stands if the paragraph holds enough of the
word pairs of one of the family's templates.

DataFrame and Spark ML functions only. No shuffle of documents: one map over all lines; only notices
found are shuffled. Lines and windows without any
telling template word are passed over first: too few of a template's pairs lie outside those words, so
none of them could be confirmed.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = 1 << 13
WINDOW = 64  # words of a window of a long line or of joined lines; windows overlap by half
CONFIRM = 0.6  # of a template's word pairs
SAMPLE_DOCS = 400  # documents, about, whose lines train the unknown class
SAMPLE_LINES = 4000
PARTS = 4  # partitions of the training rows, which are bounded
UNKNOWN = "unknown"
#: Licence families and sentences that state them (fixed values).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"),
]
#: Words that do not tell a template from other text.
PLAIN = ["a", "all", "and", "any", "are", "as", "at", "by", "can", "for", "has", "in", "is", "it", "not", "of", "or", "that", "the", "this", "to", "use", "via",
         "with", "you", "0", "1", "2", "3", "4", "v", "be", "on", "was", "from", "an"]


def words(text):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _run(w, n: int):
    """Word n-grams of an array of words."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def grams(w):
    return F.concat(w, _run(w, 2), _run(w, 3))


def paragraphs(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, paragraph, last, words, t, f, p): lines with words, long ones in windows, numbered from 0; and, with
    a template's number, family and pairs, all runs of lines of a window that hold it, none of whose
    lines alone does unless it is the only one. ``last`` is the last line."""
    line = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x, i: F.struct(i.alias("paragraph"), words(x).alias("w"))), lambda x: F.size(x["w"]) > 0)
    lines = docs.where("text is not null").select(name, F.xxhash64("text").alias("text_hash"), F.explode(F.array(line)).alias("line"))
    step = WINDOW // 2
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - step), F.lit(step))
    one = F.flatten(F.transform("line", lambda x: F.transform(starts(x["w"]), lambda s: F.struct(
        x["paragraph"].alias("paragraph"), F.slice(x["w"], s, WINDOW).alias("w"), F.lit(None).cast("array<int>").alias("of")))))
    flat, of = F.flatten("line.w"), F.flatten(F.transform("line", lambda x: F.array_repeat(x["paragraph"], F.size(x["w"]))))
    lines = lines.select("*", F.explode(F.array(F.struct(flat.alias("w"), of.alias("of")))).alias("whole"))
    joined = F.transform(starts(F.col("whole.w")), lambda s: F.struct(
        F.lit(0).alias("paragraph"), F.slice("whole.w", s, WINDOW).alias("w"), F.slice("whole.of", s, WINDOW).alias("of")))
    joined = F.when(F.size("line") > 1, F.filter(joined, lambda x: F.element_at(x["of"], 1) < F.element_at(x["of"], -1))).otherwise(F.slice(joined, 1, 0))
    telling = F.array(*[F.lit(x) for x in telling_words()])
    kept = F.filter(F.concat(one, joined), lambda x: F.arrays_overlap(x["w"], telling))
    kept = F.transform(kept, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["w"].alias("w"), x["of"].alias("of"), F.when(x["of"].isNotNull(), pairs_of(x["w"])).alias("pairs")))
    rows = lines.select(name, "text_hash", F.explode(kept).alias("x")).select(name, "text_hash", "x.*")
    held = F.filter(_templates(), lambda t: _share(F.col("pairs"), t["p"]) >= CONFIRM)
    alone = F.array(F.struct(F.lit(None).cast("int").alias("t"), F.lit(None).cast("string").alias("f"), F.lit(None).cast("array<string>").alias("p")))
    rows = rows.select("*", F.explode(F.when(F.col("of").isNull(), alone).otherwise(held)).alias("known")).select("*", "known.*")
    number = F.array_distinct("of")
    each = F.transform(number, lambda n: F.slice("w", F.array_position("of", n).cast("int"), F.size(F.filter("of", lambda v: v == n))))
    alone = F.struct(F.array("paragraph").alias("number"), F.array("w").alias("each"), F.array(F.lit(0.0)).alias("share"))
    parts = F.struct(number.alias("number"), each.alias("each"), F.transform(each, lambda w: _share(pairs_of(w), F.col("p"))).alias("share"))
    rows = rows.select("*", F.explode(F.array(F.when(F.col("t").isNull(), alone).otherwise(parts))).alias("part")).select(name, "text_hash", "t", "f", "p", "part.*")
    all_of = F.sequence(F.lit(1), F.size("number"))
    at = lambda i: F.element_at("number", i)
    ends = lambda i: F.filter(all_of, lambda j: (j >= i) & (at(j) - at(i) == j - i) & ((j == i) | (F.array_max(F.slice("share", i, F.greatest(j - i, F.lit(0)) + 1)) < CONFIRM)))
    runs = F.flatten(F.transform(all_of, lambda i: F.transform(ends(i), lambda j: F.struct(
        at(i).alias("paragraph"), at(j).alias("last"), F.flatten(F.slice("each", i, j - i + 1)).alias("words")))))
    rows = rows.select(name, "text_hash", "t", "f", "p", F.explode(runs).alias("run")).select(name, "text_hash", "run.*", "t", "f", "p")
    return rows.where(F.col("t").isNull() | (_share(pairs_of(F.col("words")), F.col("p")) >= CONFIRM))


def telling_words() -> list[str]:
    import re

    found = {w for _, t in TEMPLATES for w in re.findall(r"\w+", t.lower())}
    return sorted(found - set(PLAIN))


def _pairs(text: str) -> list[str]:
    import re

    w = re.findall(r"\w+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _templates():
    """All templates' numbers, families and word pairs, one array literal, so expressions stay small."""
    return F.array(*[F.struct(F.lit(i).alias("t"), F.lit(f).alias("f"), F.array(*[F.lit(p) for p in _pairs(t)]).alias("p")) for i, (f, t) in enumerate(TEMPLATES)])


def _share(pairs, known):
    return F.size(F.array_intersect(pairs, known)) / F.size(known)


def similarity(pairs, family=None):
    """The largest share of the word pairs of a template (of ``family``, if given) that an array of distinct pairs holds."""
    known = _templates()
    if family is not None:
        known = F.filter(known, lambda x: x["f"] == family)
    return F.array_max(F.transform(known, lambda x: _share(pairs, x["p"])))


def pairs_of(w):
    return F.array_distinct(_run(w, 2))


def training_rows(docs: DataFrame) -> DataFrame:
    """(family, words, fold): templates whole, cut and among corpus words; corpus lines and templates turned round as unknown."""
    spark = docs.sparkSession
    known = spark.createDataFrame(TEMPLATES, "family string, text string").select("family", words(F.col("text")).alias("w"))
    many = max(1, docs.count())
    u = F.pmod(F.xxhash64("text", F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    lines = docs.where(F.col("text").isNotNull()).where(u < min(1.0, SAMPLE_DOCS / many)).select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    lines = lines.select(F.slice(words(F.col("line")), 1, WINDOW).alias("w")).where("size(w) > 0").groupBy("w").agg(F.xxhash64("w").alias("h")).orderBy("h").limit(SAMPLE_LINES)
    plain = lines.withColumn("pairs", pairs_of(F.col("w"))).where(similarity(F.col("pairs")) < 0.3).select("w", "h")
    few = plain.orderBy("h").limit(60).select(F.col("w").alias("near"), "h")
    forms = known.select("family", F.explode(F.array(
        F.col("w"), F.slice("w", 1, F.ceil(F.size("w") * 0.8).cast("int")),
        F.slice("w", F.greatest(F.lit(1), F.floor(F.size("w") * 0.2).cast("int")), F.size("w")))).alias("w"))
    mixed = forms.join(F.broadcast(few), F.pmod(F.xxhash64("family", "w"), F.lit(5)) == F.pmod(F.col("h"), F.lit(5))).select(
        "family", F.explode(F.array(F.concat(F.slice("near", 1, 20), "w"), F.concat("w", F.slice("near", 1, 20)), F.concat(F.slice("near", 1, 8), "w", F.slice("near", 9, 8)))).alias("w"))
    turned = known.select(F.lit(UNKNOWN).alias("family"), F.explode(F.array(F.reverse("w"), F.array_sort("w"), F.array_distinct(F.filter("w", lambda x: F.array_contains(F.array(*[F.lit(p) for p in PLAIN]), x))))).alias("w")).where("size(w) > 0")
    rows = known.select("family", "w").unionByName(forms).unionByName(mixed).unionByName(plain.select(F.lit(UNKNOWN).alias("family"), "w")).unionByName(turned)
    return rows.select("family", F.col("w").alias("words"), F.pmod(F.xxhash64("w"), F.lit(4)).alias("fold"))


class Scanner:
    """The fitted classifier, its families by index, and the calibrated least probability."""

    def __init__(self, docs: DataFrame):
        rows = training_rows(docs).withColumn("features_in", grams(F.col("words"))).coalesce(PARTS).cache()
        names = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
        index = F.coalesce(*[F.when(F.col("family") == f, F.lit(float(i))) for i, f in enumerate(names)])
        rows = rows.withColumn("label", index)
        self.names = names
        self.pipe = Pipeline(stages=[
            HashingTF(inputCol="features_in", outputCol="features", numFeatures=FEATURES, binary=True),
            LogisticRegression(family="multinomial", regParam=2e-4, maxIter=40, probabilityCol="probability", rawPredictionCol="raw", predictionCol="best"),
        ]).fit(rows.where((F.col("fold") > 0) | (F.col("family") != UNKNOWN)))
        held = self._apply(rows.where((F.col("fold") == 0) & (F.col("family") == UNKNOWN)).drop("features_in"))
        q = held.agg(F.max("p_best").alias("q")).first()["q"]
        self.least = min(0.95, max(0.5, float(q or 0)))
        rows.unpersist()

    def _apply(self, rows: DataFrame) -> DataFrame:
        """Rows with the likeliest family but unknown, ``family_best``, and its probability ``p_best``."""
        out = self.pipe.transform(rows.withColumn("features_in", grams(F.col("words"))))
        p = F.slice(vector_to_array("probability"), 1, len(self.names) - 1)
        top = F.array_max(p)
        return out.withColumn("p_best", top).withColumn("family_best", F.array(*[F.lit(n) for n in self.names])[F.array_position(p, top).cast("int") - 1]).drop(
            "features_in", "features", "raw", "probability", "best")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity): lines, or first lines of notices wrapped over several lines, of ``docs``
    (doc_id, text) that the classifier gives a licence family with at least the calibrated probability and a template confirms, once
    per line and family (its best window). Others are unknown and give no row. Null and empty texts give none; rows of equal doc_id are merged.
    Of runs that share lines and a template, a single line goes first, then the one that holds most of it in the fewest words.
    """
    s = Scanner(docs)
    found = s._apply(paragraphs(docs)).where(F.col("p_best") >= s.least)
    found = found.withColumn("pairs", pairs_of(F.col("words")))
    held = F.when(F.col("t").isNull(), similarity(F.col("pairs"), F.col("family_best"))).when(F.col("f") == F.col("family_best"), _share(F.col("pairs"), F.col("p")))
    found = found.withColumn("similarity", held).where(F.col("similarity") >= CONFIRM)
    found = found.withColumn("rank", F.struct((F.col("last") == F.col("paragraph")).alias("one"), "similarity", (-F.size("words")).alias("short"), (-F.col("paragraph")).alias("early")))
    near = Window.partitionBy("doc_id", "text_hash", "t").orderBy("paragraph").rangeBetween(-WINDOW, WINDOW)
    found = found.drop("words", "pairs", "p").withColumn("near", F.collect_set(F.struct("paragraph", "last", "rank")).over(near))
    beaten = F.exists("near", lambda o: (o["paragraph"] <= F.col("last")) & (o["last"] >= F.col("paragraph")) & (o["rank"] > F.col("rank")))
    found = found.where(F.col("t").isNull() | ((F.col("last") > F.col("paragraph")) & ~beaten))
    return found.groupBy("doc_id", "paragraph", F.col("family_best").alias("family")).agg(F.max("p_best").alias("probability"), F.max("similarity").alias("similarity"))
