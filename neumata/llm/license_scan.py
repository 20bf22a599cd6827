"""License scans: which licence families a text's paragraphs name, in DataFrame operations alone.

A sparse logistic regression over word 1- and 2-grams, one class a family and one for the unknown, is trained on variants of
the notices below against all of the corpus' own paragraphs that are scored at all and against hard negatives: notices without
the family's name, and notices that are denied. A paragraph whose best family stays under the calibrated threshold is unknown; the others must be
confirmed by a template of that family, of all of whose grams the paragraph has to hold a large share.

A paragraph is one line or up to MAX_LINES lines that follow each other without a blank one between (one without letters
and digits, so marks of comments do not matter); one that holds a smaller paragraph with a notice is left out, and
paragraphs of one family that overlap are one notice. Only paragraphs with one of the words without which no template can
be confirmed are scored, which leaves none out.

Null and empty texts, and texts without a known notice, have no families. Lines of any length are taken whole. Texts that
share an id are scanned each and reported together, equal ones once; a null id counts as an id. Other columns are not
read. Of equally likely families the last by name is taken. An empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, documents

# Short notices of each family.
NOTICES = {
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Licensed under the Mozilla Public License 2.0.", "Released under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "public-domain": ("This work is released into the public domain.", "This is free and unencumbered software released into the public domain.", "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
}
# Words that name a family, and words that a denial stands before.
NAMES = {"AGPL": ("affero", "agpl"), "Apache-2.0": ("apache",), "BSD": ("bsd",), "CC-BY": ("cc", "creative", "commons"), "CC-BY-NC": ("cc", "creative", "commons"), "CC-BY-SA": ("cc", "creative", "commons"), "GPL": ("gnu", "general", "gpl"), "LGPL": ("lesser", "lgpl"), "MIT": ("mit",), "MPL-2.0": ("mozilla", "mpl"), "public-domain": ("public", "domain", "cc0")}
DENIED = ("licensed", "released", "granted", "permitted", "governed", "subject")
FAMILIES = tuple(NOTICES)
#: Variants of each notice; share of a template's grams to confirm; share of the unknown class that the threshold lets pass; lines of a paragraph at most.
VARIANTS, CONFIRM, FALSE_RATE, MAX_LINES = 40, 0.6, 0.0005, 4
#: Words of a neighbouring line; strength of the penalty that keeps weights sparse; rounds of the regression at most.
LINE_WORDS, SPARSE, ROUNDS = 12, 5e-5, 60
WORD = r"[\p{L}\p{N}]"


def grams_of(text: Column) -> Column:
    """Distinct lower-case words and pairs of neighbouring words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def own_grams(text: str) -> list[str]:
    """The same in Python, for the notices."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def neighbours(docs: DataFrame, only: str = WORD) -> DataFrame:
    """doc_id, key (a hash of the text), at, l0 to l6: each lower-case line in which `only` is found, as l3, with the three before and after it, null beyond the text."""
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("key"), F.lower("text").alias("text")).where(F.col("text").rlike(only))
    lines, none, reach = F.split("text", "\n", -1), F.lit(None).cast("string"), MAX_LINES - 1
    shifted = [F.concat(F.array_repeat(none, -k), lines) if k < 0 else F.slice(lines, k + 1, F.length("text") + 1) for k in range(-reach, reach + 1)]
    zipped = F.transform(F.arrays_zip(*(x.alias(f"l{k}") for k, x in enumerate(shifted))), lambda z, i: F.struct(i.alias("at"), *(z[f"l{k}"].alias(f"l{k}") for k in range(2 * reach + 1))))
    met = F.filter(zipped, lambda z: z[f"l{reach}"].rlike(only))
    return rows.select("doc_id", "key", F.explode(met).alias("z")).select("doc_id", "key", "z.*")


def paragraphs(docs: DataFrame, only: str = WORD) -> DataFrame:
    """doc_id, key, at (number of the first line), size (lines), para: the paragraphs in which `only` (a pattern of words within a line) is found."""
    reach = MAX_LINES - 1
    line = [F.col(f"l{k}") for k in range(2 * reach + 1)]
    spans = []
    for first in range(reach, -1, -1):
        for size in range(reach - first + 1, MAX_LINES + 1):
            holds = F.lit(True)
            for k in range(first, first + size):  # earlier lines with such a word have this paragraph already
                holds = holds & F.coalesce(line[k].rlike(WORD), F.lit(False)) & (~line[k].rlike(only) if k < reach else F.lit(True))
            spans.append(F.when(holds, F.struct((F.col("at") - (reach - first)).alias("at"), F.lit(size).alias("size"), F.concat_ws(" ", *line[first : first + size]).alias("para"))))
    spans = F.filter(F.array(*spans), lambda x: x.isNotNull())
    return neighbours(docs, only).select("doc_id", "key", F.explode(spans).alias("p")).select("doc_id", "key", "p.*")


def needed(often: dict[str, int], confirm: float = CONFIRM) -> list[str]:
    """Words of which a text must hold one for any template to be confirmed: of each template the rarest, until the others are too few."""
    out = set()
    for t in (t for x in NOTICES.values() for t in x):
        grams, chosen = own_grams(t), set()
        words = sorted((g for g in grams if " " not in g), key=lambda w: (often.get(w, 0), -len(w), w))
        while sum(chosen.isdisjoint(g.split()) for g in grams) >= confirm * len(grams):
            chosen.add(words[len(chosen)])
        out |= chosen
    return sorted(out)


def wrong_notices() -> list[str]:
    """Hard negatives: notices without the words that name their family, where they have them and no other family is named then, and denied notices."""
    out = []
    for family, x in NOTICES.items():
        for t in x:
            words = t.split()
            bare = [w for w in words if not set(own_grams(w)) & set(NAMES[family])]
            others = {n for f, names in NAMES.items() if f != family for n in names}
            out += [" ".join(bare)] * (0 < len(bare) < len(words) and others.isdisjoint(own_grams(" ".join(bare))))
            verbs = [k for k, w in enumerate(words) if w.lower() in DENIED][:1]
            out += [" ".join([*words[:k], "not", *words[k:]]) for k in verbs]
    return out


def vocabulary_of(wrong: list[str]) -> list[str]:
    return sorted({g for t in [*(t for x in NOTICES.values() for t in x), *wrong] for g in own_grams(t)})


def word_counts(docs: DataFrame) -> tuple[dict[str, int], int]:
    """(how often the texts hold each word of a template or hard negative, how many words they hold)."""
    known = sorted({w for g in vocabulary_of(wrong_notices()) for w in g.split()})
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = documents(docs).select(words.alias("w")).select(F.size("w").alias("n"), F.filter("w", lambda w: w.isin(known)).alias("w"))
    rows = rows.select(F.explode(F.concat(F.transform("w", lambda w: F.struct(w.alias("w"), F.lit(1).alias("n"))), F.array(F.struct(F.lit(None).cast("string").alias("w"), "n")))).alias("x"))
    found = {r.w: r.n for r in rows.groupBy("x.w").agg(F.sum("x.n").alias("n")).collect()}  # a row a known word
    return {w: n for w, n in found.items() if w is not None}, found.get(None, 0) or 0


def candidates(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, key, at, size, grams (of templates and hard negatives): the paragraphs with one of the needed words; no other can be confirmed."""
    only = rf"(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"
    known = vocabulary_of(wrong_notices())
    return paragraphs(docs, only).select("doc_id", "key", "at", "size", F.filter(grams_of(F.col("para")), lambda g: g.isin(known)).alias("grams"))


def variants(often: dict[str, int], n_words: int) -> list[tuple[int, list[str]]]:
    """(class, grams) of notices and hard negatives with words left out; every fourth has a neighbouring line too, of words as frequent as in the corpus."""
    rng, wrong, out = np.random.default_rng(7), wrong_notices(), []
    vocabulary = set(vocabulary_of(wrong))
    common = sorted(often)
    share = np.array([often[w] for w in common]) / max(n_words, 1)
    for f, t in [(f, t) for f, x in enumerate(NOTICES.values()) for t in x] + [(len(FAMILIES), t) for t in wrong]:
        words = t.split()
        fixed = {*NAMES[FAMILIES[f]], *DENIED} if f < len(FAMILIES) else {"not", *DENIED}
        for v in range(VARIANTS):
            kept = [w for w in words if v == 0 or rng.random() > 0.12 or fixed & set(own_grams(w))]
            near = [w for w, k in zip(common, rng.binomial(LINE_WORDS, share), strict=True) if k] if v % 4 == 3 else []
            out.append((f, sorted(vocabulary.intersection([*own_grams(" ".join(kept)), *near]))))
    return out


def unlike(grams: Column) -> Column:
    """Whether a paragraph holds less than half of every template."""
    templates = fixed([own_grams(t) for x in NOTICES.values() for t in x], "array<array<string>>")
    return ~F.exists(templates, lambda t: F.size(F.array_intersect(grams, t)) >= 0.5 * F.size(t))


def trained(rows: DataFrame, often: dict[str, int], n_words: int) -> tuple[dict[str, list[float]], list[float], float]:
    """(weights of grams, bias, threshold) from all candidates. Those that hold less than half of every template are the unknown class, as heavy together as the variants are.

    Equal gram sets count together; the regression runs over the cluster. The threshold comes from the scores of all of the unknown
    class, counted in ten thousandths.
    """
    spark = rows.sparkSession
    vocabulary = vocabulary_of(wrong_notices())
    sets = cut(rows.groupBy(F.array_sort("grams").alias("grams")).agg(F.count("*").alias("n")).where(unlike(F.col("grams"))))
    n = sets.agg(F.sum("n").alias("n")).first().n or 0
    made = variants(often, n_words)
    given = spark.range(1).select(F.explode(fixed([{"y": f, "grams": g} for f, g in made], "array<struct<y:int,grams:array<string>>>")).alias("x")).select("x.*", F.lit(1.0).alias("weight"))
    table = given.unionByName(sets.select(F.lit(len(FAMILIES)).alias("y"), "grams", (F.col("n") * (len(made) / max(n, 1))).alias("weight")))
    table = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "x").setBinary(True).transform(table).select(F.col("y").cast("double").alias("y"), "weight", "x")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=SPARSE, standardization=False, maxIter=ROUNDS, tol=1e-7).fit(table)
    w, b = model.coefficientMatrix.toArray(), np.asarray(model.interceptVector.toArray())
    w, bias = (w[:-1] - w[-1]).T, [round(float(v), 4) for v in b[:-1] - b[-1]]  # against the unknown class
    weights = {g: [round(float(v), 4) for v in w[k]] for k, g in enumerate(vocabulary) if np.abs(w[k]).max() >= 5e-5}
    bins = scored(sets, weights, bias).groupBy(F.ceil(F.col("score") * 10_000).alias("s")).agg(F.sum("n").alias("n")).where("s > 5000").collect()
    passed, at = 0, 5_000
    for r in sorted(bins, reverse=True):
        passed += r.n
        if passed > FALSE_RATE * n:
            at = r.s
            break
    return weights, bias, float(np.clip(at / 10_000, 0.5, 0.95))


def fit(docs: DataFrame) -> tuple[dict[str, list[float]], list[float], float, list[str]]:
    """(weights of grams, bias, threshold, needed words), from every paragraph of every document."""
    often, n_words = word_counts(docs)
    words = needed(often)
    return *trained(cut(candidates(docs, words)), often, n_words), words


def fixed(value, schema: str) -> Column:
    """A value of the model as one literal."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def scored(rows: DataFrame, weights: dict[str, list[float]], bias: list[float]) -> DataFrame:
    """rows (with grams) and family, score, confirmed: the likeliest family, and the share of its best template's grams."""
    table = fixed(weights, "map<string,array<double>>")
    hits = F.array_intersect("grams", F.map_keys(table))
    z = F.aggregate(hits, fixed(bias, "array<double>"), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
    best = F.array_max(F.zip_with(z, fixed(FAMILIES, "array<string>"), lambda a, f: F.struct(a.alias("z"), f.alias("family"))))
    templates = fixed({f: [own_grams(t) for t in x] for f, x in NOTICES.items()}, "map<string,array<array<string>>>")
    rows = rows.withColumn("best", best).withColumns({"family": F.col("best.family"), "score": 1 / (1 + F.exp(-F.col("best.z")))}).drop("best")
    share = F.aggregate(F.element_at(templates, F.col("family")), F.lit(0.0), lambda acc, t: F.greatest(acc, F.size(F.array_intersect(F.col("grams"), t)) / F.size(t)))
    return rows.withColumn("confirmed", share)


def scan(docs: DataFrame, model: tuple | None = None, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, key (a hash of the text), at, size, family, score, confirmed of every notice. A model serves any `confirm` from CONFIRM on."""
    if model is None:  # candidates serve both for training and for the scan
        often, n_words = word_counts(docs)
        rows = cut(candidates(docs, needed(often)))
        weights, bias, threshold = trained(rows, often, n_words)
    else:
        weights, bias, threshold, words = model
        rows = candidates(docs, words)
    found = scored(rows, weights, bias).where((F.col("score") >= threshold) & (F.col("confirmed") >= confirm))
    found = found.select("doc_id", "key", "at", "size", "family", "score", "confirmed").distinct()  # equal texts of an id count once
    here = Window.partitionBy("doc_id", "key").orderBy("at").rangeBetween(0, MAX_LINES - 1)
    end = F.col("at") + F.col("size")
    smaller = F.exists(F.collect_list(F.struct(end.alias("end"), "size")).over(here), lambda x: (x["size"] < F.col("size")) & (x["end"] <= end))
    least = found.withColumn("holds", smaller).where(~F.col("holds")).drop("holds")
    before = Window.partitionBy("doc_id", "key", "family").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    return least.withColumn("until", F.max(end).over(before)).where(F.coalesce(F.col("until") <= F.col("at"), F.lit(True))).drop("until")


def by_document(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """doc_id, n_notices, families (comma-joined, in order), score of every document."""
    found = scan(docs, model).select("doc_id", "family", "score")
    rows = found.unionByName(docs.select("doc_id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("score")))
    got = rows.groupBy("doc_id").agg(F.count("family").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return got.select("doc_id", "n_notices", "families", "score")
