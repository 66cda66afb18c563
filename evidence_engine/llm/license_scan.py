"""License scans over paragraphs (windows of neighbouring lines), by DataFrame operations alone.

A multinomial logistic regression over hashed word 1-grams and 2-grams predicts the licence family of every paragraph that has a licence word, or that it is
unknown. It is trained by Spark on the templates below, on names of licences in sentences that grant them, and, as unknown, on the same names in
sentences that deny or only discuss them, on sentences that speak of licences and name none, and on the whole corpus: half of all distinct paragraphs
with a licence word that resemble no family, by hash, row by row; and every line without a licence word, as often as it occurs. The model is never asked
about the latter, so they train by the means of their features in classes of length (a bounded number of rows, in which each line counts alike). Each of the
two kinds weighs as much as its rows, ``UNKNOWN_WEIGHT`` at most, so that a large corpus doesn't outweigh the licences. The probability that a family must
reach is calibrated on the other half of those paragraphs, all of them: an exact quantile of what the model gives to any family there.

A prediction is confirmed by comparison with the texts of the predicted family alone: the share of a text's words that the paragraph holds, each
weighed by how few families use it, must reach ``CONFIRM`` for one of them. Versions and spellings of "license" don't count.

A paragraph is a line, or up to WINDOW neighbouring lines without a blank one between them, as licences are often wrapped. It is
numbered by its first line, and reported if no shorter one inside it resembles the family as much.

Defined cases: null and empty texts have no licence paragraph; very long texts are scanned whole; families of equal probability go by
name; other columns, whatever their names, don't enter; rows are scanned one by one, so repeated rows give
repeated results; a null doc_id is kept; with an empty corpus the templates, names and generic sentences alone train.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import let, stored

#: What all unknown rows of a kind from the corpus weigh together, at most (a template weighs 20).
UNKNOWN_WEIGHT = 500.0
#: Training rows of a task.
TASK_ROWS = 20_000
#: Share of unknown paragraphs whose probability of any family stays below the limit.
QUANTILE = 0.99
#: Share of a template's content words that a paragraph must hold.
CONFIRM = 0.8
MIN_PROBABILITY = 0.7
FEATURES = 1 << 12
UNKNOWN = "unknown"

#: Names and usual wordings of licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc_by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsl": (
        "Use of this software is governed by the Business Source License.",
        "SPDX-License-Identifier: BUSL-1.1",
    ),
    "cc_by_nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc_by_nc_nd": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "cc_by_nc_sa": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc_by_nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc_by_sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public_domain": (
        "This work is released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
#: Short names of licences, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPL-3.0-or-later"),
    "apache": ("Apache License", "Apache License 2.0", "Apache-2.0", "Apache Software License"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause"),
    "bsl": ("Business Source License", "Business Source License 1.1", "BUSL-1.1"),
    "cc_by": ("CC BY", "CC BY 4.0", "Creative Commons Attribution"),
    "cc_by_nc": ("CC BY-NC", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution Non-Commercial"),
    "cc_by_nc_nd": ("CC BY-NC-ND", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution Non-Commercial No-Derivatives"),
    "cc_by_nc_sa": ("CC BY-NC-SA", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike", "Creative Commons Attribution Non-Commercial Share-Alike"),
    "cc_by_nd": ("CC BY-ND", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution No-Derivatives"),
    "cc_by_sa": ("CC BY-SA", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution Share-Alike"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPL-3.0-only"),
    "isc": ("ISC License", "ISC"),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL-2.1-only"),
    "mit": ("MIT License", "MIT"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL-2.0", "MPL"),
    "public_domain": ("Unlicense", "CC0", "CC0 1.0", "Creative Commons Zero", "public domain"),
}
#: Sentences that grant a licence ({} its name) and train for its family, and sentences that deny or discuss one and train as unknown.
GRANTS = (
    "Licensed under {}.", "Released under the {}.", "Distributed under the terms of the {}, version 2", "License: {}", "SPDX-License-Identifier: {}", "{}", "The {}", "This code is {} licensed.", "is made available under {} unless noted",
    "This project is covered by the {}", "subject to the terms of the {}", "dedicated to the {}", "published with a {} licence", "either version 3 of the {} or any later version",
)
DENIALS = (
    "This is not licensed under the {}.", "The code isn't under the {}", "This project does not use the {}", "We considered the {} but rejected it.", "It was never released under the {}", "no longer available under {}",
    "The {} was not chosen", "unlike the {}, our terms are our own", "Which is better, the {} or another?", "A talk on the history of the {}", "They compared it with the {} at length", "cannot be combined with the {}",
    "They didn't release it under the {}", "It isn't published under the {}", "We did not choose the {}", "The {} was ruled out", "They rejected the {}", "has been rejected: the {}", "An article about the {}", "questions about {}",
    "instead of the {}", "Nobody uses the {} here", "did not want the {}", "a lecture about the {} was held", "never under the {}",
)
#: Lines of the longest paragraph.
WINDOW = 6
#: Sentences that speak of licences and name none.
GENERIC = (
    "All rights reserved.",
    "The driver must show a license to the officer.",
    "See the license file for details.",
    "Copyright of this work remains with the author.",
    "The public asked for permission to use the work.",
    "Released under pressure, the version was free of charge.",
    "This version is licensed to the company under other terms.",
)
#: Words that say nothing about the family.
COMMON = frozenset("a an and any are as at be by can for free from in into is it its may of on or that the this to under use used version with work you your".split())


#: What is rewritten before words are told apart: spellings of the licence's verb and noun, and versions after a name.
_SPELLED = ((r"licen[cs](?:e[sd]?|ing)\b", "license"), (r"(gpl|mpl|bsl|apache)v?[0-9]+", "$1"), (r"\bv?[0-9]+\b", " "))


def _tokens(text: Column) -> Column:
    text = F.lower(text)
    for pattern, plain in _SPELLED:
        text = F.regexp_replace(text, pattern, plain)
    return F.array_remove(F.split(text, r"[^a-z0-9]+"), "")


def _token_list(text: str) -> list[str]:
    text = "".join(c.lower() if c < "\x80" else c for c in text)
    for pattern, plain in _SPELLED:
        text = re.sub(pattern, plain.replace("$", "\\"), text, flags=re.ASCII)
    return [x for x in re.split(r"[^a-z0-9]+", text) if x]


def content_words(template: str) -> list[str]:
    return sorted(set(_token_list(template)) - COMMON)


def _texts() -> dict[str, list[list[str]]]:
    """The content words of each family's templates and names, by family; a name of one common word stands with "license"."""
    out = {}
    for family in sorted(TEMPLATES):
        own = [content_words(t) for t in TEMPLATES[family]] + [sorted(set(_token_list(t))) for t in NAMES[family]]
        out[family] = [list(x) for x in sorted({tuple(sorted({*w, "license"})) if len(w) == 1 and w[0] in ("mit", "isc") else tuple(w) for w in own})]
    return out


TEXTS = _texts()
_USES = {w: sum(any(w in t for t in ts) for ts in TEXTS.values()) for ts in TEXTS.values() for t in ts for w in t}
#: How much a word says about the family.
WEIGHTS = {w: round(math.log1p(len(TEXTS) / n), 4) for w, n in _USES.items()}
#: Words of ordinary text that make no line a paragraph's first or last.
WEAK = {"nd", "no", "only", "sa", "nc", "or", "zero", "share", "non", "the", "by", "clause", "general", "use", "terms", "following", "conditions", "met", "without", "copy", "person", "any", "file", "files", "source", "form", "work"}
#: A paragraph with one of these is asked about.
LICENSE_WORDS = (
    "license", "spdx", "gpl", "lgpl", "agpl", "apache", "bsd", "mpl", "mozilla", "busl", "bsl", "cc", "cc0", "commons", "unlicense", "domain", "unencumbered", "permission", "redistribution", "redistribute", "copyleft",
)


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words."""
    return let(
        tokens,
        lambda w: F.concat(
            w,
            F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 2)), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
            ),
        ),
    )


def paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (from 0), text and lines (with the WINDOW - 1 after it) of each line."""
    own = F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1)
    windows = let(own, lambda a: F.transform(a, lambda x, i: F.slice(a, i + 1, WINDOW)))
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(windows).alias("paragraph", "lines")).withColumn("text", F.get("lines", 0))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in words])


def similarity(tokens: Column, family: Column) -> Column:
    """The largest weighted share of a text of the family (its number by name, from 1) that tokens hold."""
    word = lambda w: F.struct(F.lit(w).alias("w"), F.lit(WEIGHTS[w]).alias("x"))
    families = F.array(*[F.array(*[F.struct(F.array(*map(word, t)).alias("words"), F.lit(sum(WEIGHTS[w] for w in t)).alias("all")) for t in ts]) for ts in TEXTS.values()])
    held = lambda own, t: F.aggregate(t["words"], F.lit(0.0), lambda a, x: a + F.when(F.array_contains(own, x["w"]), x["x"]).otherwise(0.0)) / t["all"]
    return let(tokens, lambda own: F.array_max(F.transform(F.get(families, family - 1), lambda t: held(own, t))))


def closest(tokens: Column) -> Column:
    """The largest similarity to any family."""
    return F.array_max(F.transform(F.sequence(F.lit(1), F.lit(len(TEXTS))), lambda f: similarity(tokens, f)))


def has_word(tokens: Column, words: tuple[str, ...] = LICENSE_WORDS) -> Column:
    return F.exists(tokens, lambda x: x.isin(*words))


#: Parts of a text's letters without which no licence word can be in it; cc stands alone.
_PARTS = ("licen", "spdx", "gpl", "apache", "bsd", "mpl", "mozilla", "busl", "bsl", "commons", "domain", "unencumbered", "permission", "redistribut", "copyleft")


def mentions(text: Column) -> Column:
    """Whether a text may have a licence word: a quick look that loses none, so that other documents aren't told apart into words."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in _PARTS], low.rlike(r"(?<![a-z0-9])cc(?:0|(?![a-z0-9]))"))


def windows(rows: DataFrame, edge) -> DataFrame:
    """doc_id, paragraph and text of the paragraphs of 1 to WINDOW lines that start at rows, that have a licence word, and whose first and last lines have a
    word of some wording."""
    widths = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda n: ~F.exists(F.slice("lines", 1, n), lambda x: F.trim(x) == ""))
    some = rows.where(edge(F.col("text"))).withColumn("__n", F.explode(widths))
    some = some.where((F.col("__n") == 1) | edge(F.get("lines", F.col("__n") - 1)))
    some = some.select("doc_id", "paragraph", F.array_join(F.slice("lines", 1, F.col("__n")), "\n").alias("text"))
    return some.where(has_word(_tokens(F.col("text"))))


def quantile_above(rows: DataFrame, least: float, share: float) -> float:
    """The exact quantile of the column top, as percentile interpolates it, where it exceeds least, else least. Only values above least are put in order, by ranges."""
    top = F.col("top")
    n, below, under = rows.agg(F.count("*"), F.count_if(top <= least), F.max(F.when(top <= least, top))).first()
    at = share * max(0, n - 1)
    low, high = math.floor(at), math.ceil(at)
    if n == 0 or high < below:
        return least
    places, _ = ranked(rows.where(top > least).select("top"), [], ["top"])
    found = {below + r["at"]: r["top"] for r in places.where(F.col("at").isin(low - below, high - below)).collect()}
    first = found.get(low, under)
    return max(least, first + (found[high] - first) * (at - low))


class Scanner:
    """The trained model with its calibrated limit."""

    def __init__(
        self, spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, asked: DataFrame | None = None
    ):
        """asked: what asked() gives for docs, if it is at hand. sample bounds the unknown rows of the corpus, for callers who want that; None takes them all."""
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
        at, unknown = {f: float(k) for k, f in enumerate(self.families)}, float(len(self.families) - 1)
        rows = [(t, at[f], 20.0) for f, ts in TEMPLATES.items() for t in ts] + [(t, unknown, 20.0) for t in GENERIC]
        rows += [(g.format(n), at[f], 4.0) for f, ns in NAMES.items() for n in ns for g in GRANTS] + [(g.format(n), unknown, 4.0) for ns in NAMES.values() for n in ns for g in DENIALS]
        given = spark.createDataFrame(rows, "text string, label double, weight double")
        some = self.unknowns(docs, id_col=id_col, text_col=text_col, sample=sample, asked=asked)
        hard = some.where("hard AND fits")
        n = hard.count()
        known = given.unionAll(hard.select("text", F.lit(unknown).alias("label"), F.lit(min(1.0, UNKNOWN_WEIGHT / max(1, n))).alias("weight")))
        known = self.hashed(known.withColumn("tokens", _tokens(F.col("text")))).select("features", "label", "weight", "text")
        means = self.means(some.where("NOT hard AND fits")).withColumn("label", F.lit(unknown)).select("features", "label", "weight", F.lit("").alias("text"))
        tasks = 1 + (n + len(rows)) // TASK_ROWS
        training = stored(known.unionAll(means).repartition(tasks, "text").sortWithinPartitions("label", "weight", "text"))
        self.model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=40).fit(training)
        self.limit = quantile_above(stored(self.predicted(some.where("hard AND NOT fits")).select("top")), MIN_PROBABILITY, QUANTILE)

    @classmethod
    def asked(cls, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The paragraphs of docs that the model is asked about, kept: doc_id (id, and row, which tells rows apart), paragraph, text, near (the largest similarity)."""
        rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row")).where(mentions(F.col("text")))
        lines = paragraphs(rows.select(F.struct("id", "row").alias("doc_id"), "text"))
        return stored(windows(lines, cls.edge).withColumn("near", closest(_tokens(F.col("text")))))

    @classmethod
    def unknowns(cls, docs: DataFrame, *, id_col: str, text_col: str, sample: int | None = None, asked: DataFrame | None = None) -> DataFrame:
        """text, hard and fits: the distinct paragraphs with a licence word that resemble no family (hard; half of them fit, the others calibrate), and every
        line without a licence word. With sample, at most 2 sample of each kind, by hash."""
        near = cls.asked(docs, id_col=id_col, text_col=text_col) if asked is None else asked
        near = near.withColumn("row", F.col("doc_id.row"))
        around = F.explode(F.sequence(F.col("paragraph") - WINDOW, F.col("paragraph") + WINDOW)).alias("paragraph")
        parts = near.where(F.col("near") >= CONFIRM).select("row", around).distinct()  # the rest of a licence is no unknown text
        hard = near.where(F.col("near") < CONFIRM).join(parts, ["row", "paragraph"], "left_anti").select("text").distinct()
        own = F.split(docs[text_col], "\n", -1)
        plain = docs.select(F.explode(own).alias("text")).where(F.trim("text") != "")
        plain = plain.where(~F.when(mentions(F.col("text")), has_word(_tokens(F.col("text")))).otherwise(False))
        if sample is not None:
            hard, plain = (df.orderBy(F.xxhash64("text")).limit(2 * sample) for df in (hard, plain))
        hard = stored(hard.select("text", F.lit(True).alias("hard"), (F.pmod(F.xxhash64(F.lit("fits"), F.col("text")), F.lit(2)) == 0).alias("fits")))
        return hard.unionAll(plain.select("text", F.lit(False).alias("hard"), F.lit(True).alias("fits")))

    def means(self, lines: DataFrame) -> DataFrame:
        """features and weight, by class of length (a power of two of words): the share of the lines that have each feature, and what the lines weigh."""
        rows = self.hashed(lines.select(_tokens(F.col("text")).alias("tokens"))).groupBy(F.floor(F.log2(F.size("tokens") + F.lit(1))))
        sums = stored(rows.agg(F.count("*").alias("__n"), Summarizer.numNonZeros(F.col("features")).alias("__held")))  # whole numbers: the same in any order
        n = sums.agg(F.sum("__n")).first()[0] or 1
        shares = F.transform(vector_to_array("__held"), lambda x: x / F.col("__n"))
        return sums.select(array_to_vector(shares).alias("features"), (F.col("__n") * F.lit(min(1.0, UNKNOWN_WEIGHT / n))).alias("weight"))

    def hashed(self, rows: DataFrame) -> DataFrame:
        """rows (with tokens) with the features of their grams."""
        pairs = NGram(n=2, inputCol="tokens", outputCol="__pairs").transform(rows)
        return self.hashing.transform(pairs.withColumn("grams", F.concat("tokens", "__pairs"))).drop("__pairs", "grams")

    @staticmethod
    def edge(text: Column) -> Column:
        return has_word(_tokens(text), tuple(sorted({*WEIGHTS, *LICENSE_WORDS} - WEAK)))

    def predicted(self, rows: DataFrame) -> DataFrame:
        """rows (with text) with tokens, and top and best: the probability and the number of the likeliest family."""
        tokens = rows.withColumn("tokens", _tokens(F.col("text")))
        out = self.model.transform(self.hashed(tokens))
        known = F.slice(vector_to_array("probability"), 1, len(self.families) - 1)
        out = out.withColumn("__p", known).withColumn("top", F.array_max("__p"))
        out = out.withColumn("top", F.when(F.col("top") > F.get(vector_to_array("probability"), len(self.families) - 1), F.col("top")).otherwise(0.0))
        return out.withColumn("best", F.array_position("__p", F.array_max("__p")).cast("int")).drop("__p", "features", "rawPrediction", "probability", "prediction")

    def scan(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", asked: DataFrame | None = None) -> DataFrame:
        """doc_id, paragraph, family, probability, similarity and text of the paragraphs that show a licence."""
        rows = self.predicted(self.asked(docs, id_col=id_col, text_col=text_col) if asked is None else asked).where(F.col("top") >= self.limit)
        rows = rows.withColumn("similarity", similarity(F.col("tokens"), F.col("best"))).where(F.col("similarity") >= CONFIRM)
        lines = F.split("text", "\n", -1)
        inner = lambda a: let(  # noqa: E731  the text without a line: its last or its first
            F.array_join(F.slice(lines, a, F.size(lines) - 1), "\n"), lambda x: F.when(x == "", 0.0).otherwise(similarity(_tokens(x), F.col("best")))
        )
        rows = rows.where((inner(1) < CONFIRM) & (inner(2) < CONFIRM))
        family = F.element_at(_literal(self.families), F.col("best")).alias("family")
        return rows.select(F.col("doc_id.id").alias("doc_id"), "paragraph", family, F.col("top").alias("probability"), "similarity", "text")


def license_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    asked = Scanner.asked(docs, id_col=id_col, text_col=text_col)
    return Scanner(docs.sparkSession, docs, id_col=id_col, text_col=text_col, sample=sample, asked=asked).scan(docs, asked=asked)
