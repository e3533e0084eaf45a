"""License scans: a trained classifier of paragraphs, in DataFrame functions on the main path.

Features are the presence of word unigrams and bigrams that hold a licence word: a word of
``TEMPLATES`` that is not in ``STOP``. A sparse
(L1) multinomial logistic regression, fitted on the driver on the templates' variants, ``OTHER_USES``
and at most ``SAMPLE`` plain paragraphs of the corpus, gives each paragraph a family or ``unknown``. The
sample has the first ``LINE`` words of three lines, from anywhere in the text, of each of ``SAMPLE / 3`` documents, without repeats and
without lines that name a licence or cover a template; its
probabilities, unknown's among them, are calibrated by a temperature fitted on templates that training left out, with all their variants. A family is confirmed where the
paragraph's word bigrams cover one of its templates, or are covered by one, to ``CONFIRM``.

A paragraph is a line of a text. Paragraphs without a licence word have no features, and so the
intercept's verdict, unknown; they are left out before n-grams are made, and so are those whose licence
words can't outweigh the intercept even with all n-grams of the templates that hold no other licence word.

One row a paragraph with a family: doc_id, paragraph (from 0), family, probability, similarity, confirmed. Null and
empty texts have none. Rows that repeat give rows that repeat. Of classes with equal probability the first in the order of ``TEMPLATES`` counts. Very long texts and
lines are split and compared whole, in one task. Columns other than doc_id and text are not looked at, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 600
#: Words at most of a sampled line.
LINE = 60
CONFIRM = 0.6
#: In calibration each template is left out of training once, with its variants.
FOLDS = 5
LEAST = 0.5
#: Share of a template's licence bigrams (or of the line's) from which a sampled line is no plain paragraph.
LIKE = 0.3
#: Sampled lines with these are no plain paragraphs.
LICENCE = re.compile(r"licen[sc]|copyright|rights reserved|creative commons|public domain|spdx|\b[al]?gpl", re.I)
UNKNOWN = "unknown"

# Short public licence notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Distributed under the MIT License. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL version 2 or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL version 3.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the 3-clause BSD license.",
        "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the CC0 1.0 Universal public domain dedication.",
        "This work has been dedicated to the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Copyright (c) 2019 Jane Doe. All rights reserved.",
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential.",
        "All rights reserved.",
        "Copyright 2020 Example Corporation.",
        "Copyright (c) 2019 Jane Doe",
        "Copyright 2021 Acme Inc.",
        "Copyright 2022 The Authors",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "Released under the Eclipse Public License, version 2.0.",
        "Released under the EPL 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "EUPL": [
        "Licensed under the European Union Public Licence, version 1.2.",
        "Licensed under the EUPL, Version 1.2 or later.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Released under the Boost Software License.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
}
# Sentences that use such words otherwise.
OTHER_USES = [
    "He lost his driving license last year and had to take the test again.",
    "She asked for permission to enter the building before noon.",
    "The copyright debate went on in the parliament for many years.",
    "The general public was invited to the opening of the new library.",
    "The software crashed after the last version was installed.",
    "The source of the river lies in the binary star of the story.",
    "Creative people often work in common rooms at the institute.",
    "The foundation published a report on the terms of trade.",
    "Apache helicopters flew over the valley in the morning.",
    "Students at the university received a copy of the notice.",
    "The conditions of the contract are met and the work can start.",
    "All rights and duties of the members are listed below.",
    "The domain of the function is the set of real numbers.",
    "A fee is charged for any purpose that is not educational.",
]
STOP = set("a an and any are as at by can for free from had has in is it its of on or that the this to under use used was were with work you your not may be all see which without file list following above".split())


#: A year, which any notice may have; all are one word.
YEAR = "(?<![0-9])(?:19|20)[0-9][0-9](?![0-9])"


def plain(text: str) -> list[str]:
    """The words of a paragraph, as ``words_of`` has them."""
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(YEAR, "year", text.lower())) if w]


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits of the text in lower case, years as one word; empty strings may stand at the ends."""
    return F.split(F.regexp_replace(F.lower(text), YEAR, "year"), "[^a-z0-9]+")


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _cues() -> list[str]:
    """The licence words."""
    return sorted({w for ts in TEMPLATES.values() for t in ts for w in plain(t) if w not in STOP and len(w) > 1})


def without_licences(lines: list[str]) -> list[str]:
    """The distinct lines that neither name a licence nor cover a template."""
    cues = set(_cues())
    pairs = lambda words: {(a, b) for a, b in zip(words, words[1:]) if a in cues or b in cues}
    templates = [pairs(plain(t)) for ts in TEMPLATES.values() for t in ts]

    def like(line: str) -> bool:
        own = pairs(plain(line))
        return any(len(own & t) >= max(LIKE * min(len(own), len(t)), min(2, len(own), len(t))) for t in templates if own and t)

    return sorted({line for line in lines if not LICENCE.search(line) and not like(line)})


class Model:
    """Families, licence words, and for each n-gram a weight a family (the last class is unknown)."""

    def __init__(self, negatives: list[str]):
        rng = np.random.default_rng(3)
        negatives = [w for w in map(plain, [*OTHER_USES * 4, *negatives]) if w]
        texts = {f: [plain(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.cues = _cues()
        cues = set(self.cues)
        self.families = [*texts, UNKNOWN]
        rows, labels, source = [], [], []
        for k, ts in enumerate(texts.values()):
            for j, t in enumerate(ts):
                for v in range(10):
                    noise = negatives[rng.integers(len(negatives))][: 2 * (v % 4)]
                    part = t if v < 6 else t[: max(3, len(t) * 7 // 10)] if v < 8 else t[len(t) * 3 // 10 :]
                    rows.append(part + noise if v % 2 else noise + part)
                    labels.append(k)
                    source.append(j)
        rows += negatives
        labels += [len(texts)] * len(negatives)
        source += list(range(len(negatives)))
        kept = lambda words: {g for g in _grams(words) if any(w in cues for w in g.split())}
        grams = [kept(w) for w in rows]
        self.vocabulary = sorted({g for r, k in zip(grams, labels) if k < len(texts) for g in r if g in set().union(*(_grams(t) for t in texts[self.families[k]]))})
        at = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(at) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(grams):
            x[i, [at[g] for g in r if g in at]] = 1
        y = np.eye(len(self.families), dtype=np.float32)[labels]
        self.temperature = self._temperature(x, y, np.array(source) % FOLDS)
        w = self._fitted(x, y)
        self.weights, self.intercept = w[:-1], w[-1]
        self.telling = self._telling(Counter(g for n in negatives for g in set(n) & cues))

    def _temperature(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
        """The temperature with the least log loss on templates (and plain paragraphs) that were left out of training, fold by fold."""
        logits = np.zeros(y.shape, np.float32)
        for f in range(FOLDS):
            logits[fold == f] = x[fold == f] @ self._fitted(x[fold != f], y[fold != f], rounds=200)
        loss = lambda t: -np.log(np.maximum(self._shares(logits / t), 1e-9))[y > 0].mean()
        return float(min(np.geomspace(0.3, 6.0, 40), key=loss))

    def _telling(self, times: Counter) -> list[str]:
        """The licence words without those that, all together and with all their n-grams, leave a paragraph unknown; frequent ones are tried first."""
        gain = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0)
        room = self.intercept[-1] - self.intercept[:-1] - 0.01
        cues, weak = set(self.cues), set()
        needs = [cues & set(g.split()) for g in self.vocabulary]
        for word in sorted(self.cues, key=lambda c: (-times[c], c)):
            if (gain[[i for i, n in enumerate(needs) if n <= weak | {word}]].sum(axis=0) < room).all():
                weak.add(word)
        return sorted(cues - weak)

    @staticmethod
    def _shares(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fitted(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, l1: float = 2e-4) -> np.ndarray:
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        ahead, step = w.copy(), np.float32(4.0 / max(1.0, float((x**2).sum(axis=1).mean())))
        for i in range(rounds):
            grad = x.T @ (self._shares(x @ ahead) - y) / len(x)
            new = ahead - step * grad
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
            ahead = new + np.float32(i / (i + 3)) * (new - w)
            w = new
        return w


def fitted(docs: DataFrame) -> Model:
    """Fit on the templates and on paragraphs of a bounded number of documents (those with the lowest hashes)."""
    ids = [r["doc_id"] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 3).collect()]
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.xxhash64("doc_id", i).alias("order"), F.regexp_extract(line, rf"^\s*((?:\S+\s*){{0,{LINE}}})", 1).alias("line")))
    lines = F.slice(F.array_sort(F.filter(lines, lambda x: x["line"] != "")), 1, 3)["line"]
    some = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select(lines.alias("lines")).limit(SAMPLE // 3)
    return Model(without_licences([" ".join(line.split()) for r in some.collect() for line in r["lines"]]))


def licensed_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of each paragraph with a family."""
    cues = F.array(*map(F.lit, model.telling))
    touched = docs.select("doc_id", "text").where(F.arrays_overlap(words_of(F.col("text")), cues))
    lines = touched.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.withColumn("words", F.array_remove(words_of(F.col("line")), "")).where(F.arrays_overlap("words", cues)).select("doc_id", "paragraph", "words")
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    pairs = F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))
    lines = lines.withColumn("pairs", F.array_distinct(pairs))
    used = np.flatnonzero(np.abs(model.weights).max(axis=1) > 0)
    table = F.map_from_arrays(
        F.array(*[F.lit(model.vocabulary[i]) for i in used]), F.array(*[F.array(*[F.lit(round(float(x), 6)) for x in model.weights[i] / model.temperature]) for i in used])
    )
    start = F.array(*[F.lit(round(float(x), 6)) for x in model.intercept / model.temperature])
    known = F.array(*[F.lit(model.vocabulary[i]) for i in used])
    grams = F.array_intersect(F.concat(F.array_distinct("words"), "pairs"), known)
    names = F.array(*map(F.lit, model.families))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  a value that is used more than once
    share = lambda z, top: F.struct(F.element_at(names, F.array_position(z, top).cast("int")).alias("family"), (1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))).alias("probability"))
    sums = F.aggregate(grams, start, lambda acc, g: once(F.element_at(table, g), lambda w: F.zip_with(acc, w, lambda a, b: a + b)))
    best = once(sums, lambda z: once(F.array_max(z), lambda top: share(z, top)))
    best = F.filter(F.array(best), lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= LEAST))
    lines = lines.select("doc_id", "paragraph", "pairs", F.explode(best).alias("best")).select("doc_id", "paragraph", "pairs", "best.*")
    similarity = F.lit(0.0)
    for family, templates in TEMPLATES.items():
        scores = []
        for t in templates:
            own = sorted({f"{a} {b}" for a, b in zip(plain(t), plain(t)[1:])})
            scores.append(F.size(F.array_intersect("pairs", F.array(*map(F.lit, own)))) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.lit(len(own)))))
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        similarity = F.when(F.col("family") == family, best).otherwise(similarity)
    lines = lines.withColumn("similarity", similarity)
    return lines.select("doc_id", "paragraph", "family", F.round("probability", 4).alias("probability"), F.round("similarity", 4).alias("similarity"), (F.col("similarity") >= CONFIRM).alias("confirmed"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licensed_paragraphs(docs, fitted(docs))
