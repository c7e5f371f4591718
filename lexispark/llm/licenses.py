"""Licence scans: a trained paragraph classifier, with a confirmation against templates; scanning is DataFrame-only.

A document is read as lines and, so that notices with hard line breaks are seen whole, as paragraphs of several lines
between blank ones; longer units are cut into windows of WINDOW words that overlap by half. A unit becomes sparse
features, the words and word pairs that also occur in the licence templates. A multinomial logistic regression over
families and an unknown class is trained on the driver, on the templates, on partial and altered copies of them alone
and amid other text, and on a bounded sample of the corpus's own units and of sentences that use the words otherwise.
The threshold of the unknown class is calibrated on held-out units that would be scored but are unlike every template. A
predicted family counts only if some template of that family is alike: the share of the unit's word pairs that the
template has, or of the template's that the unit has, reaches SIMILAR, and one of these pairs holds a word that is
not a function word.

So every finding holds one of the templates' characteristic word pairs, and what has none is passed over before features are made.
Scoring explodes the remaining units' features into a join with the weights, whose number is bounded by the templates.

Defined cases: null or empty texts have no findings; rows of equal id and text are scanned once and have the same findings each; a
null id is scanned and reported with a null id; a paragraph's finding is left out where a line of that document has the
same family; ties between families go to the first in alphabetical order; extra columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a unit that are looked at as one; longer ones are cut into windows of so many words.
WINDOW = 400
#: Parts in which negatives are held out of the fit that they calibrate.
FOLDS = 3
#: Least likeness to a template; share of held-out negatives that must stay unknown, and the margin above them.
SIMILAR, REJECT, MARGIN = 0.6, 0.999, 0.02
UNKNOWN = "unknown"
#: Function words: a pair of two of them does not characterise a template.
FUNCTION_WORDS = frozenset("a all an and any are as at be been but by can for from has have if in into is it its may must not of on or other shall that the their this these to was were which will with without you your".split())

# Short public notices of each family, as text.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the terms of the GPLv3 license.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the terms of the GPLv2 license.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) 2024 Example Corporation. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited without written permission.",
    ],
}
# Sentences that use the same words without granting a licence.
OTHERWISE = [
    "He lost his driving licence after the accident and had to take the bus.",
    "The restaurant applied for a liquor license last spring.",
    "Nobody may enter the building without permission of the owner.",
    "The police searched the house with a warrant signed by the judge.",
    "The guarantee and the warranty of this washing machine end after two years.",
    "Copyright law differs between countries, and students often ask about it.",
    "She asked for permission to leave the room early.",
    "You need a fishing license to fish in this lake.",
    "The general public was free to visit the foundation on Sundays.",
    "His poetic license went too far for the critics.",
    "The museum holds works in the public domain and modern works.",
    "Wealth should be redistributed, the speaker said in public.",
    "The dog licence costs ten pounds a year.",
    "The version of the story in the newspaper was free of errors.",
    "Apache helicopters were seen over the city at noon.",
    "The professor at MIT published a paper on software.",
]


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def pairs_of(tokens: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)}


def features(tokens: list[str]) -> set[str]:
    return {*tokens, *pairs_of(tokens)}


def characteristic() -> list[str]:
    """The templates' word pairs but for those of function words alone; every template has some."""
    found = set().union(*(pairs_of(words(t)) for own in TEMPLATES.values() for t in own))
    return sorted(p for p in found if not FUNCTION_WORDS.issuperset(p.split()))


def likeness(tokens: list[str]) -> float:
    """The greatest similarity to any template."""
    own = pairs_of(tokens)
    made = [pairs_of(words(t)) for texts in TEMPLATES.values() for t in texts]
    return max(len(own & t) / max(1, min(len(own), len(t))) for t in made)


class Classifier:
    """Weights by feature (families in order, then unknown), the bias, and the calibrated threshold."""

    def __init__(self, negatives: list[str], seed: int = 0):
        rng = random.Random(seed)
        self.families = sorted(TEMPLATES)
        self.vocabulary = sorted(set().union(*(features(words(t)) for own in TEMPLATES.values() for t in own)))
        self.place = {f: i for i, f in enumerate(self.vocabulary)}
        marks = set(characteristic())
        others = [tokens for t in [*OTHERWISE, *negatives] if (tokens := words(t)) and likeness(tokens) < SIMILAR]
        rng.shuffle(others)
        #: The best family's probability on each negative that would be scored, by models that have not seen it.
        self.calibration: list[float] = []
        for fold in range(FOLDS):
            held = [t for t in others[fold::FOLDS] if marks & pairs_of(t)]
            if held:
                self.weights = self._trained([t for i, t in enumerate(others) if i % FOLDS != fold], rng)
                self.calibration += [float(self.probabilities(t).max()) for t in held]
        self.weights = self._trained(others, rng)
        top = float(np.quantile(self.calibration, REJECT)) if self.calibration else 0.0
        self.threshold = min(0.95, max(0.5, top + MARGIN))

    def _trained(self, others: list[list[str]], rng: random.Random) -> np.ndarray:
        """Weights by templates, altered copies of them, and the negatives ``others``."""
        filler = sorted({w for tokens in others for w in tokens}) or ["the"]
        rows: list[tuple[set[str], int]] = []
        for y, family in enumerate(self.families):
            for text in TEMPLATES[family]:
                tokens = words(text)
                rows.append((features(tokens), y))
                for _ in range(24):  # partial and altered copies, alone and amid other text
                    own = [w if rng.random() > 0.08 else rng.choice(filler) for w in tokens]
                    if len(own) > 8 and rng.random() < 0.4:
                        at = rng.randrange(len(own) // 3)
                        own = own[at : at + max(6, len(own) * 2 // 3)]
                    around, most = [], rng.choice([0, 0, 6, 60, WINDOW - 60])
                    while len(around) < most:
                        around += rng.choice(others) if others else filler
                    around = around[: rng.randrange(most + 1)]
                    at = rng.randrange(len(around) + 1)
                    rows.append((features(around[:at] + own + around[at:]), y))
        unknown = len(self.families)
        rows += [(features(tokens), unknown) for tokens in others]
        for _ in range(len(rows) // 2):  # the words in another order and company
            rows.append((features([rng.choice(filler) if rng.random() < 0.6 else rng.choice(self.vocabulary).split()[0] for _ in range(rng.randrange(3, 14))]), unknown))
        x = np.zeros((len(rows), len(self.vocabulary) + 1), np.float32)
        for i, (own, _) in enumerate(rows):
            x[i, [self.place[f] for f in own if f in self.place]] = 1
        x[:, -1] = 1
        return self._fit(x, np.array([c for _, c in rows]), unknown + 1)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 200, ridge: float = 2e-5) -> np.ndarray:
        weights, speed = (np.zeros((x.shape[1], classes), np.float32) for _ in range(2))
        target = np.eye(classes, dtype=np.float32)[y]
        balance = (len(y) / (classes * np.maximum(1, np.bincount(y, minlength=classes))))[y][:, None].astype(np.float32)
        for _ in range(rounds):  # gradient descent with momentum
            z = x @ (weights + 0.9 * speed)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 2.0 * (x.T @ ((p - target) * balance) / len(y) + ridge * weights)
            weights = weights + speed
        return weights.astype(np.float64)

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        """Of the families (without unknown)."""
        z = self.weights[[self.place[f] for f in features(tokens) if f in self.place] + [-1]].sum(axis=0)
        p = np.exp(z - z.max())
        return (p / p.sum())[:-1]


def train(docs: DataFrame | None = None, text_col: str = "text", sample: int = 2000) -> Classifier:
    """Trains with at most ``sample`` units (windows of words) of rows of ``docs`` drawn by a hash of their text: half of them
    such as are scored, so that the rejection is calibrated on them."""
    negatives: list[str] = []
    if docs is not None:
        n = docs.count()
        share = min(1.0, sample / max(1, n))
        drawn = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        made = _units(drawn.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), every=True)
        # Longer words are in no template; a window of words without bound would be a text without bound.
        made = made.select("marked", F.array_join(F.transform("w", lambda w: F.substring(w, 1, 40)), " ").alias("unit")).distinct()
        for marked in (True, False):
            rows = made.filter(F.col("marked") == marked).orderBy(F.xxhash64("unit"), "unit").limit(sample // 2)
            negatives += [r["unit"] for r in rows.collect()]
    return Classifier(negatives)


def _pairs(w: Column) -> Column:
    both = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) > 1, both).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _marked(w: Column) -> Column:
    """Whether a characteristic pair of a template is among the words, side by side."""
    marks = characteristic()
    return _let(w, lambda own: F.exists(_pairs(own), lambda p: p.isin(marks)))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _units(docs: DataFrame, every: bool = False) -> DataFrame:
    """(id, key, unit, paragraph, part, w, marked): windows of the words of each line and of each paragraph of several lines,
    in documents that have a characteristic pair (or in all), and of those only the ones that have it themselves (or all)."""
    rows = docs.filter(F.col("text").isNotNull())
    rows = rows if every else rows.filter(_marked(_words(F.col("text"))))
    rows = rows.select("id", F.xxhash64("text").alias("key"), "text")
    lines = rows.select("id", "key", F.lit("line").alias("unit"), F.posexplode(F.split("text", "\n")).alias("paragraph", "own"))
    blocks = rows.select("id", "key", F.lit("paragraph").alias("unit"), F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("paragraph", "own"))
    units = lines.unionByName(blocks.filter(F.col("own").rlike(r"\S[ \t\r]*\n\s*\S"))).select("id", "key", "unit", "paragraph", _words(F.col("own")).alias("all"))
    half = WINDOW // 2
    last = F.floor(F.greatest(F.size("all") - 1 - half, F.lit(0)) / half).cast("int")
    units = units.filter(F.size("all") > 0).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    units = units.select("id", "key", "unit", "paragraph", "part", F.slice("all", F.col("part") * half + 1, WINDOW).alias("w"))
    units = units.withColumn("marked", _marked(F.col("w")))
    return units if every else units.filter("marked")


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Confirmed findings: (id_col, unit, paragraph, part, family, probability, similarity, words); paragraph is the number of
    the line, or of the paragraph, in its document."""
    spark = docs.sparkSession
    group = ["id", "key", "unit", "paragraph", "part"]
    units = _units(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    units = units.groupBy(*group).agg(F.first("w").alias("w"), F.count("*").alias("copies"))  # rows of equal id and text are one
    pairs = F.array_distinct(_pairs(F.col("w")))
    units = units.withColumn("words", F.size("w")).withColumn("pairs", pairs).withColumn("f", F.array_union(F.array_distinct("w"), F.col("pairs")))
    made = units.select(*group, "copies", "words", F.size("pairs").alias("n_pairs"), F.explode("f").alias("f")).join(F.broadcast(_weights(spark, model)), "f", "left")

    names = [*model.families, UNKNOWN]
    bias = model.weights[-1]
    sums = [(F.coalesce(F.sum(F.get("v", F.lit(i))), F.lit(0.0)) + float(bias[i])).alias(f"z{i}") for i in range(len(names))]
    n_templates = sum(map(len, TEMPLATES.values()))
    hits = [F.coalesce(F.sum(F.get("has", F.lit(t))), F.lit(0)).alias(f"h{t}") for t in range(n_templates)]
    marks = [F.coalesce(F.sum(F.get("has", F.lit(t)) * F.col("mark")), F.lit(0)).alias(f"m{t}") for t in range(n_templates)]
    scored = made.groupBy(*group).agg(F.first("copies").alias("copies"), F.first("words").alias("words"), F.first("n_pairs").alias("n_pairs"), *sums, *hits, *marks)

    logits = F.array(*(F.col(f"z{i}") for i in range(len(names))))
    top = F.array_max(logits)
    best = F.array_position(logits, top) - 1
    probability = 1 / F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))
    alike, t = [], 0
    for family in model.families:
        own = []
        for text in TEMPLATES[family]:
            like = F.col(f"h{t}") / F.greatest(F.lit(1), F.least(F.col("n_pairs"), F.lit(len(pairs_of(words(text))))))
            own.append(F.when(F.col(f"m{t}") > 0, like).otherwise(0.0))
            t += 1
        alike.append(F.greatest(*own))
    similarity = F.get(F.array(*alike), best.cast("int"))
    out = scored.select(*group, "copies", "words", F.get(F.array(*map(F.lit, names)), best.cast("int")).alias("family"), probability.alias("probability"), similarity.alias("similarity"))
    out = out.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold) & (F.col("similarity") >= SIMILAR))
    in_line = F.max(F.col("unit") == "line").over(Window.partitionBy("id", "key", "family"))
    out = out.withColumn("in_line", in_line).filter((F.col("unit") == "line") | ~F.col("in_line")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), "unit", "paragraph", "part", "family", F.round("probability", 4).alias("probability"), F.round("similarity", 4).alias("similarity"), F.col("words").cast("long").alias("words"))


def _weights(spark: SparkSession, model: Classifier) -> DataFrame:
    """(f, v: weights of the classes, has: for each template whether f is one of its word pairs, mark: whether f is a
    characteristic pair); a row per feature of the templates."""
    templates, marks = [features(words(t)) for family in model.families for t in TEMPLATES[family]], set(characteristic())
    rows = [(f, [float(x) for x in model.weights[i]], [int(" " in f and f in own) for own in templates], int(f in marks)) for i, f in enumerate(model.vocabulary)]
    return spark.createDataFrame(rows, "f string, v array<double>, has array<int>, mark int")
