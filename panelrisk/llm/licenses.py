"""Licence scans: a trained paragraph classifier, and templates that confirm what it says.

A paragraph's features are its word pairs and triples that occur in the templates or near misses, hashed. A softmax
regression over licence families and "unknown" is trained by gradient descent on variants of the templates,
on near misses and on paragraphs of the corpus (a bounded sample of documents). A temperature
fitted on variants kept from training calibrates the probabilities. A family is reported if its calibrated
probability is high enough and one of its templates is contained in the paragraph, with the words by which it differs
from similar templates of other families and of foreign licences; all else is unknown.
A paragraph is a line, or a run of neighbouring lines over which a template is wrapped. Each licence of an SPDX
expression is a paragraph of its own.
"""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_text, free_name, hashed_words, shingle_hashes

UNKNOWN = "unknown"
#: Least calibrated probability, least share of a template's word pairs, and documents sampled for "unknown".
LEAST_PROBABILITY, LEAST_TEMPLATE, SAMPLE_DOCS = 0.6, 0.7, 200
#: Templates are similar if they share this part of the smaller one's word pairs; a family needs this part of the pairs
#: that its template has and a similar one hasn't.
SIMILAR, LEAST_DIFFERENT = 0.5, 0.5
#: Paragraphs sampled for "unknown" at most, and their length: what reaches the driver is bounded by the product.
SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 5_000, 2_000
VARIANTS, STEPS, RATE, DECAY, SEED = 24, 300, 2.0, 1e-4, 23
BLOCK_CHARS = 1_000_000

# Notices and opening lines by which licences are given, by family.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL": ("This work is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "BSD": ("Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved.", "This document is proprietary and confidential. Unauthorized copying is strictly prohibited."),
}
# Sentences that use the same words and give no licence.
NEAR_MISSES = (
    "He was released under the bridge.", "The driver is licensed under state law.", "The seats are all reserved.", "Human rights are for all.", "She studied at MIT.", "A licence to kill is a film.",
    "The general public is welcome.", "This work is hard.", "Version 3 of the plan was released.", "The free software movement began in the eighties.", "Apache tribes lived in the south.",
    "The permission was granted by the king.", "All the tables are reserved for guests.", "This program is broadcast on Sunday.", "The licence of the pub was renewed.", "The public domain of the city.",
    "Terms and conditions of the sale are met.", "Creative people are common here.", "He had the right to reserve a room.", "The author waived the fee.", "The library is under a new roof.",
)
# Notices of licences that are no family here.
FOREIGN = (
    "Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Licensed under the Common Development and Distribution License 1.0.", "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "Licensed under the European Union Public Licence, version 1.2.", "Licensed under the Artistic License 2.0.", "Released under the zlib License.", "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Python Software Foundation License, version 2.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Made available under the Open Database License.",
    "Licensed under the Microsoft Public License.", "Licensed under the Academic Free License version 3.0.", "Licensed under the Common Public License 1.0.", "Licensed under the Server Side Public License, version 1.",
    "Permission is hereby granted to use the trademark for the purpose of the agreement only.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.",
    "Released under the Ruby License.", "Released under the PHP License, version 3.01.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: CDDL-1.0",
)
FAMILIES = (UNKNOWN, *TEMPLATES)
_SPDX = re.compile(r"(.*SPDX-License-Identifier:)(.*)", re.IGNORECASE | re.DOTALL)
_OPERATOR = re.compile(r"\s+(?:AND|OR)\s+", re.IGNORECASE)
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def grams(paragraphs: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the word pairs, and of pairs and triples, of each paragraph; one of a single word has none."""
    words, counts = hashed_words([p.lower().encode() for p in paragraphs], _PLAIN)
    pairs, triples = (by_text(*shingle_hashes(words, counts, width)) for width in (2, 3))
    return pairs, [np.concatenate(x) for x in zip(pairs, triples)]


def variants(template: str, rng: random.Random) -> list[str]:
    """The template as people write it: other case, a prefix or a suffix, a holder and a year, a word lost."""
    out = [template, template.lower(), template.upper()]
    around = ("", "Copyright (c) 2019 ", "© 2021 Jane Doe. ", "Note: ", "The code is ")
    while len(out) < VARIANTS:
        words = template.split()
        if len(words) > 6 and rng.random() < 0.5:
            words.pop(rng.randrange(len(words)))
        if len(words) > 14 and rng.random() < 0.5:
            words = words[: rng.randint(12, len(words))]
        out.append(rng.choice(around) + " ".join(words) + rng.choice(("", " See LICENSE for details.", " http://example.org")))
    return out


@dataclass
class Model:
    """Hashes of the known features in order, their weights for each family, the bias, and the temperature; the
    distinct word pairs of the templates, and for each template those by which it and each similar one of another family
    or a foreign licence differ."""

    known: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[np.ndarray]]
    differences: dict[str, list[list[tuple[np.ndarray, np.ndarray]]]]

    def logits(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.tile(self.bias, (len(features), 1))
        sizes = np.array([len(f) for f in features], np.int64)
        flat = np.concatenate(features) if features else np.zeros(0, np.uint64)
        at = np.searchsorted(self.known, flat)
        at[at == len(self.known)] = 0
        hit = np.flatnonzero(self.known[at] == flat)
        owner = np.repeat(np.arange(len(features)), sizes)[hit]
        np.add.at(out, owner, self.weights[at[hit]])
        return out

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        scores = self.logits(features) / self.temperature
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def classify(self, paragraphs: list[str]) -> list[tuple[str, float, float]]:
        """(family, probability, share of its best template that the paragraph has) of each paragraph."""
        if not paragraphs:
            return []
        pairs, features = grams(paragraphs)
        likely = self.probabilities(features)
        out = []
        for own, p in zip(pairs, likely):
            best = int(np.argmax(p))
            family, probability, shared = FAMILIES[best], float(p[best]), 0.0
            if best:
                shares = [_share(t, own) for t in self.templates[family]]
                shared = max(shares)
                fits = (s >= LEAST_TEMPLATE and self._differs(family, k, own) for k, s in enumerate(shares))
                if probability < LEAST_PROBABILITY or not any(fits):
                    family = UNKNOWN
            out.append((family, probability, shared))
        return out

    def _differs(self, family: str, template: int, own: np.ndarray) -> bool:
        """Whether the paragraph has what sets the template apart from each similar one, rather than the other's."""
        for ours, theirs in self.differences[family][template]:
            mine, other = _share(ours, own), _share(theirs, own)
            if (mine < LEAST_DIFFERENT or mine < other) if len(ours) else other >= LEAST_DIFFERENT:
                return False
        return True


def _share(pairs: np.ndarray, own: np.ndarray) -> float:
    return float(np.isin(pairs, own).mean()) if len(pairs) else 0.0


def _differences(templates: dict[str, list[np.ndarray]], foreign: list[np.ndarray]) -> dict[str, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """For each family and template, its pairs and the other's pairs that are not in both, for each similar one."""
    out = {}
    for family, own in templates.items():
        others = [u for other, us in templates.items() if other != family for u in us] + foreign
        out[family] = [
            [(np.setdiff1d(t, u), np.setdiff1d(u, t)) for u in others if len(np.intersect1d(t, u)) >= SIMILAR * min(len(t), len(u))]
            for t in own
        ]
    return out


def fit(corpus: list[str]) -> Model:
    """Train on the templates' variants, the near misses and paragraphs of the corpus that hold no template."""
    rng = random.Random(SEED)
    templates = {family: [np.unique(p) for p in grams(list(texts))[0]] for family, texts in TEMPLATES.items()}
    foreign = [np.unique(p) for p in grams(list(FOREIGN))[0]]
    every = [t for ts in templates.values() for t in ts]
    plain = [p for p, own in zip(corpus, grams(corpus)[0] if corpus else []) if not any(np.isin(t, own).mean() >= 0.4 for t in every)]
    vocabulary = grams([t for ts in TEMPLATES.values() for t in ts] + [*NEAR_MISSES, *FOREIGN])[1]
    known = np.unique(np.concatenate(vocabulary))
    # Paragraphs without a known feature are all the same to the model: one stands for them.
    plain = [p for p, own in zip(plain, grams(plain)[1] if plain else []) if np.isin(own, known).any()]
    rows = [(0, text) for text in ["", *NEAR_MISSES, *plain]] + [(0, v) for notice in FOREIGN for v in variants(notice, rng)]
    for k, family in enumerate(FAMILIES[1:], 1):
        rows += [(k, v) for template in TEMPLATES[family] for v in variants(template, rng)]
    rng.shuffle(rows)
    labels = np.array([k for k, _ in rows])
    features = grams([text for _, text in rows])[1]
    model = Model(known, np.zeros((len(known), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, templates, _differences(templates, foreign))
    x = np.zeros((len(rows), len(known)))
    for k, own in enumerate(features):
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        np.add.at(x[k], at[known[at] == own], 1.0)
    learn, tune = slice(0, 4 * len(rows) // 5), slice(4 * len(rows) // 5, None)
    x, tuned, y = x[learn], features[tune], np.eye(len(FAMILIES))[labels[learn]]
    share = 1 / np.maximum(1, np.bincount(labels[learn], minlength=len(FAMILIES)))[labels[learn]]
    share = (share / share.sum())[:, None]
    speed_w, speed_b = np.full_like(model.weights, 1e-8), np.full_like(model.bias, 1e-8)
    for _ in range(STEPS):
        scores = x @ model.weights + model.bias
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - y) * share
        down, down_b = x.T @ error + DECAY * model.weights, error.sum(axis=0)
        speed_w += down**2
        speed_b += down_b**2
        model.weights -= 0.1 * RATE * down / np.sqrt(speed_w)
        model.bias -= 0.1 * RATE * down_b / np.sqrt(speed_b)
    scores = model.logits(tuned)

    def loss(temperature: float) -> float:
        s = scores / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), labels[tune]] - np.log(np.exp(s).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.5, 8, 33), key=loss)
    return model


def train(df: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit with paragraphs of SAMPLE_DOCS documents, chosen by a hash of the key; the rest never leaves Spark.

    Of those documents' paragraphs of up to SAMPLE_CHARS characters, at most SAMPLE_PARAGRAPHS are taken, by their hash.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).filter("key is not null")
    chosen = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
    paragraphs = rows.join(F.broadcast(chosen), "key").select(F.explode(F.split("text", "\n")).alias("p")).filter(F.length("p").between(1, SAMPLE_CHARS)).distinct()
    paragraphs = paragraphs.orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS)
    return fit(sorted(r["p"] for r in paragraphs.collect()))


def wrapped(lines: list[str], owners: list[int], model: Model) -> list[tuple[int, int]]:
    """Ranges of lines, two or more each, that together hold LEAST_TEMPLATE of a template's word pairs.

    ``owners``: a number for each line, the same for neighbouring lines that may belong together. Lines without a
    word, as in a block of comments, part what stands above and below them.
    """
    words, counts = hashed_words([line.lower().encode() for line in lines], _PLAIN)
    line_of = np.repeat(np.arange(len(lines)), counts)
    if len(words) < 2:
        return []
    block = np.cumsum(np.r_[True, (np.diff(owners) != 0) | (counts[1:] == 0) | (counts[:-1] == 0)])[line_of]
    pairs = shingle_hashes(words, np.array([len(words)]), 2)[0]
    known = [t for templates in model.templates.values() for t in templates]
    every = np.unique(np.concatenate(known))
    at = np.minimum(np.searchsorted(every, pairs), len(every) - 1)
    hits = np.flatnonzero((every[at] == pairs) & (block[1:] == block[:-1]))
    has = np.stack([np.isin(every, t) for t in known])
    needed = np.array([LEAST_TEMPLATE * len(t) for t in known])
    found = set()
    for own in np.split(hits, np.flatnonzero(np.diff(block[hits])) + 1):
        if len(own) < needed.min() or line_of[own[0]] == line_of[own[-1] + 1]:
            continue
        for k in np.flatnonzero(has[:, np.unique(at[own])].sum(axis=1) >= needed):
            places = own[has[k, at[own]]]
            i = 0
            while i < len(places):
                # The least stretch from here on that has the best share within twice the template's length.
                near = places[i : np.searchsorted(places, places[i] + 2 * len(known[k]))]
                first = np.sort(np.unique(at[near], return_index=True)[1])
                if len(first) < needed[k]:
                    i += 1
                    continue
                near = near[: first[-1] + 1]
                last = np.unique(at[near[::-1]], return_index=True)[1]
                a, z = int(line_of[near[len(near) - 1 - last.max()]]), int(line_of[near[-1] + 1])
                if a < z:
                    found.add((a, z + 1))
                i += int(first[-1]) + 1
    return sorted(found)


def _alternatives(line: str) -> list[tuple[str, int, int]]:
    """(paragraph, start, end) in the line of each licence of an SPDX expression; the line itself where there is none."""
    found = _SPDX.fullmatch(line)
    if not found or not _OPERATOR.search(found[2]):
        return [(line, 0, len(line))]
    out, at = [], found.end(1)
    for operator in [*_OPERATOR.finditer(line, at), None]:
        end = operator.start() if operator else len(line)
        out.append((found[1] + " " + line[at:end], at if out else 0, end))
        at = operator.end() if operator else end
    return out


def scan(texts: list[str | None], model: Model) -> list[list[tuple[str, int, int, int, float, float]]]:
    """(family, paragraph, start, end, probability, template share) of the licence paragraphs of each text; the number
    of a paragraph of several lines is that of its first line. Of overlapping ones the best confirmed stays."""
    out: list[list[tuple]] = [[] for _ in texts]
    paragraphs, owners, groups = [], [], []
    for k, text in enumerate(texts):
        start = 0
        for n, line in enumerate((text or "").split("\n")):
            if stripped := line.strip():
                begin = start + line.index(stripped)
                together = owners and owners[-1][0] == k and owners[-1][1] == n - 1
                groups.append(groups[-1] if together else len(groups))
                paragraphs.append(stripped)
                owners.append((k, n, begin, begin + len(stripped)))
            start += len(line) + 1
    ranges = wrapped(paragraphs, groups, model)
    alone = [(one, (k, n, begin + a, begin + z, n)) for line, (k, n, begin, _) in zip(paragraphs, owners) for one, a, z in _alternatives(line)]
    spans = [span for _, span in alone] + [(*owners[i][:3], owners[j - 1][3], owners[j - 1][1]) for i, j in ranges]
    judged = model.classify([one for one, _ in alone]) + model.classify([" ".join(paragraphs[i:j]) for i, j in ranges])
    several: list[list[tuple]] = [[] for _ in texts]
    for (k, n, a, z, last), (family, probability, shared) in zip(spans, judged):
        if family == UNKNOWN:
            continue
        if n == last:
            out[k].append((family, n, a, z, probability, shared))
        else:
            several[k].append((family, n, a, z, probability, shared))
    for k, longer in enumerate(several):
        for one in sorted(longer, key=lambda f: (-f[5], -f[4], f[3] - f[2])):
            over = [f for f in out[k] if f[2] < one[3] and one[2] < f[3]]
            if all((one[5], one[4]) > (f[5], f[4]) for f in over):
                out[k] = sorted([f for f in out[k] if f not in over] + [one], key=lambda f: f[2])
    return out


def with_licenses(df: DataFrame, model: Model, text: str = "text", into: str = "licenses") -> tuple[DataFrame, str]:
    """Add an array of (family, paragraph, start, end, probability, template) for the lines, and runs of lines over
    which a notice is wrapped, that give a licence.

    Offsets are code points of the whole text; null, empty and blank texts have none; every row stays.
    """
    name = free_name(df, into)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<family:string,paragraph:int,start:int,end:int,probability:double,template:double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("family", "paragraph", "start", "end", "probability", "template")
        for batch in batches:
            texts = batch.tolist()
            found = [x for a, b in blocks((len(t or "") for t in texts), BLOCK_CHARS) for x in scan(texts[a:b], shared.value)]
            yield pd.Series([[dict(zip(names, f)) for f in own] for own in found], dtype=object)

    return df.withColumn(name, find.asNondeterministic()(F.col(f"`{text}`").cast("string"))), name
