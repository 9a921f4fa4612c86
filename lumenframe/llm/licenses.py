"""Licence scans of paragraphs by a trained classifier, confirmed by comparison with templates.

A multinomial logistic regression over the presence of word 1- and 2-grams tells licence families and an unknown class
apart. Its templates are notices (forms of words with a licence's names in them, SPDX lines) and sentences of licence
texts; it is trained on varied copies of them, against paragraphs of the corpus (a line each of at most most_plain documents,
those with the smallest hashes of their ids), lines that only sound like licences, and the same notices with other
names, so that a licence that it does not know is unknown. Whole forms of notices, and the names in some of the
others, are held out of training: on these a temperature calibrates the probabilities. A family counts if its
probability is at least LEAST; it is confirmed if one of its templates has at least CONFIRMED of its 2-grams in the paragraph.

Paragraphs are lines, and, where none of a block's lines is confirmed, the block of lines between blank ones. Features
are the words and pairs of the templates that are rare in the corpus. Each has a telling word: itself, or the rarer one of a
pair of common words. A paragraph without telling words has the bias alone, which says unknown (train() sees to
that), and need not be scored.

Edge cases: null and empty texts have no paragraphs; every paragraph with a family gives a row, also repeated ones; a
null doc_id stays null; an empty corpus trains on the templates and the fixed lines alone; lines of any length are
read whole; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import received, sent

LEAST, CONFIRMED, UNKNOWN, RARE = 0.5, 0.7, "unknown", 0.002  # RARE: the share of the corpus' paragraphs that may have a feature
# For each family its names, its SPDX identifiers, and sentences of its notice or text.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": (("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"), ("Apache-2.0",), ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")),
    "mit": (("the MIT License", "the terms of the MIT license", "MIT"), ("MIT", "MIT-0"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",)),
    "bsd": (("the BSD License", "the BSD 3-Clause License", "the 2-Clause BSD License", "a BSD-style license"), ("BSD-2-Clause", "BSD-3-Clause"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")),
    "gpl": (("the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL", "the GPL", "GPLv2", "GPLv3"), ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program.")),
    "lgpl": (("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License, version 3", "the GNU LGPL", "the LGPL", "LGPLv3"), ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",)),
    "agpl": (("the GNU Affero General Public License, version 3", "the GNU AGPL", "the AGPL", "AGPLv3"), ("AGPL-3.0-only", "AGPL-3.0-or-later"), ("You should have received a copy of the GNU Affero General Public License along with this program.",)),
    "mpl": (("the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the MPL 2.0"), ("MPL-2.0", "MPL-1.1"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    "epl": (("the Eclipse Public License 2.0", "the Eclipse Public License, version 1.0", "the EPL 2.0"), ("EPL-1.0", "EPL-2.0"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",)),
    "zlib": (("the zlib license", "the zlib/libpng license"), ("Zlib",), ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",)),
    "bsl-1.0": (("the Boost Software License, Version 1.0", "the Boost Software License", "the Boost License"), ("BSL-1.0",), ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt",)),
    "isc": (("the ISC License", "the ISC license terms"), ("ISC",), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",)),
    "unlicense": (("the Unlicense",), ("Unlicense",), ("This is free and unencumbered software released into the public domain.",)),
    "cc0": (("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "CC0"), ("CC0-1.0",), ("To the extent possible under law, the author has waived all copyright and related rights to this work.",)),
    "cc-by": (("CC BY 4.0", "CC BY 3.0", "a Creative Commons Attribution 4.0 International License"), ("CC-BY-4.0", "CC-BY-3.0"), ()),
    "cc-by-sa": (("CC BY-SA 4.0", "CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-SA-4.0", "CC-BY-SA-3.0"), ()),
    "cc-by-nc": (("CC BY-NC 4.0", "CC BY-NC 3.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-NC-4.0", "CC-BY-NC-3.0"), ()),
    "cc-by-nd": (("CC BY-ND 4.0", "CC BY-ND 3.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"), ("CC-BY-ND-4.0", "CC-BY-ND-3.0"), ()),
    "cc-by-nc-sa": (("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("CC-BY-NC-SA-4.0",), ()),
    "cc-by-nc-nd": (("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), ("CC-BY-NC-ND-4.0",), ()),
    "proprietary": ((), (), ("All rights reserved.", "Copyright 2024. All rights reserved.", "This document is confidential and proprietary.", "Unauthorized copying is prohibited.")),
}
# Forms of notices, for training and held out for calibration.
FORMS = ("Licensed under {}.", "Released under {}.", "This project is licensed under {}.", "Distributed under the terms of {}.", "This work is licensed under {}.", "Distributed under {}.", "This file is available under {}; see the LICENSE file.", "You may use this work under the terms of {}.", "License: {}", "This program is free software under {}.")
HELD_FORMS = ("Made available under {}.", "All code here is subject to {}.", "Copyright 2024 the authors, published under {}.")
SPDX = "SPDX-License-Identifier: {}"
# How other licences are called; {} is a word of the corpus or a made-up one.
OTHER_NAMES = ("the {} License", "the {} Public License", "the {} License, Version 2.0", "a {} license", "{}-1.0", "{} 4.0", "the {} Public License, version 3", "the {} Software License", "the {} General License", "{}", "the {} {} License, Version 1.1", "the {} {} Public License", "the {} {} License 2.0", "the {}, version 1.0")
# Lines that share words with licences and are none.
OTHERS = (
    "The driver needs a licence to use public roads.", "Permission to leave early was granted by the teacher.", "The Apache helicopter flew over the public square.", "Version 2.0 of the game was released in June.", "She studied at MIT before the work began.",
    "The committee reserved all seats in the front.", "Free software is a topic of general interest.", "Source and binary packages are available.", "The public library opens under new rules.", "Conditions apply to the following offers.", "He was released under the terms of an agreement.", "All human rights are universal.",
    "A creative commons is a space shared by artists.", "The domain of the function is restricted.", "This file is part of the archive.", "The mayor licensed a new market.", "The GNU is an antelope of the plains.", "Mozilla published a report.", "Copyright law was debated in parliament.", "The lesser general was sent to the public gate.",
    "A boost to the software market.", "The eclipse was public and free to watch.", "Both clauses of the contract were read out.", "The license plate was found near the road.", "Rights and duties of the authors.", "The software is provided with a manual.",
)
PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 or b == 10 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
SPELLED = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed", b"unauthorised": b"unauthorized"}
FILLERS, FILLER_BYTES = 8, 40  # words kept of a paragraph of the corpus, each of so many bytes at most, to vary the copies with


def words_of(line: bytes) -> list[bytes]:
    """Words of a line that has been through PLAIN, in one spelling."""
    words = line.split()
    return words if SPELLED.keys().isdisjoint(words) else [SPELLED.get(w, w) for w in words]


def plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN)


def parsed(text: str) -> list[bytes]:
    return words_of(plain(text))


def pairs(words: list[bytes]) -> set:
    return set(zip(words, words[1:]))


def grams(words: list[bytes]) -> set:
    return {*words, *zip(words, words[1:])}


def notices(family: str, forms: tuple[str, ...]) -> list[str]:
    names, ids, _ = FAMILIES[family]
    return [f.format(n) for f, n in product(forms, dict.fromkeys((*names, *ids)))] + [SPDX.format(i) for i in ids]


TEMPLATES = {f: [*notices(f, FORMS + HELD_FORMS), *FAMILIES[f][2]] for f in FAMILIES}


def vocabulary() -> frozenset:
    """The words of all templates."""
    return frozenset(w for ts in TEMPLATES.values() for t in ts for w in parsed(t))


class Model:
    """Features, weights and templates; classify() gives (family, probability, template similarity)."""

    def __init__(self, features: dict, telling: frozenset, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.features, self.telling, self.families, self.weights, self.bias, self.temperature = features, telling, families, weights, bias, temperature
        self.templates = {f: [pairs(parsed(t)) for t in TEMPLATES[f] if len(parsed(t)) > 1] for f in families if f in TEMPLATES}

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        at = [self.features[g] for g in grams(words) if g in self.features]
        x = (self.bias + self.weights[at].sum(0)) / self.temperature
        p = np.exp(x - x.max())
        return p / p.sum()

    def similarity(self, family: str, words: list[bytes]) -> float:
        own = pairs(words)
        return max(len(t & own) / len(t) for t in self.templates[family])

    def classify(self, words: list[bytes]) -> tuple[str, float, float]:
        p = self.probabilities(words)
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] < LEAST:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)]), 0.0
        return family, float(p[k]), self.similarity(family, words)

    def scan(self, text: str) -> list[tuple[int, str, float, float, bool]]:
        """(first line, family, probability, similarity, confirmed) of the paragraphs of a text that have a family."""
        data = plain(text)
        if self.telling.isdisjoint(words_of(data)):
            return []
        lines = [words_of(x) for x in data.split(b"\n")]
        found, start = [], 0
        for i in range(len(lines) + 1):
            if i < len(lines) and lines[i]:
                continue
            rows = [(j, *self.classify(lines[j])) for j in range(start, i) if not self.telling.isdisjoint(lines[j])]
            rows = [(j, f, p, s, s >= CONFIRMED) for j, f, p, s in rows if f != UNKNOWN]
            if not any(r[4] for r in rows) and i - start > 1:
                f, p, s = self.classify([w for line in lines[start:i] for w in line])
                if f != UNKNOWN and s >= CONFIRMED:
                    rows = [(start, f, p, s, True)]
            found += rows
            start = i + 1
        return found


def varied(words: list[bytes], filler: list[bytes], rng, c: int) -> list[bytes]:
    """The c-th copy of a template: now and then a word is missing, or other words stand before or after it."""
    out = [x for x in words if c == 0 or rng.random() > 0.06]
    extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(1, 12))]
    return extra + out if c % 3 == 1 else out + extra if c % 3 == 2 else out


def train(paragraphs: list[tuple[list, list[bytes]]], seed: int = 6, copies: int = 6, steps: int = 250) -> Model:
    """The model of varied templates against the given paragraphs of a corpus: their grams within the vocabulary, and some words."""
    rng = np.random.default_rng(seed)
    every = [pairs(parsed(t)) for ts in TEMPLATES.values() for t in ts if len(parsed(t)) > 1]
    plain_grams = [set(g) for g, _ in paragraphs]
    plain_grams = [g for g in plain_grams if not any(len(t & g) >= CONFIRMED * len(t) for t in every)]
    common: dict = {}
    for own in plain_grams:
        for g in own:
            common[g] = common.get(g, 0) + 1
    rare = lambda g: common.get(g, 0) <= RARE * len(plain_grams)
    of_templates = {g for ts in TEMPLATES.values() for t in ts for g in grams(parsed(t))}
    features = {g: i for i, g in enumerate(sorted((g for g in of_templates if rare(g) and (isinstance(g, tuple) or len(g) > 1)), key=repr))}
    single = {g for g in features if isinstance(g, bytes)}
    telling = frozenset(single | {min(g, key=lambda w: (common.get(w, 0), w)) for g in features if isinstance(g, tuple) and single.isdisjoint(g)})
    families = [*FAMILIES, UNKNOWN]
    none = len(families) - 1
    filler = sorted({w for _, words in paragraphs for w in words} - vocabulary()) or [b"text", b"more"]
    rows: list[tuple[set, int, bool]] = []  # grams, class, held out
    for k, family in enumerate(families[:-1]):
        for held, forms in ((False, FORMS), (True, HELD_FORMS)):
            for t in dict.fromkeys(notices(family, forms) + ([] if held else list(FAMILIES[family][2]) * 6)):
                rows += [(grams(varied(parsed(t), filler, rng, c)), k, held) for c in range(copies)]
        for t in FAMILIES[family][2]:
            rows += [(grams(varied(parsed(t), filler, rng, c)), k, c % 4 == 3) for c in range(copies * 6)]
    made = lambda: "".join(rng.choice(list("bcdfghklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 5)))
    for held, forms in ((False, FORMS), (True, HELD_FORMS)):  # the same notices with other names
        for form, name in product((*forms, SPDX), OTHER_NAMES):
            for c in range(copies * 3):
                word = lambda: made() if rng.random() < 0.5 else filler[rng.integers(0, len(filler))].decode("utf-8", "replace")  # noqa: E731, B023
                rows.append((grams(varied(parsed(form.format(name.format(word(), word()))), filler, rng, c)), none, held))
    words = sorted(telling) or [b"license"]
    for c in range(400):  # telling words out of order are no licence
        rows.append((grams([words[rng.integers(0, len(words))] if rng.random() < 0.3 else filler[rng.integers(0, len(filler))] for _ in range(rng.integers(3, 15))]), none, c % 4 == 3))
    rows += [(grams(varied(parsed(t), filler, rng, c)), none, c % 4 == 3) for t in OTHERS for c in range(8)]
    rows += [(g, none, i % 4 == 3) for i, g in enumerate(plain_grams)]
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (own, _, _) in enumerate(rows):
        x[i, [features[g] for g in own if g in features]] = 1
    y, held = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    weights, bias = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    one, m, v = np.eye(len(families), dtype=np.float32)[y[~held]], [0, 0], [0, 0]
    xt = x[~held]
    for step in range(1, steps + 1):
        z = xt @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - one) / len(xt)
        for j, (w, g) in enumerate(((weights, xt.T @ p + 1e-5 * weights), (bias, p.sum(0)))):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            w -= 0.1 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    bias[none] = max(bias[none], bias.max() + 1)  # without any feature: unknown
    z, best = x[held] @ weights + bias, (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 8, 31):
        p = z / temperature
        p = p - p.max(1, keepdims=True)
        loss = float((np.log(np.exp(p).sum(1)) - p[np.arange(len(p)), y[held]]).mean())
        best = min(best, (loss, float(temperature)))
    return Model(features, telling, families, weights, bias, best[1])


def sample_paragraphs(docs: DataFrame, doc_id: str, text: str, most_plain: int) -> list[tuple[list, list[bytes]]]:
    """A whole line each of at most most_plain documents, those with the smallest hashes of their ids: its grams of template words, and some of its words.

    Of a document's lines with words, the one with the smallest hash.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    chosen = own.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most_plain)
    known = vocabulary()

    def run(batches):
        import xxhash

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [line for line in plain(x).split(b"\n") if line.strip()]
                if not lines:
                    continue
                words = words_of(min(lines, key=lambda line: (xxhash.xxh3_64_intdigest(line), line)))
                found = sorted({w for w in words if w in known}) + [b" ".join(g) for g in sorted(g for g in pairs(words) if known.issuperset(g))]
                some = sorted((w for w in set(words) if len(w) <= FILLER_BYTES), key=lambda w: (xxhash.xxh3_64_intdigest(w), w))[:FILLERS]
                yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "grams": pa.array([found], pa.list_(pa.binary())), "words": pa.array([some], pa.list_(pa.binary()))})

    got = own.join(F.broadcast(chosen), "id").select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, grams array<binary>, words array<binary>").orderBy("id", "grams").toArrow()
    split = lambda g: tuple(g.split(b" ")) if b" " in g else g
    return [([split(bytes(g)) for g in r["grams"]], [bytes(w) for w in r["words"]]) for r in got.to_pylist()]


def paragraphs_of(lines: list[str]) -> list[tuple[list, list[bytes]]]:
    """Lines as train() takes them."""
    known = vocabulary()
    own = [parsed(line) for line in lines]
    return [([*{w for w in words if w in known}, *(g for g in pairs(words) if known.issuperset(g))], words[:FILLERS]) for words in own]


def scan(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", most_plain: int = 3_000) -> DataFrame:
    """doc_id, line, family, probability, similarity and confirmed of each paragraph with a licence family."""
    model = train(sample_paragraphs(docs, doc_id, text, most_plain)) if model is None else model
    shared = sent(docs.sparkSession, model)

    def run(batches):
        m = received(shared)
        for batch in batches:
            rows = [(i, *r) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in m.scan(x or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()))], ["doc_id", "line", "family", "probability", "similarity", "confirmed"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, line int, family string, probability double, similarity double, confirmed boolean")
