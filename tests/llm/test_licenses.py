import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumenframe.llm import licenses as L

SF = "/root/testdata/sf0.01"
TEXTS = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
MODEL = L.train(L.paragraphs_of([(x or "").split("\n")[-1] for x in TEXTS.values()]), steps=200)
# wordings and licences that the training has not seen
HELD = {
    "mit": ("This package comes with the MIT license attached.", "We put this out under the MIT License in 2019."), "gpl": ("The code may be copied under GPL-3.0-only terms.", "GNU General Public License, version 2, applies to it all."),
    "apache-2.0": ("Everything in here falls under the Apache License, Version 2.0", "Apache-2.0 licensed"), "bsd": ("This module uses the BSD 3-Clause License", "The 2-Clause BSD License covers the tools."),
    "mpl": ("The Mozilla Public License, v. 2.0, governs these files.", "MPL-2.0 applies"), "zlib": ("The sources have the zlib license.", "The zlib/libpng license is used for them."), "cc-by-sa": ("The text is shared under CC BY-SA 4.0 by its authors", "Images: CC BY-SA 3.0."),
    "lgpl": ("Linked under the GNU Lesser General Public License, version 3", "LGPL-2.1-or-later for the library part"), "agpl": ("The server is under the GNU Affero General Public License, version 3", "AGPL-3.0-only for the server"), "epl": ("Eclipse Public License 2.0 for the plug-ins", "The Eclipse Public License, version 1.0, applies."),
    "cc-by-nc": ("The pictures are under CC BY-NC 4.0 here", "CC BY-NC 3.0 for the sounds"), "isc": ("The ISC License is used for the daemon", "It is under the ISC License."), "cc0": ("The data is under CC0 1.0", "CC0-1.0 for the tables"),
}
UNSEEN = (
    "Licensed under the Academic Free License", "This font is under the SIL Open Font License, Version 1.1", "Released under the WTFPL.", "Published under the Eiffel Forum License, version 2", "License: Artistic-2.0", "SPDX-License-Identifier: PostgreSQL",
    "Licensed under the European Union Public Licence", "Licensed under the Microsoft Public License", "Licensed under the Open Software License 3.0", "Distributed under the terms of the Sleepycat License.", "This work is licensed under the Design Science License.", "Distributed under the Q Public License, version 1.0.",
)


@pytest.mark.parametrize("family", L.FAMILIES)
def test_templates_are_found(family):
    for t in [*L.notices(family, L.FORMS), *L.FAMILIES[family][2]]:
        got = MODEL.scan(f"Some words before it.\n{t}\nand after")
        assert [(r[0], r[1], r[4]) for r in got] == [(1, family, True)], t


@pytest.mark.parametrize("line", L.OTHERS)
def test_lines_that_sound_like_licences_are_not(line):
    assert not any(r[4] for r in MODEL.scan(line))


def test_spelling_and_identifiers():
    for line, family in (("Distributed under the terms of the MIT licence.", "mit"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("Licensed under the zlib licence", "zlib"), ("License: CC-BY-4.0", "cc-by")):
        assert [(r[1], r[4]) for r in MODEL.scan(line)] == [(family, True)], line


def test_unseen_licences_are_unknown():
    for line in UNSEEN:
        p = MODEL.probabilities(L.parsed(line))
        assert p[-1] > 0.5 and not any(r[4] for r in MODEL.scan(line)), (line, p[-1])


def test_probabilities_are_calibrated_on_unseen_wordings():
    """Of held-out notices and licences: the mean probability of the answers is close to the share of right ones."""
    rows = [(f, t) for f, ts in HELD.items() for t in ts] + [(L.UNKNOWN, t) for t in UNSEEN]
    p = [MODEL.probabilities(L.parsed(t)) for _, t in rows]
    right = [MODEL.families[int(x.argmax())] == f for x, (f, _) in zip(p, rows)]
    assert np.mean(right) >= 0.85 and abs(np.mean(right) - np.mean([x.max() for x in p])) < 0.12
    loss = -np.mean([math.log(x[MODEL.families.index(f)]) for x, (f, _) in zip(p, rows)])
    assert loss < 0.6


def brute(model, line):
    """Family, probability and similarity by plain sums over every 1- and 2-gram, without any shortcut."""
    words = [{"licence": "license", "licences": "licenses", "licenced": "licensed", "unauthorised": "unauthorized"}.get(w, w) for w in "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in line).split(" ") if w]
    words = [w.encode() for w in words]
    own = {*words, *((a, b) for a, b in zip(words, words[1:]))}
    z = [float(model.bias[k]) + sum(float(model.weights[i, k]) for g, i in model.features.items() if g in own) for k in range(len(model.families))]
    top = max(z)
    e = [math.exp((x - top) / model.temperature) for x in z]
    k = max(range(len(z)), key=z.__getitem__)
    family, p = model.families[k], e[k] / sum(e)
    if family == L.UNKNOWN or p < L.LEAST:
        return L.UNKNOWN, None, None
    bigrams = {(a, b) for a, b in zip(words, words[1:])}
    return family, p, max(len(t & bigrams) / len(t) for t in model.templates[family])


def test_scan_against_brute_force_over_all_documents(spark):
    """Every line of the table, also those that the scan skips."""
    got = {(r.doc_id, r.line): (r.family, r.probability, r.similarity) for r in L.scan(spark.read.parquet(f"{SF}/documents.parquet"), MODEL).collect()}
    used = set(MODEL.features)
    for i, x in TEXTS.items():
        for k, line in enumerate((x or "").split("\n")):
            if k % 7 and (i, k) not in got and used.isdisjoint(L.grams(L.parsed(line))):
                continue  # sums of nothing: a seventh of them will do
            family, p, s = brute(MODEL, line)
            if family == L.UNKNOWN:
                assert (i, k) not in got or got[i, k][0] != L.UNKNOWN and got[i, k][2] >= L.CONFIRMED  # a block's first line
            else:
                assert got[i, k] == (family, pytest.approx(p, rel=1e-4), pytest.approx(s))


def test_wrapped_notice_is_found_as_a_block():
    t = "Permission is hereby granted, free of\ncharge, to any person obtaining a\ncopy of this software and associated\ndocumentation files (the Software), to\ndeal in the Software without restriction"
    assert [(r[0], r[1], r[4]) for r in MODEL.scan(f"intro\n\n{t}\n\nend")] == [(2, "mit", True)]
    long = "filler words " * 30_000
    assert [(r[0], r[1], r[4]) for r in MODEL.scan(f"{long}\n\n{t}\n\n{long} Released under the MIT License.")] == [(2, "mit", True), (8, "mit", True)]


def test_whole_paragraphs_are_sampled(spark):
    """The grams of a sampled line are those of all of it, also behind 5,000 characters."""
    text = "filler words " * 400 + "granted to persons under a copyright"
    df = spark.createDataFrame([(i, f"\n{text}\n") for i in range(20)] + [(20, None), (None, text)], "doc_id long, text string")
    got = L.sample_paragraphs(df, "doc_id", "text", 10)
    assert len(got) >= 9 and all(b"copyright" in g and (b"under", b"a") in g and set(w) <= set(text.encode().split()) for g, w in got)


def test_documents(spark):
    from lumenframe.llm.queries import op6

    rows = op6(spark, SF).collect()
    known = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    want = {(i, k, known[line]) for i, t in TEXTS.items() for k, line in enumerate(t.split("\n")) if line in known}
    assert want <= {(r.doc_id, r.line, r.family) for r in rows if r.confirmed} and len(rows) <= len(want) + 2


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "All rights reserved.", 1), (2, "", 2), (2, "All rights reserved.\nAll rights reserved.", 3)], "doc_id long, text string, family int")
    assert sorted((r.doc_id or 0, r.line) for r in L.scan(df, MODEL).collect()) == [(0, 0), (2, 0), (2, 1)]
    assert L.scan(df.limit(0)).count() == 0
