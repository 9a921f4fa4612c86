import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lumenframe.llm import near_dup as N

RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(3000)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def edited(t, k):
    w = t.split()
    for i in RNG.choice(len(w), k, replace=False):
        w[i] = "new" + str(RNG.integers(10**9))
    return " ".join(w)


def corpus():
    common = text(60)
    docs = [text(int(n)) for n in RNG.integers(20, 400, 150)]
    docs += [f"{common} {text(80)}" for _ in range(60)]
    base = [text(200) for _ in range(30)]
    docs += base + [edited(b, int(k)) for b in base for k in RNG.integers(1, 12, 3)]
    star = text(300)
    docs += [edited(star, 4) for _ in range(120)] + [star]
    docs += [base[0].upper(), base[0] + " .", None, "", "  ", "one two", "One, two!", "one two three"]
    return docs


def brute(docs):
    s = N.Shingler()
    words = [s.words(t) for t in docs]
    shingles = [s.shingles(w) for w in words]
    df = Counter(c for x in shingles for c in set(N.cells_of(x).tolist()))
    n = sum(len(x) > 0 for x in shingles)
    weight = [{h: (1 + math.log(c)) * (1 + N.DAMPING * math.log1p(n / df[h & (N.CELLS - 1)]) / math.log1p(n)) for h, c in Counter(x.tolist()).items()} for x in shingles]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        a, b = weight[i], weight[j]
        low = sum(min(a[h], b[h]) for h in a.keys() & b.keys())
        high = sum(a.values()) + sum(b.values()) - low
        if words[i] == words[j] or high and low / high >= N.LEAST:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in range(len(docs))}


def test_classes_agree_with_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, band string").repartition(5)
    got = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    assert got == brute(docs)
    kept = sorted(r.doc_id for r in N.deduplicated(df).collect())
    assert kept == sorted(set(got.values()))


def test_samples_estimate_weighted_jaccard():
    parameters = N._parameters()
    h = np.sort(RNG.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = RNG.uniform(0.5, 9, 300).astype(np.float32), RNG.uniform(0.5, 9, 300).astype(np.float32)
    x, y = (h[:300], a), (h[100:], b)
    want = N.similarity(x, y)
    got = (N.samples(np.r_[x[0], y[0]], np.r_[x[1], y[1]], np.array([300, 300]), 256, parameters)[[0, 1]])
    assert (got[0] == got[1]).mean() == pytest.approx(want, abs=0.08)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = defaultdict(set)
    for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.component].add(r.node)
    assert got == {0: set(range(41)), 100: set(range(100, 130)), 200: {200, 201}}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words in this one here"), (2, "other words in this one here"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in N.classes(df).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1), (2, 1)]
    assert sorted(r.doc_id or 0 for r in N.deduplicated(df).collect()) == [0, 0, 1]
    assert N.classes(df.limit(0)).count() == 0 and N.deduplicated(df.limit(0)).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS", 16)
    monkeypatch.setattr(N, "STRAYS", 8)
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == brute(docs)


def test_repeated_ids_with_several_texts(spark):
    """Two texts of one id that is the smallest of both: each links its own near copies, and the id links the two groups."""
    words = [f"w{k}" for k in range(240)]
    one, two = " ".join(words[:120]), " ".join(words[120:])
    near = lambda t: t.replace(" w60 ", " changed ").replace(" w180 ", " changed ")
    rows = [(1, one), (1, two), (5, near(one)), (6, near(two)), (7, "nothing like it " * 9), (8, one)]
    got = {(r.doc_id, r.class_id) for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7), (8, 1)}
    assert sorted(r.doc_id for r in N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 7]


def test_recall_of_planted_edits(spark):
    """Texts of 150 words with some words changed, alone or in one place: links against plain Jaccard similarity."""
    rng = np.random.default_rng(11)
    rows, pairs = [], {}
    for k in range(240):
        words = [f"t{rng.integers(0, 3000)}" for _ in range(150)]
        other = list(words)
        n = k % 6
        at = rng.choice(150, n, replace=False) if k % 2 else rng.integers(0, 140) + np.arange(n)
        for i in at:
            other[i] = f"x{rng.integers(0, 3000)}"
        grams = [{tuple(w[i : i + 5]) for i in range(146)} for w in (words, other)]
        pairs[k] = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {k: got[2 * k] == got[2 * k + 1] for k in pairs}
    similar = [k for k, j in pairs.items() if j >= 0.8]
    assert len(similar) > 100 and np.mean([linked[k] for k in similar]) >= 0.97
    assert not any(linked[k] for k, j in pairs.items() if j < 0.77)
