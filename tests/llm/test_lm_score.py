import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import lm_score as L

TEXTS = ["the cat sat on the mat", "The dog sat on the log. the dog", "", "a\tb\nc d\x0be", "zß≠ the", "the the the cat cat sat", None, "x" * 300]


class Brute:
    """A dictionary trie: explicit escapes, and symbols of longer contexts excluded one by one."""

    def __init__(self, texts, order):
        self.order = order
        runs = Counter(r for t in texts for r in self.runs(t))
        self.counts = {order: runs}
        for k in range(order - 1, -1, -1):
            self.counts[k] = Counter((c[1:], s) for c, s in self.counts[k + 1])
        self.seen = {k: {} for k in self.counts}
        for k, found in self.counts.items():
            for (c, s), n in found.items():
                self.seen[k].setdefault(c, {})[s] = n
        self.cuts = {k: L.discounts([sum(n == j for n in c.values()) for j in (1, 2, 3, 4)]) for k, c in self.counts.items()}

    def runs(self, text):
        s = [L.END] * self.order + list((text or "").encode().translate(L.LOWER)) + [L.END]
        return [(tuple(s[i - self.order : i]), s[i]) for i in range(self.order, len(s))]

    def p(self, context, symbol):
        """The probability of a symbol in a context, from its longest known ending."""
        if not context and () not in self.seen[0]:
            return 1 / 256
        here = self.seen[len(context)].get(context)
        below = (lambda s: self.p(context[1:], s)) if context else (lambda s: 1 / 256)
        if here is None:
            return below(symbol)
        cuts, total = self.cuts[len(context)], sum(here.values())
        mass = sum(cuts[min(n, 3)] for n in here.values()) / total
        if symbol in here:
            return (here[symbol] - cuts[min(here[symbol], 3)]) / total + mass * below(symbol)
        known = sum(below(s) for s in here)
        escape = mass * (1 - known)
        return escape * below(symbol) / (1 - known)

    def score(self, text):
        return sum(math.log10(self.p(c, s)) for c, s in self.runs(text))


@pytest.mark.parametrize("order,share", [(0, 1e-6), (2, 0.01), (3, 2.0), (6, 0.03)])
def test_scores_agree_with_a_dictionary_trie(spark, order, share):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    docs = spark.createDataFrame(docs.orderBy("doc_id").collect(), docs.schema)
    trained = L.train(docs.where("doc_id % 3 <> 2"), order=order)
    rows = {r.doc_id: r for r in L.score(docs, trained, F.col("doc_id") % 3 == 2, frequent_share=share, hot_share=0.05).collect()}
    own = [t for i, t in enumerate(TEXTS) if i % 3 != 2]
    brute = Brute(own, order)
    tokens = Counter(w for t in own for w in [*(t or "").encode().translate(L.LOWER).split(), b"\n"])
    n, v = sum(tokens.values()), len(tokens)
    assert len(rows) == len(TEXTS) and (trained.tokens, trained.words) == (n, v)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        words = [*(t or "").encode().translate(L.LOWER).split(), b"\n"]
        assert r.score == pytest.approx(brute.score(t), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in tokens for w in words), n, i % 3 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words))


def test_probabilities_of_a_context_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = L.train(docs, order=2)
    every = np.arange(256, dtype=np.uint64)
    for context in (b"th", b"\xff\xff", b"qq", b" t"):
        p = 10 ** model.score((np.uint64(context[1]) << np.uint64(16)) | (np.uint64(context[0]) << np.uint64(8)) | every)
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_long_texts_in_pieces_and_counts_in_several_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(400))
    found = list(L.pieces(text.encode(), 100))
    assert b"".join(p for _, p, _ in found).decode() == text and all(p.endswith(b" ") for _, p, last in found if not last)
    assert [p for _, p, _ in L.pieces(b"x" * 300 + b" y", 100)] == [b"x" * 300 + b" ", b"y"]
    whole = L.codes_of([(b"", text.encode(), True)], 6)[0]
    assert (np.sort(L.codes_of(found, 6)[0]) == np.sort(whole)).all() and len(whole) == len(text) + 1
    docs = spark.createDataFrame([(1, text), (2, text[:500])], "doc_id long, text string").coalesce(1)
    trained = L.train(docs, most_runs=200, most_words=20)
    rows = {r.doc_id: r.score for r in L.score(docs, trained, F.lit(False)).collect()}
    brute = Brute([text, text[:500]], 6)
    assert rows[1] == pytest.approx(brute.score(text), rel=1e-9) and rows[2] == pytest.approx(brute.score(text[:500]), rel=1e-9)


def test_packed_numbers_come_back():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (L.unpacked(L.packed(x), len(x)) == x).all() and len(L.unpacked(L.packed(x[:0]), 0)) == 0


def test_no_training_text_repeated_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (None, "q", None)], "doc_id long, text string, word string")
    rows = L.score(docs, L.train(docs.limit(0)), F.lit(False)).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert rows[0].score == pytest.approx(-4 * math.log10(256)) or rows[0].score == pytest.approx(-2 * math.log10(256))
    assert L.score(docs.limit(0), L.train(docs), F.lit(False)).count() == 0


@pytest.mark.parametrize("sf,n", [("0.01", 1_000), ("0.1", 10_000)])
def test_better_than_word_counts_on_held_out_documents(spark, sf, n):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = L.score(docs, L.train(docs.where(~held)), held).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert rows[0] > rows[1] and rows[2] == sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in range(n))


def test_adaptive_scores(spark):
    docs = spark.createDataFrame([(1, "ab" * 50), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in L.adaptive_scores(docs).collect()}
    assert got[2] == pytest.approx(-math.log10(256)) and got[1] / 101 > -0.2


def test_every_run_is_kept_whatever_the_corpus(spark):
    texts = ["abcdefgh"] + ["the same text over and over again"] * 2000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    trained, brute = L.train(docs), Brute(texts, 6)
    for share in (3e-7, 0.01, 2.0):  # what is broadcast changes no result
        rows = {r.doc_id: r for r in L.score(docs.where("doc_id < 2"), trained, F.lit(False), frequent_share=share).collect()}
        assert all(rows[i].score == pytest.approx(brute.score(texts[i]), rel=1e-9) for i in (0, 1))
