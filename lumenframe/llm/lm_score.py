"""Language-model scores by prediction by partial matching (PPM) over bytes.

Every run of a context of up to ORDER bytes and the symbol after it, of all training texts, is a node; none is left out,
so the model grows with the corpus and is never held in one place. The trie is dealt out to parts by the last CUT bytes
of the context: each part holds all longer contexts with that ending, and the few shorter ones go to every part.

Counts of shorter contexts are of distinct continuations (a run counts once for each longer run that ends in it). The
escape of a context is estimated from its symbols' counts: each gives up the discount of its count (1, 2, or more),
which is estimated for each context length from how many runs occur once, twice, three and four times. Symbols seen in a context are
excluded after its escape, and the shorter context's probabilities are scaled up by what is left without them. With g,
the mass given up, and s, what the shorter context gives to the symbols seen here, a seen symbol gets (count -
discount) / total + g x its probability in the shorter context, the escape has probability g (1 - s), and the symbols
left share it by their probabilities there over 1 - s. So each run has a probability of its own, and each context a
factor g for what it has not seen, and both are known before any text is scored.

What a task counts goes to a part as one packed row, not as a row for each run: sorted codes in byte planes, compressed,
take about a byte each. Texts are scored the same way: the codes of at most 256 documents are sorted with the documents'
numbers in their last byte; runs that are frequent in the corpus are scored from a broadcast table, all others go packed to the
part with their context, which sends back sums by document. Words are counted and looked up alike, by 64-bit hashes.

Edge cases: a null text counts as empty, and an empty text is scored as its end mark alone; a null doc_id is training
text; each input row gives one output row, repeated ids too; with no training text the model is uniform and N = 0; texts
of any length are read in pieces of about a megabyte; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WordHashes, received, sent, stored

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = 0xFF  # no byte of UTF-8
ORDER, CUT = 6, 3
PIECE, GROUP = 1 << 20, 256  # bytes of text in one sorted block; documents whose numbers fit a byte
MOST_PARTS, PART_BYTES = 1 << 13, 1 << 24
END_WORD = b"\n"  # the end token: no word has white space
EIGHT, BYTE = np.uint64(8), np.uint64(0xFF)


# --- codes -----------------------------------------------------------------------------------------------------------


def pieces(text: bytes, most: int = PIECE):
    """The text in runs of about most bytes that end after white space: (left context, piece, whether it is the last)."""
    at = 0
    while True:
        to = at + most
        if to >= len(text):
            yield text[max(0, at - ORDER) : at], text[at:], True
            return
        cut = max(text.rfind(w, at, to) for w in (b" ", b"\n", b"\t", b"\r"))
        if cut < 0:
            cut = min((x for w in (b" ", b"\n", b"\t", b"\r") if (x := text.find(w, to)) >= 0), default=len(text) - 1)
        yield text[max(0, at - ORDER) : at], text[at : cut + 1], False
        at = cut + 1


def codes_of(block: list[tuple[bytes, bytes, bool]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all symbols of some pieces, and how many each piece has.

    A code is the context, last byte first, and then the symbol: sorted codes have each context's runs together, and
    contexts with the same ending side by side. A text starts after order end marks.
    """
    parts, sizes = [], []
    for left, piece, last in block:
        parts += [bytes([END]) * (order - len(left[-order:] if order else b"")), left[-order:] if order else b"", piece, bytes([END]) * last]
        sizes.append(len(piece) + last)
    a = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array(sizes, np.int64)
    starts = np.cumsum(size + order) - size - order
    n = len(a) - order
    if not size.sum():
        return np.zeros(0, np.uint64), size
    codes = a[order:].astype(np.uint64)
    for k in range(1, order + 1):
        codes |= a[order - k : order - k + n].astype(np.uint64) << np.uint64(8 * (order - k + 1))
    if len(block) > 1 and order:
        keep = np.ones(n, bool)
        for k in range(order):
            at = starts[1:] + k - order
            keep[at[at < n]] = False
        codes = codes[keep]
    return codes, size


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often they occur; n: how often each already counts."""
    if n is None:
        codes = np.sort(codes)
    else:
        by = np.argsort(codes, kind="stable")
        codes, n = codes[by], n[by]
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.diff(np.r_[first, len(codes)]) if n is None else np.add.reduceat(n, first)


def run_at(codes: np.ndarray, k: int, order: int) -> np.ndarray:
    """The runs of codes with contexts of k bytes only."""
    return codes if k == order else ((codes >> np.uint64(8 * (order - k + 1))) << EIGHT) | (codes & BYTE)


def part_of(codes: np.ndarray, order: int, parts: int) -> np.ndarray:
    key = codes >> np.uint64(8 * (order + 1 - min(CUT, order)))
    return (((key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * 8), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def dealt(part: np.ndarray, parts: int):
    """(part, positions of it) of the parts that occur; positions stay in order."""
    by = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    limits = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(limits)).tolist():
        yield p, by[limits[p] : limits[p + 1]]


# --- the trie --------------------------------------------------------------------------------------------------------


def shorter(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs with the context's first byte (its last in the code) left out, and how many of the given ones end so."""
    return counted(((runs >> np.uint64(16)) << EIGHT) | (runs & BYTE))


def levels_of(runs: np.ndarray, n: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Runs and counts for context lengths least to order."""
    out = [(runs, n)]
    for _ in range(order, least, -1):
        out.append(shorter(out[-1][0]))
    return out[::-1]


def occurrences(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == j).sum()) for j in range(1, 5)]


def discounts(n: list[int]) -> np.ndarray:
    """What counts of 0, 1, 2 and more give up, from how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [j - (j + 1) * y * n[j] / max(1, n[j - 1]) for j in (1, 2, 3)]
    return np.array([0.0, *(min(j - 0.05, max(0.05, x)) for j, x in zip((1, 2, 3), d))])


class Level:
    """The runs of one context length with their log10 probabilities; the contexts with the log10 factor of what they have not seen."""

    def __init__(self, runs: np.ndarray, n: np.ndarray, discount: np.ndarray, below: Level | None):
        context = runs >> EIGHT
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(runs) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(runs)])
        given = discount[np.minimum(n, 3).astype(np.int64)]
        total = np.add.reduceat(n, first).astype(np.float64) if len(runs) else np.zeros(0)
        mass = np.add.reduceat(given, first) / total if len(runs) else np.zeros(0)
        low = np.full(len(runs), 1 / 256) if below is None else below.p[np.searchsorted(below.runs, ((runs >> np.uint64(16)) << EIGHT) | (runs & BYTE))]
        self.runs, self.contexts = runs, context[first]
        self.p = (n - given) / np.repeat(total, sizes) + np.repeat(mass, sizes) * low
        self.log_p, self.log_mass = np.log10(self.p), np.log10(mass)


class Trie:
    """Levels by context length; score() gives the log10 probability of each code's symbol in its context."""

    def __init__(self, order: int, levels: list[Level]):
        self.order, self.levels = order, levels

    def score(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level.runs):
                continue
            run = run_at(codes[left], k, self.order)
            at = np.minimum(np.searchsorted(level.runs, run), len(level.runs) - 1)
            hit = level.runs[at] == run
            out[left[hit]] += level.log_p[at[hit]]
            left, context = left[~hit], run[~hit] >> EIGHT
            if not len(left):
                return out
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            known = level.contexts[at] == context
            out[left[known]] += level.log_mass[at[known]]
        out[left] -= math.log10(256)
        return out


# --- training --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """A trained model: its parts as a table in the shared folder, and what every part needs besides."""

    order: int
    parts: int
    word_parts: int
    table: DataFrame  # part, keys, n, size of the runs (parts of words follow those of the runs)
    cuts: list[np.ndarray]  # discounts by context length
    low: list[Level] = field(repr=False)  # context lengths under CUT
    positions: int
    tokens: int
    words: int

    def trie(self, runs: np.ndarray, n: np.ndarray) -> Trie:
        """The trie of one part."""
        levels = list(self.low)
        for k, (r, c) in enumerate(levels_of(runs, n, self.order, len(levels)), len(levels)):
            levels.append(Level(r, c, self.cuts[k], levels[-1] if levels else None))
        return Trie(self.order, levels)

    def plain(self) -> Model:
        """Without the table, to be sent."""
        return Model(self.order, self.parts, self.word_parts, None, self.cuts, self.low, self.positions, self.tokens, self.words)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of a few codes, here: reads the parts that have their contexts."""
        out, part = np.zeros(len(codes)), part_of(codes, self.order, self.parts)
        rows = {r.part: r for r in self.table.where(F.col("part").isin(np.unique(part).astype(np.int64).tolist())).collect()}
        for p in np.unique(part).tolist():
            own = (unpacked(rows[p].keys, rows[p].size), unpacked(rows[p].n, rows[p].size).astype(np.int64)) if p in rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            out[part == p] = self.trie(*own).score(codes[part == p])
        return out


def word_part(hashes: np.ndarray, parts: int, word_parts: int) -> np.ndarray:
    return np.uint64(parts) + (hashes >> np.uint64(20)) % np.uint64(word_parts)


def _count(order: int, parts: int, word_parts: int, most_runs: int, most_words: int):
    """part, keys, n and size: the counts of a task, or of as much of it as most_runs or most_words allow, packed by part."""

    def rows(keys, n, part, total):
        found = [(p, packed(keys[at]), packed(n[at]), len(at)) for p, at in dealt(part, total)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["part", "keys", "n", "size"])

    def merged(held):
        return counted(*map(np.concatenate, zip(*held)))

    def run(batches):
        known = WordHashes()
        runs, n_runs, words, n_words, docs = [], 0, [], 0, 0
        end = known[END_WORD]

        def flush():
            if runs:
                keys, n = merged(runs)
                yield from rows(keys, n, part_of(keys, order, parts), parts)
            if words:
                keys, n = merged(words)
                yield from rows(keys, n, word_part(keys, parts, word_parts), parts + word_parts)

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            docs += len(texts)
            for _, block in blocks(texts):
                runs.append(counted(codes_of([x for _, x in block], order)[0]))
                n_runs += len(runs[-1][0])
                own = [w for _, (_, piece, _) in block for w in piece.split()]
                words.append(counted(np.fromiter(map(known.__getitem__, own), np.uint64, len(own))))
                n_words += len(words[-1][0])
                if n_runs > most_runs:
                    runs = [merged(runs)]
                    n_runs = len(runs[0][0])
                if n_words > most_words:
                    words = [merged(words)]
                    n_words = len(words[0][0])
                if n_runs > most_runs // 2 and len(runs) == 1 or n_words > most_words // 2 and len(words) == 1:
                    yield from flush()
                    runs, n_runs, words, n_words = [], 0, [], 0
        if docs:
            words.append((np.array([end], np.uint64), np.array([docs])))
        yield from flush()

    return run


def blocks(texts: list[bytes | None], most: int = PIECE, group: int = GROUP):
    """Lower-cased texts in blocks of about most bytes and at most group texts: (first text's index, [(index - first, piece)]).

    A text longer than that fills several blocks, all with the same first index.
    """
    first, block, size = 0, [], 0
    for i, x in enumerate(texts):
        if i - first >= group or size >= most:
            yield first, block
            first, block, size = i, [], 0
        for piece in pieces((x or b"").translate(LOWER), most):
            if size and size + len(piece[1]) > 2 * most:
                yield first, block
                block, size = [], 0
            block.append((i - first, piece))
            size += len(piece[1]) + 1
    if block:
        yield first, block


def _merge(order: int, parts: int):
    """part, keys, n, size, total (the sum of n), seen (occurrences() by context length from CUT) and low (packed runs of CUT - 1, counts, size) of each part."""
    cut = min(CUT, order)
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("size", pa.int64()), ("total", pa.int64()), ("seen", pa.list_(pa.int64())), ("low", pa.binary()), ("low_n", pa.binary()), ("low_size", pa.int64())])

    def finished(part, held):
        keys, n = counted(*map(np.concatenate, zip(*held)))
        seen, low, low_n = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if part < parts:
            levels = levels_of(keys, n, order, cut)
            seen = [x for _, c in levels for x in occurrences(c)]
            if cut:
                low, low_n = shorter(levels[0][0])
        return pa.RecordBatch.from_pylist([{"part": part, "keys": packed(keys), "n": packed(n), "size": len(keys), "total": int(n.sum()), "seen": seen, "low": packed(low), "low_n": packed(low_n), "low_size": len(low)}], schema)

    def run(batches):
        part, held, size = None, [], 0
        for batch in batches:
            for p, keys, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield finished(part, held)
                    held, size = [], 0
                part = p
                held.append((unpacked(keys, m), unpacked(n, m).astype(np.int64)))
                size += m
                if size > 1 << 22 and len(held) > 1:
                    held = [counted(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0]) // 2  # doubles before the next merge
        if held:
            yield finished(part, held)

    return run


def _low_runs(batches):
    """code and n of the parts' runs with contexts of CUT - 1."""
    for batch in batches:
        for low, low_n, m in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(low, m).astype(np.int64)), pa.array(unpacked(low_n, m).astype(np.int64))], ["code", "n"])


def train(docs: DataFrame, text: str = "text", order: int = ORDER, most_runs: int = 5_000_000, most_words: int = 2_000_000) -> Model:
    """The model of all texts of docs. most_runs and most_words bound a task's memory and change no result.

    The driver gets the runs of contexts under CUT bytes, at most 256^CUT of them, and a few sums.
    """
    if not 0 <= order <= 6:
        raise ValueError("a code and a document's number share 64 bits: order is at most 6")
    spark, cut = docs.sparkSession, min(CUT, order)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES)))
    word_parts = max(1, parts // 4)
    found = docs.select(F.col(text).alias("text")).mapInArrow(_count(order, parts, word_parts, most_runs, most_words), "part int, keys binary, n binary, size long")
    found = found.repartitionById(parts + word_parts, F.col("part")).sortWithinPartitions("part")
    table = stored(found.mapInArrow(_merge(order, parts), "part int, keys binary, n binary, size long, total long, seen array<long>, low binary, low_n binary, low_size long"), "lm-parts")
    runs = table.where(F.col("part") < parts)
    seen = runs.agg(F.sum("total"), *(F.sum(F.get("seen", F.lit(i))) for i in range(4 * (order - cut + 1)))).first()
    cuts = [discounts([x or 0 for x in seen[1 + 4 * i : 5 + 4 * i]]) for i in range(order - cut + 1)]
    low: list[Level] = []
    if cut:
        got = runs.select("low", "low_n", "low_size").mapInArrow(_low_runs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        levels = levels_of(*counted(got.column("code").to_numpy().astype(np.uint64), got.column("n").to_numpy()), cut - 1, 0)
        low_cuts = [discounts(occurrences(n)) for _, n in levels]
        for (r, n), d in zip(levels, low_cuts):
            low.append(Level(r, n, d, low[-1] if low else None))
        cuts = low_cuts + cuts
    words = table.where(F.col("part") >= parts).agg(F.sum("total"), F.sum("size")).first()
    return Model(order, parts, word_parts, table.select("part", "keys", "n", "size"), cuts, low, seen[0] or 0, words[0] or 0, words[1] or 0)


# --- scoring ---------------------------------------------------------------------------------------------------------


def _frequent(shared, least_runs: int, least_words: int):
    """part, key and value of the frequent runs (their log10 probability) and words (log10 of their count + 1)."""

    def run(batches):
        model = received(shared)
        for batch in batches:
            for part, keys, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = unpacked(keys, m), unpacked(n, m).astype(np.int64)
                keep = n >= (least_runs if part < model.parts else least_words)
                value = model.trie(keys, n).levels[-1].log_p[keep] if part < model.parts and keep.any() else np.log10(n[keep] + 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), part >= model.parts)), pa.array(keys[keep].astype(np.int64)), pa.array(value)], ["is_word", "key", "value"])

    return run


def known_values(frame: DataFrame, is_word: bool) -> tuple[np.ndarray, np.ndarray]:
    got = frame.where(F.col("is_word") == is_word).select("key", "value").toArrow()
    keys, values = got.column("key").to_numpy().astype(np.uint64), got.column("value").to_numpy()
    by = np.argsort(keys)
    return keys[by], values[by]


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The position of each key in the ascending table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


ROWS = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("reps", pa.binary()), ("docs", pa.binary()), ("size", pa.int64()), ("met", pa.int64()),
    ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())),
])
ROWS_SQL = "part int, chunk long, keys binary, reps binary, docs binary, size long, met long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, known array<long>, base array<double>, score array<double>"


def _packed_rows(chunk: int, keys: np.ndarray, part: np.ndarray, total: int, reps: np.ndarray, docs: np.ndarray) -> list[dict]:
    """Rows of the keys (each with reps occurrences, in docs) by part."""
    ends = np.cumsum(reps)
    out = []
    for p, at in dealt(part, total):
        r = reps[at]
        where = np.repeat(ends[at] - r - (np.cumsum(r) - r), r) + np.arange(r.sum())
        out.append({"part": p, "chunk": chunk, "keys": packed(keys[at]), "reps": packed(r), "docs": pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(docs[where]), asbytes=True), "size": len(at), "met": 0})
    return out


def _split(shared, frequent, base: float):
    """What the broadcast tables hold is summed up in a row for each chunk of documents; the rest goes to the parts."""

    def run(batches):
        from pyspark import TaskContext

        model, ((run_keys, run_values), (word_keys, word_values)) = received(shared), received(frequent)
        hashes, order, total = WordHashes(), model.order, model.parts + model.word_parts
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            ids, held = batch.column(0), batch.column(2)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            last, sums = None, None
            for first, block in blocks(texts):
                if first != last:
                    if last is not None:
                        yield head(chunk, model.parts, ids, held, last, sums)
                    chunk, last = chunk + 1, first
                    n = min(GROUP, len(texts) - first)
                    sums = {"n_tokens": np.zeros(n, np.int64), "known": np.zeros(n, np.int64), "base": np.zeros(n), "score": np.zeros(n), "docs": 0, "met": 0}
                codes, sizes = codes_of([x for _, x in block], order)
                number = np.array([i for i, _ in block], np.uint64)
                sums["docs"] = int(number[-1]) + 1
                both = np.sort((codes << EIGHT) | np.repeat(number, sizes))
                codes, docs = both >> EIGHT, (both & BYTE).astype(np.uint8)
                del both
                new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
                reps, codes = np.diff(np.r_[new, len(codes)]), codes[new]
                at = place(run_keys, codes)
                value = np.repeat(np.where(at >= 0, run_values[at], 0.0) if len(run_values) else np.zeros(len(codes)), reps)
                sums["score"] += np.bincount(docs, value, len(sums["score"]))
                cold = at < 0
                rows = []
                if cold.any():
                    rows = _packed_rows(chunk, codes[cold], part_of(codes[cold], order, model.parts), model.parts, reps[cold], docs[np.repeat(cold, reps)])
                tokens = [piece.split() + [END_WORD] * end for _, (_, piece, end) in block]
                sizes = np.array([len(t) for t in tokens])
                words = np.fromiter((hashes[w] for t in tokens for w in t), np.uint64, int(sizes.sum()))
                docs = np.repeat(number.astype(np.uint8), sizes)
                at = place(word_keys, words)
                found = at >= 0
                n = len(sums["score"])
                sums["n_tokens"] += np.bincount(docs, minlength=n)
                sums["known"] += np.bincount(docs[found], minlength=n)
                sums["base"] += np.bincount(docs[found], word_values[at[found]], n) + base * np.bincount(docs, minlength=n)
                if not found.all():
                    words, docs = words[~found], docs[~found]
                    by = np.argsort(words, kind="stable")
                    words, docs = words[by], docs[by]
                    new = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                    rows += _packed_rows(chunk, words[new], word_part(words[new], model.parts, model.word_parts), total, np.diff(np.r_[new, len(words)]), docs)
                sums["met"] -= sum(r["size"] for r in rows)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ROWS)
            if last is not None:
                yield head(chunk, model.parts, ids, held, last, sums)

    def head(chunk, parts, ids, held, first, sums):
        n = sums["docs"]
        own = {k: sums[k][:n].tolist() for k in ("n_tokens", "known", "base", "score")}
        return pa.RecordBatch.from_pylist([{"part": chunk % parts, "chunk": chunk, "size": 0, "met": sums["met"], "doc_id": ids.slice(first, n).to_pylist(), "held_out": held.slice(first, n).to_pylist(), **own}], ROWS)

    return run


def _look_up(shared):
    """The sums by chunk and document of the packed rows of each part, looked up in the part's own counts; heads as they are."""

    def run(batches):
        model = received(shared)
        part, keys, value, trie = None, None, None, None
        held, size, sums = [], 0, {}

        def look_up():
            nonlocal held, size
            if not held:
                return
            codes = np.concatenate([k for _, k, _, _ in held])
            if part < model.parts:
                found = None
                values = trie.score(codes)
            else:
                at = place(keys, codes)
                found = at >= 0
                values = np.where(found, value[at], 0.0) if len(value) else np.zeros(len(codes))
            at = 0
            for chunk, k, reps, docs in held:
                own = sums.setdefault(chunk, [0, np.zeros(GROUP), np.zeros(GROUP), np.zeros(GROUP, np.int64)])
                own[0] += len(k)
                v = np.repeat(values[at : at + len(k)], reps)
                if found is None:
                    own[1] += np.bincount(docs, v, GROUP)
                else:
                    own[2] += np.bincount(docs, v, GROUP)
                    own[3] += np.bincount(docs[np.repeat(found[at : at + len(k)], reps)], minlength=GROUP)
                at += len(k)
            held, size = [], 0

        def batch_of(sums):
            rows = []
            for chunk, (met, score, base, known) in sums.items():
                rows.append({"chunk": chunk, "met": met, "score": np.trim_zeros(score, "b").tolist(), "base": np.trim_zeros(base, "b").tolist(), "known": np.trim_zeros(known, "b").tolist()})
            return pa.RecordBatch.from_pylist(rows, ROWS)

        for batch in batches:
            heads = batch.filter(batch.column("doc_id").is_valid())
            if heads.num_rows:
                yield heads
            rest = batch.filter(batch.column("doc_id").is_null())
            for p, chunk, k, reps, docs, m in zip(*(rest.column(c).to_pylist() for c in ("part", "chunk", "keys", "reps", "docs", "size"))):
                if p != part:
                    look_up()
                    part, keys, value, trie = p, np.zeros(0, np.uint64), np.zeros(0), None
                    if p < model.parts:
                        trie = model.trie(keys, np.zeros(0, np.int64))
                if chunk is None:  # the part's own counts come first
                    keys, n = unpacked(k, m), unpacked(reps, m).astype(np.int64)
                    if p < model.parts:
                        trie = model.trie(keys, n)
                    else:
                        value = np.log10(n + 1.0)
                    continue
                reps = unpacked(reps, m).astype(np.int64)
                held.append((chunk, unpacked(k, m), reps, np.frombuffer(pa.Codec("zstd").decompress(docs, int(reps.sum())), np.uint8)))
                size += m
                if size > 1 << 19:
                    look_up()
                if len(sums) > 4096:
                    yield batch_of(sums)
                    sums.clear()
        look_up()
        if sums:
            yield batch_of(sums)

    return run


def _together(train_tokens: int):
    """A row for each document: the sums of its chunk's rows, once what the parts have met is what was sent."""

    def run(batches):
        heads, sums = {}, {}
        for batch in batches:
            for chunk, met, ids, held, tokens, *values in zip(*(batch.column(c).to_pylist() for c in ("chunk", "met", "doc_id", "held_out", "n_tokens", "known", "base", "score"))):
                own = sums.setdefault(chunk, [0, np.zeros(GROUP, np.int64), np.zeros(GROUP), np.zeros(GROUP)])
                own[0] += met
                for total, v in zip(own[1:], values):
                    if v:
                        total[: len(v)] += np.array(v)
                if ids is not None:
                    heads[chunk] = (ids, held, tokens)
        for chunk, (met, *values) in sums.items():
            if met or chunk not in heads:
                raise RuntimeError("the documents were not read in the same order twice")
            ids, held, tokens = heads[chunk]
            known, base, score = (v[: len(ids)] for v in values)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(known), pa.array(np.full(len(ids), train_tokens)), pa.array(base), pa.array(score),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text", frequent_share: float = 3e-7, hot_share: float = 1e-6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Runs with at least the share frequent_share of all positions, and words with hot_share of all tokens, are broadcast:
    at most 1/share of them, 16 bytes each. No result depends on the shares.
    """
    shared = sent(docs.sparkSession, model.plain())
    least = (max(2, math.ceil(frequent_share * model.positions)), max(2, math.ceil(hot_share * model.tokens)))
    top = model.table.mapInArrow(_frequent(shared, *least), "is_word boolean, key long, value double")
    top = stored(top, "lm-frequent")
    frequent = sent(docs.sparkSession, (known_values(top, False), known_values(top, True)))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    rows = own.mapInArrow(_split(shared, frequent, -math.log10(model.tokens + model.words + 1)), ROWS_SQL)
    counts = model.table.select("part", "keys", F.col("n").alias("reps"), "size")
    met = rows.unionByName(counts, allowMissingColumns=True).repartitionById(model.parts + model.word_parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("chunk"))
    met = met.mapInArrow(_look_up(shared), ROWS_SQL).select("chunk", "met", "doc_id", "held_out", "n_tokens", "known", "base", "score")
    return met.repartition("chunk").mapInArrow(_together(model.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def adaptive_log10(text: bytes, order: int = 4) -> float:
    """The log10 probability of one text under a model that starts empty and learns as it reads (method C, exclusion)."""
    counts: dict[bytes, dict[int, int]] = defaultdict(dict)
    history, out = bytes([END]) * order, 0.0
    for symbol in [*text.translate(LOWER), END]:
        excluded: set[int] = set()
        for k in range(order, -2, -1):
            if k < 0:
                out -= math.log10(256 - len(excluded))
                break
            here = {s: n for s, n in counts[history[len(history) - k :]].items() if s not in excluded}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if symbol in here:
                out += math.log10(here[symbol] / whole)
                break
            out += math.log10(len(here) / whole)
            excluded |= here.keys()
        for k in range(order + 1):
            at = counts[history[len(history) - k :]]
            at[symbol] = at.get(symbol, 0) + 1
        history = (history + bytes([symbol]))[-order:] if order else b""
    return out


def adaptive_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 4) -> DataFrame:
    """doc_id and adaptive_log10() of each text, with no training corpus."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array([adaptive_log10(x or b"", order) for x in texts], pa.float64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
