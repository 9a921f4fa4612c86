"""Quality by ordinal regression with a cumulative link on graded ratings.

P(grade <= j) = logistic(threshold_j - f(text)), with one weight vector over hashed text features for all grades and
ordered thresholds. Features are a text's distinct words and word beginnings, each in two of 2^22 slots (so that one
which shares a slot with a telling word has half its pull), and binned shares of its shape: symbols, capitals,
repetition. The model is fitted on at most most_rated rated rows, those with the smallest hashes of their ids.

Edge cases: ratings that are null or whose document is missing are left out, of repeated ratings of one id the lowest
counts; null and empty texts have the shape features only; with fewer than two grades rated, every text gets the one
grade; without any rating all get the lowest, so that nothing is kept; each input row gives one row. Input columns named
expected_grade, tail and kept are replaced, all others stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WordHashes

SLOTS = 1 << 22
PREFIX, SHAPES, WORD_VALUE = 5, 6, 0.3
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Features:
    """A text's slots: those of its distinct words and their first PREFIX letters, then 2 x SHAPES of its shape.

    Words are lower-cased, without symbols at their ends. The slots of up to 400,000 surface forms are remembered.
    """

    def __init__(self):
        self.hashes, self.at, self.slots = WordHashes(), {}, np.zeros((1 << 16, 4), np.int32)

    def _slots(self, feature: str) -> tuple[int, int]:
        h = self.hashes[feature]
        return h & (SLOTS - 1), (h >> 32) & (SLOTS - 1)

    def _add(self, form: str) -> int:
        word, i = form.strip(EDGE).lower(), len(self.at)
        if i == len(self.slots):
            self.slots = np.concatenate([self.slots, np.zeros_like(self.slots)])
        self.slots[i] = self._slots(word) + self._slots(word[:PREFIX] + "~")
        self.at[form] = i
        return i

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        distinct = set(tokens)
        if len(self.at) > 400_000:
            self.at.clear()
        found = list(map(self.at.get, distinct))
        if None in found:
            found = [self._add(w) if i is None else i for w, i in zip(distinct, found)]
        words = np.unique(self.slots[found]) if found else np.zeros(0, np.int32)
        n, chars = max(1, len(tokens)), max(1, len(text))
        symbols = sum(map(text.count, "#$%&*|!"))
        capitals = len(text) - len(text.translate(CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
        shape = (
            f"symbols {_bin(symbols / chars)}", f"capitals {_bin(capitals / chars)}", f"distinct {_bin(len(distinct) / n)}",
            f"size {int(math.log2(n + 1))}", f"repeats {_bin(_repeats(tokens) / n)}", f"short {_bin(sum(len(t) < 3 for t in tokens) / n)}",
        )
        return np.r_[words, np.array([x for s in shape for x in self._slots(f"\0{s}")], np.int32)]


CAPITALS = {c: None for c in range(65, 91)}


def _bin(share: float) -> int:
    return int(math.log2(share * 1024 + 1) * 2)


def _repeats(tokens: list[str]) -> int:
    """How often a token follows itself."""
    return sum(map(str.__eq__, tokens, tokens[1:]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def values(n: int) -> np.ndarray:
    """The value of each of a row's n features: the last ones are of its shape."""
    out = np.full(n, WORD_VALUE, np.float32)
    out[-2 * SHAPES :] = 1
    return out


def fit(pieces: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, rounds: int = 15, rate: float = 0.5, sparsity: float = 8.0, ridge: float = 1.0, least_rows: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights over the slots and n_grades - 1 ascending thresholds: the ordinal likelihood by FTRL-proximal steps.

    Each piece has the features of some rows end to end, and how many each row has; the list is empty afterwards. sparsity keeps weights at 0 unless
    many rows pull them one way, so rare words of single rows carry none.
    """
    w = np.zeros(SLOTS, np.float32)
    if len(grades) == 0:
        return w, np.full(n_grades - 1, 20.0)
    z, power = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    shares = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
    cuts, cut_power = np.log((shares + 1e-3) / (1 - shares + 1e-3)), np.full(n_grades - 1, 1e-2)
    seen = np.zeros(SLOTS, np.int32)
    for own, _ in pieces:
        for at in range(0, len(own), 1 << 20):
            found, n = np.unique(own[at : at + (1 << 20)], return_counts=True)
            seen[found] += n.astype(np.int32)
    parts = []
    while pieces:  # without rare features, most of the memory goes, piece by piece
        own, sizes = pieces.pop(0)
        keep, shape, ends = seen[own] >= least_rows, np.zeros(len(own), bool), np.cumsum(sizes)
        for k in range(1, 2 * SHAPES + 1):
            shape[ends - k] = True
        parts.append((own[keep], shape[keep], np.add.reduceat(keep, ends - sizes, dtype=np.int64)))
        del own, keep, shape
    del seen
    slots, of_shape, sizes = (np.concatenate(x) for x in zip(*parts))
    del parts
    kept = np.r_[0, np.cumsum(sizes)]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(sizes)), max(1, len(sizes) // 32)):
            own, v = (np.concatenate([x[kept[i] : kept[i + 1]] for i in part]) for x in (slots, of_shape))
            v = np.where(v, np.float32(1), np.float32(WORD_VALUE))
            of, y = np.repeat(np.arange(len(part)), kept[part + 1] - kept[part]), grades[part]
            f = np.bincount(of, w[own] * v, len(part))
            edges = np.r_[-np.inf, cuts, np.inf]
            high = np.where(y + 1 == n_grades, 1.0, sigmoid(edges[y + 1] - f))
            low = np.where(y == 0, 0.0, sigmoid(edges[y] - f))
            p = np.maximum(high - low, 1e-9)
            slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
            at, inverse = np.unique(own, return_inverse=True)
            g = np.bincount(inverse, (slope_high - slope_low)[of] * v, len(at))
            z[at] += g - (np.sqrt(power[at] + g * g) - np.sqrt(power[at])) / rate * w[at]
            power[at] += g * g
            pull = np.abs(z[at]) - sparsity
            w[at] = np.where(pull <= 0, 0, -np.sign(z[at]) * pull / ((1 + np.sqrt(power[at])) / rate + ridge))
            for j in range(n_grades - 1):
                g = slope_low[y == j + 1].sum() - slope_high[y == j].sum()
                cut_power[j] += g * g
                cuts[j] -= 0.3 * g / math.sqrt(cut_power[j])
            cuts = np.maximum.accumulate(cuts + np.arange(len(cuts)) * 1e-6)
    return w, cuts


def train(docs: DataFrame, ratings: DataFrame, grade, n_grades: int, doc_id: str = "doc_id", text: str = "text", most_rated: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """fit() on the texts of at most most_rated rated ids."""
    rated = ratings.select(F.col(doc_id).alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(rated), "doc_id")

    def run(batches):
        features = Features()
        for batch in batches:
            rows = [features.of(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "grade": batch.column("grade"), "slots": pa.array(rows, pa.binary())})

    got = own.select("doc_id", "text", "grade").mapInArrow(run, "id long, grade int, slots binary").orderBy("id", "slots").toArrow()
    grades = got.column("grade").to_numpy()
    pieces = []
    for chunk in got.column("slots").chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4
        if len(chunk):
            pieces.append((np.frombuffer(chunk.buffers()[2], np.int32)[ends[0] : ends[-1]], np.diff(ends)))
    del got
    return fit(pieces, grades.astype(np.int64), n_grades)


def rate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with expected_grade and tail, the probabilities of grade 1 or more, 2 or more, and so on."""
    weights, cuts = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.schema.jsonValue()
    fields = [f for f in schema["fields"] if f["name"] not in ("expected_grade", "tail")]
    names = [f["name"] for f in fields]

    def run(batches):
        features, w = Features(), shared.value
        for batch in batches:
            slots = [features.of(x or "") for x in batch.column(text).to_pylist()]
            f = np.array([w[s].astype(np.float64) @ values(len(s)) for s in slots])
            tail = 1 - sigmoid(cuts[None, :] - f[:, None])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(tail.sum(1)), pa.array(list(tail), pa.list_(pa.float64()))], [*names, "expected_grade", "tail"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    out = StructType([*StructType.fromJson({"type": "struct", "fields": fields}).fields, StructField("expected_grade", DoubleType()), StructField("tail", ArrayType(DoubleType()))])
    return docs.select(*names).mapInArrow(run, out)


#: The test tables' ratings as grades: one point for quality, one for not being toxic. Kept is what has both more likely than not.
GRADES, LEAST_TAIL = 3, 0.5


def grade():
    return F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")


def select(docs: DataFrame, ratings: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """rate() and kept: whether the top grade has at least the probability least_tail."""
    rated = rate(docs, train(docs, ratings, grade(), GRADES))
    return rated.withColumn("kept", F.element_at("tail", -1) >= least_tail)
