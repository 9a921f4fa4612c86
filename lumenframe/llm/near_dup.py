"""Near-duplicate groups by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Shingles are runs of five words; a shingle weighs 1 + log of its count in the text times its damped inverse document
frequency, counted over all documents in 2^20 hashed cells (so the table has one size whatever the corpus, and a
shingle is told apart when it is more frequent than its cell's share of the others). Each text gets BANDS x ROWS samples; texts that agree on
all samples of a band are candidates, and candidates are linked if their weighted Jaccard similarity is at least
LEAST. Groups are the connected components of the links.

Equal texts (as sequences of words) are one node from the start. Within a bucket of candidates no pairs are listed:
first each node meets the bucket's hub, the member with the most company in all its buckets. Where a bucket still
holds several components, each member outside the main one (a stray) is compared with all members of the bucket, in
blocks of bounded size: by the samples first (AGREE of them have to agree, and the total weights have to allow LEAST),
then exactly, through an index of the block's shingles. Only links come out, one for each stray and component. A pair at
exactly LEAST is lost by the bands 18 times in 10,000 and by the samples once in 100,000; more similar pairs hardly ever.

Measured on planted edits: of pairs at 0.8 or more by plain Jaccard similarity of their shingles, those that the
weights take below it are not linked (see the tests); four words changed in 120 leave a similarity under 0.8 and no link.

Edge cases: null and empty texts, and texts without words, have one class (they are equal); a text of fewer than five
words has one shingle, all its words; rows that repeat an id are one document, and link what their texts link; rows
with a null id have a null class and are kept; other columns stay as they are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WordHashes, mix, remove, stored, windows, word_hashes

WIDTH, LEAST, BANDS, ROWS, CELLS, DAMPING = 5, 0.8, 12, 4, 1 << 20, 0.1
WORD = re.compile(r"\w+")
CHUNK = 1 << 12  # cells in one row of the frequency table
STRAYS, MEMBERS = 1 << 10, 1 << 11  # strays and members of a bucket in one block
AGREE = 0.55


class Shingler:
    def __init__(self):
        self.known = WordHashes()

    def words(self, text: str | None) -> list[str]:
        return WORD.findall((text or "").lower())

    def shingles(self, words: list[str]) -> np.ndarray:
        return windows(word_hashes(words, self.known), min(WIDTH, len(words))) if words else np.zeros(0, np.uint64)


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have a shingle in each cell, and how many documents have shingles."""

    def run(batches):
        shingler, counts, held, size, n = Shingler(), np.zeros(CELLS, np.int64), [], 0, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.unique(cells_of(shingler.shingles(shingler.words(x))))
                n += len(own) > 0
                held.append(own)
                size += len(own)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
        rows = [zlib.compress((part.astype(np.uint8) if part.max() < 256 else part).tobytes(), 1) for part in counts.reshape(-1, CHUNK)]
        if n:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(rows)), pa.int32()), "counts": pa.array(rows, pa.binary()), "n": pa.array([n] + [0] * (len(rows) - 1), pa.int64())})

    def unpacked(data: bytes) -> np.ndarray:
        raw = zlib.decompress(data)
        return np.frombuffer(raw, np.uint8 if len(raw) == CHUNK else np.int64).astype(np.int64)

    def add(batches):
        """Sums of the chunks that this task has read: at most CELLS / CHUNK rows."""
        total: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for chunk, counts, k in zip(*(c.to_pylist() for c in batch.columns)):
                total[chunk] = total.get(chunk, 0) + unpacked(counts)
                n += k
        if total:
            rows = [zlib.compress(x.tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()), "counts": pa.array(rows, pa.binary()), "n": pa.array([n] + [0] * (len(rows) - 1), pa.int64())})

    schema = "chunk int, counts binary, n long"
    got = docs.select(text).mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).toArrow()
    out = np.zeros((CELLS // CHUNK, CHUNK), np.int64)
    for chunk, counts in zip(got.column("chunk").to_pylist(), got.column("counts").to_pylist()):
        out[chunk] += unpacked(counts)
    return out.ravel(), sum(got.column("n").to_pylist())


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """1 + DAMPING x log(1 + N / df) / log(1 + N): from 1 to 1 + DAMPING.

    Damped, because a group of near-copies that is a large part of the corpus raises its own shingles' frequencies:
    undamped, what they share would weigh so little against their differences that no two would be similar.
    """
    counts, n = document_frequencies(docs, text)
    return (1 + DAMPING * np.log1p(n / np.maximum(counts, 1)) / max(np.log1p(n), 1e-9)).astype(np.float32)


def weighted(shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    distinct, tf = np.unique(shingles, return_counts=True)
    return distinct, (1 + np.log(tf)).astype(np.float32) * idf[cells_of(distinct)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller over the sum of the greater weights; 1 for two empty texts."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common / (total - common)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit draw: 1/r, beta, ln c - r (1 - beta), r; and a multiplier for each sample."""
    rng = np.random.default_rng(20240229)
    r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
    table = np.stack([1 / r, beta, np.log(c) - r * (1 - beta), r]).astype(np.float32)
    odd = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, odd


def samples(shingles: np.ndarray, weights: np.ndarray, sizes: np.ndarray, n: int, parameters) -> np.ndarray:
    """n samples for each text; shingles and weights of all texts end to end, sizes of 1 or more."""
    (inverse, beta, base, r), odd = parameters
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    log_w = np.log(weights).astype(np.float32)
    out = np.zeros((len(sizes), n), np.uint64)
    for k in range(n):
        i = ((shingles * odd[k]) >> np.uint64(48)).astype(np.int32)
        t = np.floor(log_w * inverse[i] + beta[i])
        a = base[i] - r[i] * t
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[doc])
        if len(at) > len(sizes):  # of equals, the smallest shingle
            at = at[np.lexsort((shingles[at], doc[at]))]
            at = at[np.r_[True, doc[at][1:] != doc[at][:-1]]]
        out[:, k] = mix(shingles[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def signatures(docs: DataFrame, idf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k1 and k2 (the words' 128-bit hash), bands, and sketch (the total weight, 16 bits of each sample) of each row."""

    def run(batches):
        shingler, table, parameters = Shingler(), idf.value, _parameters()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                keys, rows, size, first = [], [], 0, at
                while at < len(texts) and size < 1 << 17:
                    words = shingler.words(texts[at])
                    keys.append(key_of(words))
                    rows.append(weighted(shingler.shingles(words), table))
                    size += len(rows[-1][0])
                    at += 1
                full = [i for i, r in enumerate(rows) if len(r[0])]
                bands, sketches = [[] for _ in rows], [b""] * len(rows)
                if full:
                    found = samples(np.concatenate([rows[i][0] for i in full]), np.concatenate([rows[i][1] for i in full]), np.array([len(rows[i][0]) for i in full]), BANDS * ROWS, parameters)
                    banded = np.stack([mix(windows_of(found[:, b * ROWS : (b + 1) * ROWS], b)) for b in range(BANDS)], 1).astype(np.int64)
                    short = (found & np.uint64(0xFFFF)).astype(np.uint16)
                    for j, i in enumerate(full):
                        bands[i], sketches[i] = banded[j], np.float32(rows[i][1].sum()).tobytes() + short[j].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[first:at], pa.int64()), "k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64()),
                    "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary()),
                })

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>, sketch binary")


def windows_of(rows: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(rows), salt + 1, np.uint64)
    for k in range(rows.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return out


def opened(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples and total weights."""
    data = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), -1)
    return data[:, 2:], np.ascontiguousarray(data[:, :2]).view(np.float32)[:, 0]


def possible(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """Whether two texts may be similar: their samples agree, and the lesser total is not too small against the greater."""
    return ((x == y).mean(1) >= AGREE) & (np.minimum(wx, wy) >= (LEAST - 1e-4) * np.maximum(wx, wy))


def agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree on AGREE of the samples or more."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}")), side)

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            keep = possible(*opened(x), *opened(y)) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """a, b and linked of each pair: whether the weighted Jaccard similarity of texts (node, text) of a and b is least or more."""
    own = lambda node, column: texts.select(F.col("node").alias(node), F.col("text").alias(column)).hint("merge")
    wide = pairs.join(own("b", "tb"), "b").join(own("a", "ta"), "a")

    def run(batches):
        shingler, table = Shingler(), idf.value
        last, known = None, None
        for batch in batches:
            out = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if known is None or ta != last:
                    last, known = ta, weighted(shingler.shingles(shingler.words(ta)), table)
                out.append(similarity(known, weighted(shingler.shingles(shingler.words(tb)), table)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b): smallest labels spread, with jumps."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "dup-edges")
    last = labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "dup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))  # stored: plain exchanges on both sides
        new = stored(low.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", F.col("component"))).alias("component")), "dup-labels")
        changed = new.where("old <> component").limit(1).count()
        remove(last)
        last, labels = new, new.select("node", "component")
        labels.stored_at = new.stored_at
        if not changed:
            remove(both)
            return labels


def crossing(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, p, q, node, component and strays, of the buckets that hold several components, dealt to blocks (band, p, q).

    A stray is a member outside its bucket's most frequent component. Each block has one part of a bucket's strays and
    one part of all its members; each pair of a stray and a member of another component meets in one block.
    """
    own = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = own.groupBy("band", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("band").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("components > 1")
    most = most.select("band", F.col("most.component").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / STRAYS).cast("int").alias("ps"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("qs"))
    most = stored(most, "dup-most")
    own = own.join(most, "band").withColumn("hash", F.xxhash64("node", "band"))
    stray = F.col("component") != F.col("main")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "p", "q", "node", "component", "stray"]
    strays = own.where(stray).withColumns({"p": F.pmod("hash", F.col("ps")).cast("int"), "q": blocks("qs"), "stray": F.lit(True)})
    every = own.withColumns({"q": F.pmod("hash", F.col("qs")).cast("int"), "p": blocks("ps"), "stray": F.lit(False)})
    return strays.select(*columns).unionAll(every.select(*columns))


def promising(blocks: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of blocks that have a possible partner of another component there."""

    def run(table: pa.Table) -> pa.Table:
        samples, weight = opened(table.column("sketch").to_pylist())
        stray = table.column("stray").to_numpy()
        component = table.column("component").to_numpy()
        keep = np.zeros(len(stray), bool)
        others = np.flatnonzero(~stray)
        for i in np.flatnonzero(stray):
            ok = others[component[others] != component[i]]
            ok = ok[possible(samples[ok], weight[ok], samples[i : i + 1], weight[i])]
            keep[ok] = True
            keep[i] = len(ok) > 0
        return table.drop_columns(["sketch"]).filter(pa.array(keep))

    return blocks.join(sketches, "node").select(*blocks.columns, "sketch").groupBy("band", "p", "q").applyInArrow(run, blocks.schema)


def crossing_links(blocks: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Links (a, b) of strays to members of other components in their blocks, one for each such component."""
    def run(table: pa.Table) -> pa.Table:
        shingler = Shingler()
        node, component, stray = (table.column(c).to_numpy() for c in ("node", "component", "stray"))
        vectors = [weighted(shingler.shingles(shingler.words(x)), idf.value) for x in table.column("text").to_pylist()]
        total = np.array([v[1].sum(dtype=np.float64) for v in vectors])
        others = np.flatnonzero(~stray)
        of = np.repeat(others, [len(vectors[j][0]) for j in others])
        flat = np.concatenate([vectors[j][0] for j in others]) if len(others) else np.zeros(0, np.uint64)
        flat_w = np.concatenate([vectors[j][1] for j in others]) if len(others) else np.zeros(0, np.float32)
        by = np.argsort(flat, kind="stable")
        flat, flat_w, of = flat[by], flat_w[by], of[by]
        out = []
        for i in np.flatnonzero(stray):
            h, w = vectors[i]
            lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
            sizes = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            common = np.bincount(of[at], np.minimum(flat_w[at], np.repeat(w, sizes)), len(node))
            high = total + total[i] - common
            linked = np.flatnonzero((common >= least * high) & (component != component[i]) & ~stray & (high > 0))
            for j in linked[np.unique(component[linked], return_index=True)[1]]:
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    own = blocks.join(texts.hint("merge"), "node").select(*blocks.columns, "text")
    return own.groupBy("band", "p", "q").applyInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id (the smallest id of its group) of each row of docs.

    Tables with one row for each band, component or text are stored before they meet a larger one by that key: so each
    such join has plain exchanges on both sides, and Spark splits the partitions of a key that many rows share.
    """
    sc = docs.sparkSession.sparkContext
    idf = sc.broadcast(idf_table(docs, text))
    rows = stored(signatures(docs, idf, doc_id, text), "dup-rows")
    # equal texts have equal sketches and bands, so any row of them will do
    equal = rows.where("doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").alias("node"), "bands", "sketch")).alias("x"))
    nodes = stored(equal.select("k1", "k2", "x.*"), "dup-nodes")
    # a node is its text's smallest id; where several texts have one smallest id, they are named by their hashes
    clash = stored(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "dup-clash")
    several_texts = clash.limit(1).count() > 0
    if several_texts:
        named = nodes.join(clash.withColumn("clash", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("k1", "k2")).otherwise(F.col("node")))
        old, nodes = nodes, stored(named.select("k1", "k2", "node", "bands", "sketch"), "dup-nodes")
        remove(old)
    sketches = nodes.where(F.length("sketch") > 0).select("node", "sketch")
    members = nodes.select(F.explode(F.array_distinct("bands")).alias("band"), "node")
    sizes = stored(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "dup-sizes")
    members = stored(members.join(sizes, "band"), "dup-members")
    company = stored(members.groupBy("node").agg(F.sum("n").alias("company")), "dup-company")
    hubs = members.join(company, "node").groupBy("band").agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("hub")).select("band", (-F.col("hub.node")).alias("hub"))
    hubs = stored(hubs, "dup-hubs")
    pairs = members.select("band", "node").join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = stored(agreeing(pairs, sketches), "dup-pairs")
    remove(sizes, hubs)
    texts = stored(texts_of(docs, nodes.join(company.select("node"), "node", "left_semi"), rows, several_texts, doc_id, text), "dup-texts")
    tested = stored(verified(pairs, texts, idf, least), "dup-tested")
    # an id with several texts links their nodes
    by_id = rows.where("doc_id is not null").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node")
    ends = by_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    ends = stored(ends.select("doc_id", "a"), "dup-ends")
    twice = by_id.join(ends, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    edges = tested.where("linked").select("a", "b").unionAll(twice)
    labels = components(edges)
    blocks = stored(promising(crossing(members.select("band", "node"), labels), sketches), "dup-blocks")
    remove(labels)
    more = stored(crossing_links(blocks, texts, idf, least), "dup-links")
    labels = components(edges.unionAll(more))
    remove(texts, blocks, members, company, pairs, tested, more)
    of = by_id.join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))
    if several_texts:  # the classes' names are hashes where such texts are in them
        smallest = stored(of.groupBy("class_id").agg(F.min("doc_id").alias("smallest")), "dup-smallest")
        of = of.join(smallest, "class_id").select("doc_id", F.col("smallest").alias("class_id"))
    return of.unionAll(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def texts_of(docs: DataFrame, nodes: DataFrame, rows: DataFrame, several: bool, doc_id: str, text: str) -> DataFrame:
    """node and text of the nodes: rows of docs with a node's id and, where an id has several texts, with its words."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if not several:  # merge: the same plan at every size, as these rows are texts
        wanted = nodes.select(F.col("node").alias("id"))
        return own.join(wanted.hint("merge"), "id", "left_semi").select(F.col("id").alias("node"), "text")
    ids = rows.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    wanted = stored(nodes.select("k1", "k2", "node").join(ids, ["k1", "k2"]), "dup-wanted")

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
            yield batch.select(["node", "text"]).filter(pa.array([key_of(shingler.words(x)) == k for x, k in zip(batch.column("text").to_pylist(), keys)], pa.bool_()))

    return own.join(wanted.hint("merge"), "id").select("node", "text", "k1", "k2").mapInArrow(run, "node long, text string")


def key_of(words: list[str]) -> tuple[int, int]:
    """The halves of the words' 128-bit hash, as signed numbers."""
    key = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (key >> 64, key & ((1 << 64) - 1)))


def deduplicated(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, that with the smallest id; rows without an id stay."""
    of = stored(classes(docs, least, doc_id, text), "dup-classes")
    keep = of.where("doc_id = class_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    out = docs.join(keep, docs[doc_id] == keep["_kept"], "left_semi")
    if keep.where("_rows > 1").limit(1).count():
        out = out.dropDuplicates([doc_id])
    return out.unionAll(docs.where(F.col(doc_id).isNull()))
