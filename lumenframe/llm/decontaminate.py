"""Benchmark decontamination by template canonicalisation.

Texts become tokens in which units and runs of numbers and of names (capitalised words) are typed placeholders. The
capitalised first word of a sentence may be a name or not: texts are compared in both readings. Windows of WIDTH tokens
of the benchmark's templates are looked up by hash in all documents; hits of one item along alignments at most DRIFT
apart are counted, the tokens under them are compared, and a slot's values have to map consistently: all places where
the item repeats a value have one value in the document. So a question with other numbers or names, of any number of
words, is found, and chance repeats of a template are not. One contradiction is enough to reject. A capitalised first
word that is a name elsewhere in the item is a slot for this check. A run at the item's own start or end may be longer
in the document, whose words go on there; it is compared only if it is not.

The windows meet by hash. Those of a benchmark of at most most_windows tokens are broadcast, and the documents stay where
they are. Those of a larger one are joined as narrow rows, and each text then meets the items that share a window with
it, at most GROUP at a time. Both ways give the same rows.

Edge cases: null and empty texts have no tokens and match nothing; an item with fewer than WIDTH tokens is one window
of its own size; windows with less than the share least_literal of literal tokens do not count as templates, and items with such
windows are looked up by their plain tokens as well; repeated documents each
have their rows; repeated items are different items with one text; an empty benchmark gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.common import WordHashes, received, sent, stored, windows

WIDTH, LEAST_COVER, LEAST_CONSISTENT, DRIFT, GROUP = 6, 0.4, 1.0, 4, 256
READINGS = FIRST_LITERAL, FIRST_NAME, VERBATIM = range(3)
LITERAL, NUMBER, UNIT, NAME = range(4)
# Words for units and for numbers.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent $ € £ usd eur dollar dollars euro euros cent cents kb mb gb tb hz khz mhz ghz w kw mw v kv °c °f kmh mph".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
EDGE = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?\Z")
JOINED = re.compile(r"(?<=\d)(?=[A-Za-z%°€£$])(?!(?:st|nd|rd|th)\b)")
HYPHENED = re.compile(r"(?<=ty)-(?=(?:one|two|three|four|five|six|seven|eight|nine)\b)")
SLOT_HASH = np.array([0, 0x5BD1E995A7C3F1D7, 0x27D4EB2F165667C5, 0x165667B19E3779F9], np.uint64)
CAPITAL, STOP = np.uint64(4), np.uint64(8)
KIND = np.uint64(3)


class Canon(dict):
    """Token to a 64-bit word: 60 bits of its folded form's hash, and flags for kind, capital and end of sentence."""

    def __init__(self):
        super().__init__()
        self.hashes = WordHashes()

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        core = token.strip(EDGE)
        folded = core.casefold()
        kind = NUMBER if NUMERIC.match(core) or folded in NUMBERS or "-" in folded and NUMBERS.issuperset(folded.split("-")) else UNIT if folded in UNITS else LITERAL
        value = (self.hashes[folded] & ~0xF) | kind
        if kind == LITERAL and core[:1].isupper() and not core.isupper():
            value |= 4
        if token.rstrip("\"')]}")[-1:] in (".", "!", "?", ":"):
            value |= 8
        self[token] = value
        return value


def tokens_of(text: str) -> list[str]:
    if "ty-" in text:
        text = HYPHENED.sub(" ", text)  # "thirty-six" is two words, as "thirty six" is
    return (JOINED.sub(" ", text) if JOINED.search(text) else text).split()


def canonical(values: np.ndarray, starts: np.ndarray, reading: int = FIRST_LITERAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The template's hash, kind and value of each token or run of numbers or names, and the first token of each.

    starts: where texts begin; the first word of a text or sentence is a name in one of the readings only, and all tokens
    are literal in the verbatim one.
    """
    if reading == VERBATIM:
        plain = values & ~np.uint64(0xF)
        return plain, np.full(len(values), LITERAL), plain, np.arange(len(values))
    kind = (values & KIND).astype(np.int64)
    inner = np.ones(len(values), bool)
    inner[1:] = (values[:-1] & STOP) == 0
    inner[starts[starts < len(values)]] = False
    kind = np.where((kind == LITERAL) & ((values & CAPITAL) != 0) & (inner | (reading == FIRST_NAME)), NAME, kind)
    kind[(kind == UNIT) & ~np.r_[False, kind[:-1] == NUMBER]] = LITERAL  # a unit follows a number
    plain = values & ~np.uint64(0xF)
    if len(values):
        again = inner & np.r_[False, kind[1:] == kind[:-1]] & ((kind == NUMBER) | (kind == NAME))
        first = np.flatnonzero(~again)
        sizes = np.diff(np.r_[first, len(values)])
        if len(first) < len(values):
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(sizes.max() - 1, 0x9E3779B97F4A7C15, np.uint64)])
            plain = np.add.reduceat(plain * powers[np.arange(len(values)) - np.repeat(first, sizes)], first)
        kind = kind[first]
    else:
        first = np.zeros(0, np.int64)
    return np.where(kind == LITERAL, plain, SLOT_HASH[kind]), kind, plain, first


class Items:
    """A block of benchmark items: for each reading, their templates and the windows of them by width."""

    def __init__(self, items: list[tuple[int, str]], width: int, least_literal: float):
        canon = Canon()
        self.ids = [item_id for item_id, _ in items]
        own = [np.array([canon[t] for t in tokens_of(text or "")], np.uint64) for _, text in items]
        self.readings = {reading: Reading(own, reading, width, least_literal) for reading in (FIRST_LITERAL, FIRST_NAME)}
        partial = [not all(r.whole[i] for r in self.readings.values()) for i in range(len(own))]
        self.readings[VERBATIM] = Reading([v if p else v[:0] for v, p in zip(own, partial)], VERBATIM, width, least_literal)


class Reading:
    def __init__(self, items: list[np.ndarray], reading: int, width: int, least_literal: float):
        self.kind, self.plain, self.sizes, self.named, self.windows, self.whole = [], [], [], [], [], []  # whole: whether all windows count
        found: dict[int, list] = defaultdict(list)
        for i, values in enumerate(items):
            template, kind, plain, first = canonical(values, np.zeros(1, np.int64), reading)
            size = min(width, len(template))
            need = least_literal * min(width, len(values))  # of the tokens before runs are joined: joining makes no item looser
            self.kind.append(kind)
            self.plain.append(plain)
            self.sizes.append(np.diff(np.r_[first, len(values)]))
            self.named.append((kind == LITERAL) & ((values[first] & CAPITAL) != 0) & np.isin(plain, plain[kind == NAME]))
            if not size:
                self.windows.append(0)
                self.whole.append(True)
                continue
            literal = np.convolve(kind == LITERAL, np.ones(size), "valid")
            self.windows.append(int((literal >= need).sum()))
            self.whole.append(bool((literal >= need).all()))
            for at in np.flatnonzero(literal >= need):
                found[size].append((int(windows(template[at : at + size], size)[0]), i, int(at)))
            if reading != VERBATIM and kind[0] == LITERAL and values[0] & CAPITAL and literal[0] - 1 >= need:
                # inside a document's sentence, the item's first word looks like a name
                other = np.r_[SLOT_HASH[NAME], template[1:size]]
                found[size].append((int(windows(other, size)[0]), i, 0))
        self.by_width = {}
        for size, rows in found.items():
            at = defaultdict(list)
            for h, i, j in rows:
                at[h].append((i, j))
            seen = np.zeros(1 << 20, bool)
            keys = np.array(sorted(at), np.uint64)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_width[size] = (seen, keys, dict(at))


def chains(offsets: dict[int, set[int]]):
    """Hits by offset as runs of offsets at most DRIFT apart: the item's windows and the offset of each."""
    run: dict[int, int] = {}
    last = None
    for offset in sorted(offsets):
        if last is not None and offset - last > DRIFT:
            yield run
            run = {}
        for j in offsets[offset]:
            run.setdefault(j, offset)
        last = offset
    if run:
        yield run


def matches(texts: list[str], items: Items, canon: Canon, width: int, least_cover: float, least_consistent: float):
    """(text's index, item's index, coverage, slots, slot agreement, verbatim) of all matches in some texts."""
    sizes, flat = [], []
    for text in texts:
        own = tokens_of(text)
        sizes.append(len(own))
        flat += own
    values = np.fromiter(map(canon.__getitem__, flat), np.uint64, len(flat))
    limits = np.cumsum(sizes)
    chained: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for reading, index in items.readings.items():
        if not index.by_width:
            continue
        template, kind, plain, first = canonical(values, limits - sizes, reading)
        ends, starts = np.searchsorted(first, limits), np.searchsorted(first, limits - sizes)
        sizes_of = np.diff(np.r_[first, len(values)])
        hits: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size, (seen, keys, at) in index.by_width.items():
            h = windows(template, size)
            maybe = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            i = np.searchsorted(keys, h[maybe])
            maybe = maybe[keys[np.minimum(i, len(keys) - 1)] == h[maybe]]
            doc = np.searchsorted(ends, maybe, "right")
            inside = maybe + size <= ends[doc]
            for p, d in zip(maybe[inside].tolist(), doc[inside].tolist()):
                for item, j in at[int(h[p])]:
                    hits[d, item][p - j].add(j)
        for (d, item), offsets in hits.items():
            for found in chains(offsets):
                cover = len(found) / max(1, index.windows[item])
                if cover < least_cover:
                    continue
                # each token of the item lies under the alignment of the hit before it, the first ones of the first hit
                hit = np.array(sorted(found))
                every = np.arange(len(index.kind[item]))
                before = np.searchsorted(hit, every, "right") - 1
                at = every + np.array([found[j] for j in hit.tolist()])[np.maximum(before, 0)]
                inside = (at >= starts[d]) & (at < ends[d])
                covered = ((before >= 0) & (every < hit[np.maximum(before, 0)] + min(width, len(every))))[inside]
                own_kind, own_plain, named, at = index.kind[item][inside], index.plain[item][inside], index.named[item][inside], at[inside]
                edge = ((every == 0) | (every == len(every) - 1))[inside] & (index.sizes[item][inside] != sizes_of[at])
                covered |= named & np.r_[covered[1:], False]  # the word before the first hit, too
                slot = covered & ((own_kind != LITERAL) & (kind[at] == own_kind) | named) & ~edge
                pairs = Counter(zip(own_plain[slot].tolist(), plain[at][slot].tolist()))
                most: dict[int, int] = {}
                for (a, _), n in pairs.items():
                    most[a] = max(most.get(a, 0), n)
                slots = int((covered & (own_kind != LITERAL) & (kind[at] == own_kind)).sum())
                agreement = sum(most.values()) / sum(pairs.values()) if pairs else 1.0
                verbatim = bool((own_plain == plain[at]).mean() > 0.999) if len(at) else False
                if len(at):
                    chained[d, item].append((int(first[at[0]]), int(first[at[-1]]) + 1, cover, agreement, slots, verbatim))
    out = []
    for (d, item), found in chained.items():
        # a contradiction in one reading counts against the same place in the other
        bad = [x[:2] for x in found if x[3] < least_consistent]
        good = [x[2:] for x in found if x[3] >= least_consistent and not any(2 * (min(x[1], b) - max(x[0], a)) > x[1] - x[0] for a, b in bad)]
        if good:
            out.append((d, item, *max(good)))
    return out


def parts(texts: list[str | None], size: int = 2 << 20):
    """(first, texts) of runs of about size characters."""
    first, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x or "")
        if held >= size or i + 1 == len(texts):
            yield first, [t or "" for t in texts[first : i + 1]]
            first, held = i + 1, 0


def window_hashes(width: int, least_literal: float, flat: bool):
    """The hashes of the windows that items are indexed by, with each item (flat), or those of texts in the same readings, with each text's key."""

    def run(batches):
        canon = Canon()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: set[int] = set()
                if flat:
                    for reading in Items([(0, text)], width, least_literal).readings.values():
                        found.update(h for _, keys, _ in reading.by_width.values() for h in keys.tolist())
                else:
                    values = np.array([canon[t] for t in tokens_of(text or "")], np.uint64)
                    for reading in READINGS:
                        template = canonical(values, np.zeros(1, np.int64), reading)[0]
                        for size in range(1, width + 1):  # items of fewer tokens are windows of their own size
                            found.update(windows(template, size).tolist())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(sorted(found), np.uint64).astype(np.int64)), pa.array([key] * len(found), batch.schema.field(0).type)], ["hash", "key"])

    return run


def found_by_join(docs: DataFrame, benchmark: DataFrame, width: int, least_cover: float, least_consistent: float, least_literal: float) -> DataFrame:
    """text_key (of docs, with text) and what find() returns of each match, for a benchmark of any size."""
    texts = docs.groupBy("text_key").agg(F.any_value("text").alias("text"))
    items = benchmark.withColumn("key", F.monotonically_increasing_id())
    items = stored(items.select("key", "item_id", "text"), "leak-items")
    of_items = items.select("key", "text").mapInArrow(window_hashes(width, least_literal, True), "hash long, key long")
    of_texts = texts.select("text_key", "text").mapInArrow(window_hashes(width, least_literal, False), "hash long, key binary")
    pairs = of_texts.select("hash", F.col("key").alias("text_key")).join(of_items.select("hash", "key"), "hash").select("text_key", "key").distinct()
    # the items of a text in groups of about GROUP, so that no row holds more
    groups = pairs.withColumn("n", F.count("*").over(Window.partitionBy("text_key"))).withColumn("group", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / GROUP)))
    groups = groups.join(items, "key").groupBy("text_key", "group").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item"))).alias("items"))

    def run(batches):
        canon = Canon()
        for batch in batches:
            for key, text, rows in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "items"))):
                own = Items([(r["item_id"], r["item"]) for r in rows], width, least_literal)
                found = [(key, own.ids[k], *m) for _, k, *m in matches([text or ""], own, canon, width, least_cover, least_consistent)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), *KINDS[1:]))], ["text_key", *NAMES[1:]])

    return texts.join(groups, "text_key").select("text_key", "text", "items").mapInArrow(run, "text_key binary, item_id long, coverage double, slot_agreement double, slots int, verbatim boolean")


NAMES = ["doc_id", "item_id", "coverage", "slot_agreement", "slots", "verbatim"]
KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_())


def items_of(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))


def small_benchmark(benchmark: DataFrame, width: int, least_literal: float, most_windows: int) -> Items | None:
    """The items (item_id, text), if they have at most most_windows tokens and rows."""
    size = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")) + 1), F.count("*")).first()
    if max(size[0] or 0, size[1]) > most_windows:
        return None
    return Items([(r.item_id, r.text) for r in benchmark.collect()], width, least_literal)


def text_key(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_cover: float = LEAST_COVER, least_consistent: float = LEAST_CONSISTENT, least_literal: float = 0.5, most_windows: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage (share of the item's windows), slot_agreement, slots and verbatim of each match."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bench = items_of(benchmark, item_id, item_text)
    items = small_benchmark(bench, width, least_literal, most_windows)
    if items is None:
        keyed = own.withColumn("text_key", text_key("text"))
        return keyed.select("doc_id", "text_key").join(found_by_join(keyed, bench, width, least_cover, least_consistent, least_literal), "text_key").select(*NAMES)
    shared = sent(docs.sparkSession, items)

    def run(batches):
        canon, items = Canon(), received(shared)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in parts(batch.column(1).to_pylist()):
                rows = [(ids[first + d], items.ids[k], *found) for d, k, *found in matches(texts, items, canon, width, least_cover, least_consistent)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)

    return own.mapInArrow(run, "doc_id long, item_id long, coverage double, slot_agreement double, slots int, verbatim boolean")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_cover: float = LEAST_COVER, least_consistent: float = LEAST_CONSISTENT, least_literal: float = 0.5, most_windows: int = 1_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a match. Each row is judged by its own text; beside a broadcast benchmark nothing is shuffled."""
    bench = items_of(benchmark, item_id, item_text)
    items = small_benchmark(bench, width, least_literal, most_windows)
    if items is None:
        keyed = docs.select(F.col(text).alias("text")).withColumn("text_key", text_key("text"))
        leaks = found_by_join(keyed, bench, width, least_cover, least_consistent, least_literal).select(F.col("text_key").alias("_leak")).distinct()
        return docs.join(leaks, text_key(text) == F.col("_leak"), "left_anti")
    shared = sent(docs.sparkSession, items)

    def run(batches):
        canon, items = Canon(), received(shared)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, texts in parts(batch.column(text).to_pylist()):
                keep[[first + m[0] for m in matches(texts, items, canon, width, least_cover, least_consistent)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
