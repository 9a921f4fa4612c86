"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are packed into blocks, queries into blocks of their own, and each pair of blocks is one row: the candidate
block has, for every dimension, its members sorted by value. For a query the lists are read from the end that adds most
(by the sign of the query's component), a step at a time; every member met is scored in full, and reading stops when
the bound, the sum of the products at the current depths, cannot beat the k-th best score, nor tie with it. Each pair
gives k rows a query at most; a second step merges them. All blocks know a score that k candidates of each query reach:
the k-th best among SEEDS vectors (those with the smallest hashes of their ids), so reading stops in a block that has
nothing to add, without a k-th result of its own. The seeds change how far is read, and no result.

Edge cases: vectors that are null or hold null components take no part, nor, after usable(), those with non-finite ones;
vectors meet those of their own length only; vectors of length 0 score 0 with each other; ties go to the smaller id; fewer candidates than k give all; rows
that repeat an id are separate candidates, and separate queries whose results are ranked together; no row with the
query's own id is a candidate; null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.common import stored

BLOCK, QUERY_BLOCK, STEP, SEEDS = 8_192, 1_024, 32, 2_048


def scaled(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor x component), components as doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _pack(size: int):
    """Blocks of up to size vectors of one length: their ids and components as bytes."""

    def run(batches):
        held: dict[int, list] = {}

        def block(d):
            ids, values = (np.concatenate(x) for x in zip(*held.pop(d)))
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(values).max(initial=0) <= np.iinfo(k).max)
            return pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "kind": pa.array([kind]), "ids": pa.array([ids.tobytes()], pa.binary()), "components": pa.array([values.astype(kind).tobytes()], pa.binary())})

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                values = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), d)
                for at in range(0, len(own), size):
                    held.setdefault(d, []).append((ids[own[at : at + size]], values[at : at + size]))
                    if sum(len(x[0]) for x in held[d]) >= size:
                        yield block(d)
        for d in list(held):
            yield block(d)

    return run


class Lists:
    """A block of candidates with its sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by_id], values[by_id]
        exact = len(values) == 0 or np.abs(values).max(initial=0) < 1 << 22  # sums of products of doubles are whole numbers
        self.rows = self.values.astype(np.float64) if exact else self.values
        self.up = np.argsort(self.values, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(self.values, self.up.T.astype(np.int64), axis=0).T.copy()

    def top(self, query_id: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best members, best first. least: a score that k candidates, of whatever block, reach; members below it may be missing."""
        n, used = len(self.ids), np.flatnonzero(query)
        if not len(used):
            keep = self.ids[self.ids != query_id][:k]
            return [(0, int(i)) for i in keep]
        own = query.astype(self.rows.dtype)
        up = query[used] < 0
        seen = np.zeros(n, bool)
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while depth < n:
            to = min(n, depth + step)
            new = np.concatenate([self.up[used[up], depth:to].ravel(), self.up[used[~up], n - to : n - depth].ravel()])
            mark = np.zeros(n, bool)
            mark[new] = True
            mark &= ~seen
            seen |= mark
            new = np.flatnonzero(mark)
            new = new[self.ids[new] != query_id]
            scores = np.r_[scores, (self.rows[new] @ own).astype(np.int64)]
            found = np.r_[found, new]
            if len(scores) > k:
                best = np.lexsort((self.ids[found], -scores))[:k]
                scores, found = scores[best], found[best]
            depth, step = to, step * 2
            if depth < n:
                bound = (self.sorted[used[up], depth] * query[used[up]]).sum() + (self.sorted[used[~up], n - 1 - depth] * query[used[~up]]).sum()
                if len(scores) == k and bound < scores.min() or least is not None and bound < least:
                    break
        best = np.lexsort((self.ids[found], -scores))[:k]
        return [(int(s), int(i)) for s, i in zip(scores[best], self.ids[found[best]])]


def seeded(shared, k: int):
    """Query blocks with q_least: for each query the k-th best score among the seeds of its length, NONE if there are fewer."""

    def run(batches):
        seeds = {d: (np.array(ids, np.int64), np.array(values, np.int64).reshape(len(ids), d)) for d, (ids, values) in shared.value.items()}
        for batch in batches:
            out = []
            for d, kind, ids, components in zip(*(batch.column(c).to_pylist() for c in ("dims", "kind", "ids", "components"))):
                queries, own = np.frombuffer(components, kind).reshape(-1, d).astype(np.int64), np.frombuffer(ids, np.int64)
                least = np.full(len(own), NONE)
                if d in seeds and len(seeds[d][0]) > k:
                    scores = queries @ seeds[d][1].T
                    scores[own[:, None] == seeds[d][0][None]] = NONE
                    least = np.partition(scores, -k, axis=1)[:, -k]
                out.append(least.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "least"])

    return run


NONE = np.iinfo(np.int64).min


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates by integer inner product.

    The components are whole numbers (see scaled()).
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    schema = "dims int, kind string, ids binary, components binary"
    blocks = stored(own.select("id", "v").mapInArrow(_pack(block), schema).withColumn("part", F.monotonically_increasing_id()), "topk-blocks")
    seeds: dict[int, tuple[list, list]] = {}
    for r in own.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SEEDS).collect():
        found = seeds.setdefault(len(r.v), ([], []))
        found[0].append(r.id)
        found[1].append(r.v)
    asked = own.where("q").select("id", "v").mapInArrow(_pack(query_block), schema).mapInArrow(seeded(vectors.sparkSession.sparkContext.broadcast(seeds), k), schema + ", least binary")
    asked = asked.select("dims", *(F.col(c).alias(f"q_{c}") for c in ("kind", "ids", "components", "least")))
    # the stated query set against all rows, in blocks: the smaller query blocks go to where the candidates are
    spread = max(1, blocks.count())
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(spread)).cast("int"))
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    pairs = blocks.join(asked.hint("merge"), ["dims", "bucket"])

    def run(batches):
        last, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dims"]
                if row["part"] != last:
                    lists, last = Lists(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["components"], row["kind"]).reshape(-1, d).astype(np.int64)), row["part"]
                queries = np.frombuffer(row["q_components"], row["q_kind"]).reshape(-1, d).astype(np.int64)
                least = [None if x == NONE else x for x in np.frombuffer(row["q_least"], np.int64).tolist()]
                out = [(q, i, s) for q, values, low in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), queries, least) for s, i in lists.top(q, values, k, low)]
                columns = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.select("part", "dims", "kind", "ids", "components", "q_kind", "q_ids", "q_components", "q_least").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
