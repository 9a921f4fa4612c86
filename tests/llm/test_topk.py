import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import topk


def brute(ids, vectors, queries, k):
    out = []
    for q in queries:
        for i in np.flatnonzero(ids == q):
            score = vectors @ vectors[i]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
            out += [(int(q), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("n,d,spread,block", [(500, 8, 3, 64), (300, 64, 40, 4096), (200, 5, 0, 32), (15, 4, 9, 8)])
def test_search_agrees_with_all_scores(spark, n, d, spread, block):
    rng = np.random.default_rng(n)
    vectors, ids = rng.integers(-spread, spread + 1, (n, d)), rng.permutation(n)
    vectors[: n // 3] = vectors[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<long>, rank int").repartition(3)
    got = topk.search(df, F.col("vec_id") % 7 == 0, 20, block=block, query_block=16)
    assert sorted(map(tuple, got.collect())) == brute(ids, vectors, [i for i in range(n) if i % 7 == 0], 20)


def test_reading_stops_early_on_skewed_lists():
    rng = np.random.default_rng(0)
    values = np.zeros((20_000, 4), np.int64)
    values[:, 0] = rng.pareto(1, 20_000) * 100
    lists = topk.Lists(np.arange(20_000), values)
    read = []

    class Watched(np.ndarray):
        pass

    rows = lists.rows
    lists.rows = type("R", (), {"dtype": rows.dtype, "__getitem__": lambda s, i: read.append(len(i)) or rows[i]})()
    best = lists.top(-1, np.array([1, 0, 0, 0]), 20)
    assert [s for s, _ in best] == sorted(values[:, 0].tolist(), reverse=True)[:20] and sum(read) < 200


def test_blocks_without_anything_to_add_stop_at_once():
    """The score that the seeds reach ends the reading of a block whose bound is below it."""
    values = np.ones((5_000, 4), np.int64)
    lists = topk.Lists(np.arange(5_000), values)
    query = np.array([1, 1, 1, 1])
    assert len(lists.top(-1, query, 20)) == 20 and lists.top(-1, query, 20, 5) == lists.top(-1, query, 20, 5) and len(lists.top(-1, query, 20, 5)) <= 20
    read = []
    rows = lists.rows
    lists.rows = type("R", (), {"dtype": rows.dtype, "__getitem__": lambda s, i: read.append(len(i)) or rows[i]})()
    lists.top(-1, query, 20, 5)
    assert sum(read) <= 2 * 4 * topk.STEP


@pytest.mark.parametrize("seeds", [0, 25, 10_000])
def test_seeds_change_no_result(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "SEEDS", seeds)
    rng = np.random.default_rng(seeds)
    vectors, ids = rng.integers(-20, 21, (300, 6)), rng.permutation(300)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)] + [(1000, []), (1003, [])], "vec_id long, embedding array<long>")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 7 == 0, 20, block=32, query_block=16).collect()))
    assert got == brute(ids, vectors, [i for i in range(300) if i % 7 == 0], 20)


def test_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, -0.01]), (5, [0.5, -0.01]), (None, [1.0, 1.0]), (7, [1.0])], "vec_id long, embedding array<float>")
    own = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"))
    both = [tuple(r) for r in topk.search(own, F.col("vec_id") % 5 == 0, 20).collect()]
    assert sorted(r[::2] for r in both if r[0] == 0) == [(0, 5), (0, 5)] and {r[2] for r in both if r[0] == 5} == {0}
    rows = topk.search(own.where("vec_id = 0 or vec_id = 5").dropDuplicates(), F.col("vec_id") == 0, 20).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 5, 64 * 32 - 128)]
    assert topk.search(own.limit(0), F.lit(True)).count() == 0
