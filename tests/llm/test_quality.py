import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import quality as Q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels.where("doc_id % 2 = 0"), Q.grade(), 3)
    assert (np.diff(model[1]) > 0).all()
    rows = Q.rate(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", "expected_grade", (F.element_at("tail", -1) >= 0.5).alias("kept"))
    got = {(r.quality, r.toxic): (r.kept, r.mean) for r in rows.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("mean")).collect()}
    assert got[1, 0][0] > 0.995 and got[0, 0][0] < 0.1 and got[1, 1][0] < 0.35 and got[0, 1][0] < 0.05
    assert got[0, 1][1] < min(got[1, 1][1], got[0, 0][1]) < got[1, 0][1]


def test_fit_orders_grades_and_tails():
    features = Q.Features()
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows = [features.of(" ".join(f"good{k}" for k in range(g)) + " " + " ".join(rng.choice(["a", "b", "c", "d"], 5))) for g in grades]
    w, cuts = Q.fit([(np.concatenate(rows[:99]), np.array([len(r) for r in rows[:99]])), (np.concatenate(rows[99:]), np.array([len(r) for r in rows[99:]]))], grades, 4, sparsity=0.5)
    f = np.array([w[r] @ Q.values(len(r)) for r in rows])
    tail = 1 - Q.sigmoid(cuts[None] - f[:, None])
    assert (np.diff(cuts) > 0).all() and (np.diff(tail, axis=1) <= 0).all() and np.corrcoef(tail.sum(1), grades)[0, 1] > 0.9


def test_features_are_those_of_the_whole_text():
    features, long = Q.Features(), "word " * 50_000 + "idiot!!"
    assert set(features._slots("idiot")) <= set(features.of(long).tolist()) and len(features.of("")) == 2 * Q.SHAPES


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "a b c", 3.0)], "doc_id long, text string, expected_grade double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert Q.select(docs, labels).count() == 3 and Q.select(docs.limit(0), labels).count() == 0
    assert [r.kept for r in Q.select(docs, labels.limit(0)).collect()] == [False] * 3


def dense_fit(x, y, n_grades, ridge=0.02, steps=1500, rate=0.5):
    """The cumulative-link model by plain gradient steps on dense features: weights and thresholds."""
    w, cuts = np.zeros(x.shape[1]), np.log(np.linspace(0.3, 3, n_grades - 1))
    loss = []
    for _ in range(steps):
        f = x @ w
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            high, low = 1 / (1 + np.exp(-(edges[y + 1] - f))), 1 / (1 + np.exp(-(edges[y] - f)))
        p = np.maximum(high - low, 1e-12)
        loss.append(-np.log(p).mean())
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        w -= rate * (x.T @ (dh - dl) / len(y) + ridge * w)
        cuts = cuts - rate * np.array([(dl[y == j + 1].sum() - dh[y == j].sum()) / len(y) for j in range(n_grades - 1)])
    return w, cuts, loss


def test_fit_against_a_dense_fit():
    """Both models order held-out rows alike, and the sparse one's likelihood is close to the dense one's."""
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(60)]
    pull = rng.normal(0, 1.2, 60)
    texts = [[words[i] for i in rng.choice(60, 14, replace=False)] for _ in range(1600)]
    score = np.array([sum(pull[words.index(w)] for w in t) for t in texts]) + rng.logistic(0, 0.7, 1600)
    y = np.digitize(score, np.quantile(score, [0.3, 0.7]))
    features = Q.Features()
    rows = [features.of(" ".join(t)) for t in texts]
    w, cuts = Q.fit([(np.concatenate(rows[:1200]), np.array([len(r) for r in rows[:1200]]))], y[:1200], 3, rounds=30, sparsity=0.5)
    x = np.array([[t.count(v) for v in words] for t in texts], float)
    dw, dcuts, loss = dense_fit(x[:1200], y[:1200], 3, ridge=0.002)
    assert loss[-1] < loss[0] and (np.diff(dcuts) > 0).all() and (np.diff(cuts) > 0).all()
    f = np.array([w[r] @ Q.values(len(r)) for r in rows])
    g = x @ dw

    def likelihood(f, cuts):
        tail = np.c_[np.ones(400), 1 - Q.sigmoid(cuts[None] - f[1200:, None]), np.zeros(400)]
        return np.log(np.maximum(tail[np.arange(400), y[1200:]] - tail[np.arange(400), y[1200:] + 1], 1e-9)).mean()

    assert np.corrcoef(f[1200:], g[1200:])[0, 1] > 0.93 and likelihood(f, cuts) > likelihood(g, dcuts) - 0.12


def test_query_against_brute_force(spark):
    """Every row of the table: expected grade and tails from the model's own numbers, by plain sums over words."""
    import math

    import xxhash

    from lumenframe.llm.queries import op7

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    w, cuts = Q.train(docs, labels, Q.grade(), 3)
    got = {r.doc_id: r for r in op7(spark, "/root/testdata/sf0.01").collect()}
    pair = lambda feature: [h & (Q.SLOTS - 1) for h in (xxhash.xxh3_64_intdigest(feature.encode()), xxhash.xxh3_64_intdigest(feature.encode()) >> 32)]
    level = lambda share: int(math.log2(share * 1024 + 1) * 2)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, text in texts.items():
        tokens = text.split()
        slots = {s for t in tokens for word in [t.strip(Q.EDGE).lower()] for f in (word, word[:5] + "~") for s in pair(f)}
        n, chars = max(1, len(tokens)), max(1, len(text))
        shape = [f"symbols {level(sum(c in '#$%&*|!' for c in text) / chars)}", f"capitals {level(sum(c.isupper() for c in text) / chars)}", f"distinct {level(len(set(tokens)) / n)}", f"size {int(math.log2(n + 1))}",
                 f"repeats {level(sum(a == b for a, b in zip(tokens, tokens[1:])) / n)}", f"short {level(sum(len(t) < 3 for t in tokens) / n)}"]
        f = Q.WORD_VALUE * sum(float(w[s]) for s in slots) + sum(float(w[s]) for x in shape for s in pair("\0" + x))
        tail = [1 / (1 + math.exp(c - f)) for c in cuts]
        r = got[i]
        assert abs(r.expected_grade - sum(tail)) < 1e-3 and abs(r.p_grade_1 - tail[0]) < 1e-3 and abs(r.p_grade_2 - tail[1]) < 1e-3 and (r.kept == (r.p_grade_2 >= Q.LEAST_TAIL))
    assert len(got) == len(texts)
