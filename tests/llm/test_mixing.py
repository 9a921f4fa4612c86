import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing as M

SF = "/root/testdata/sf0.01"


def shares_of(rows, weight):
    return {c: weight.groupby(rows[c].fillna(M.NONE)).sum() / weight.sum() for c in ("source", "lang", "mix_topic")}


def wanted(rows, keep=M.KEEP):
    """The target shares, those above what the corpus has lowered to it, by a plain loop."""
    out = {}
    for c, target in (("source", "even"), ("lang", M.TARGETS["lang"]), ("mix_topic", "even")):
        natural = (rows.mix_tokens.groupby(rows[c].fillna(M.NONE)).sum() / rows.mix_tokens.sum()).to_dict()
        share = {v: 1 / len(natural) if target == "even" else target[v] for v in natural}
        full = set()
        while True:
            left, free = 1 - sum(natural[v] / keep for v in full), sum(share[v] for v in natural if v not in full)
            now = {v: natural[v] / keep if v in full else share[v] * left / free for v in natural}
            over = {v for v in natural if now[v] > natural[v] / keep + 1e-12}
            if not over:
                break
            full |= over
        out[c] = now
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_production_rounds_meet_the_targets(spark, sf):
    """The expected tokens of the sample, without weights, and the sampled ones themselves."""
    rows = M.mix(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).drop("text").toPandas()
    want, got = wanted(rows), shares_of(rows, rows.mix_tokens * rows.mix_probability)
    for c, shares in want.items():
        assert all(got[c][v] == pytest.approx(s, abs=4e-3) for v, s in shares.items()), (c, shares, got[c])
    assert (rows.mix_probability <= 1).all() and set(rows.mix_weight.round(9)) <= {0.0, 1.0}
    if sf == "0.1":
        sampled = shares_of(rows[rows.mix_kept], rows.mix_tokens[rows.mix_kept])
        assert all(abs(sampled[c][v] - s) < 0.03 for c in ("lang", "mix_topic") for v, s in want[c].items())


def test_sampled_tokens_are_near_their_expectation(spark):
    rows = M.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("mix_kept", "mix_probability").toPandas()
    assert rows.mix_kept.sum() == pytest.approx(rows.mix_probability.sum(), rel=0.05)


def test_targets_for_values_that_do_not_occur(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    rows = M.mix(docs, {"source": {"src0": 0.5, "nowhere": 0.2}, "lang": "even"}, rounds=12).drop("text").toPandas()
    got = shares_of(rows, rows.mix_tokens * rows.mix_probability)
    most = rows.mix_tokens[rows.source == "src0"].sum() / rows.mix_tokens.sum() / M.KEEP
    assert got["source"]["src0"] == pytest.approx(min(0.5 / 0.8, most), abs=0.02)


def test_cells_in_many_partitions_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    out = []
    for n in (M.PART_CELLS, 40):
        monkeypatch.setattr(M, "PART_CELLS", n)
        out.append(M.mix(docs, rounds=3).select("doc_id", "mix_probability", "mix_kept").toPandas().sort_values("doc_id"))
    assert np.allclose(out[0].mix_probability, out[1].mix_probability) and (out[0].mix_kept.to_numpy() == out[1].mix_kept.to_numpy()).all()


def test_against_sql(spark):
    from lumenframe.llm.queries import op8

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(M.ORACLE).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = op8(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got.doc_id == want.doc_id).all() and (got.topic == want.topic).all() and (got.n_tokens == want.n_tokens).all() and np.allclose(got[["probability", "weight"]], want[["probability", "weight"]], atol=2e-6)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, "en", 4), (1, "", "s", None, 5), (None, "a b\u00a0c ing", "s", "en", 6), (2, "x " * 100_000, "s", "en", 7)], "doc_id long, text string, source string, lang string, mix_tokens int")
    got = {(r.doc_id, r.text): r for r in M.mix(docs).collect()}
    assert len(got) == 4 and got[None, "a b\u00a0c ing"].mix_tokens == 3 and got[2, "x " * 100_000].mix_tokens == 100_000 and got[1, None].mix_tokens == 0
    assert M.mix(docs.limit(0)).count() == 0
    assert M.mix(docs.where("text = ''")).first().mix_probability == 0.5


def test_null_and_unlisted_languages_keep_their_share(spark):
    rows = [(i, "some words of a text " * (1 + i % 3), f"s{i % 2}", ["en", "fr", "de", "es", None, "it"][i % 6]) for i in range(120)]
    rows += [(200 + i, "more words in another text", "hot", None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    a = M.mix(docs, rounds=12).toPandas().sort_values("doc_id")
    assert (a.mix_probability > 0).all()
    mass = a.mix_tokens * a.mix_probability
    lang, source = (mass.groupby(a[c].fillna(M.NONE)).sum() / mass.sum() for c in ("lang", "source"))
    natural = a.mix_tokens.groupby(a.lang.fillna(M.NONE)).sum() / a.mix_tokens.sum()
    # they keep about their share; named languages get what is left, no more than twice their own (keep is a half)
    assert all(lang[v] == pytest.approx(natural[v], abs=0.06) for v in (M.NONE, "it")) and source["hot"] > 0.2
    assert all(lang[v] <= 2 * natural[v] + 1e-6 for v in M.TARGETS["lang"]) and lang["en"] > lang["fr"]
