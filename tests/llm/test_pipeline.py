import corpus_pipeline
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, mixing, near_dup, quality

SF = "/root/testdata/sf0.01"


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), 1000
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in out.collect()}
        if k < 3:
            assert out.columns == corpus_pipeline.COLUMNS
        if k == 0:
            want = {r.doc_id for r in quality.select(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
        elif k == 1:
            want = {r.class_id for r in near_dup.classes(docs).collect()}
        elif k == 2:
            want = {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            items = [" ".join(t.split()) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
            assert not any(i in " ".join(r.text.split()) for r in out.collect() for i in items)
        else:
            want = {r.doc_id for r in mixing.mix(docs).where("mix_kept").collect()}
        assert ids == want and 0 < len(ids) < before, name
        docs, before = out, len(ids)


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.select_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id").withColumn("k", F.lit(1))
    r = labels.where("quality = 1 and toxic = 0").join(kept, "doc_id", "left").agg(F.avg(F.coalesce("k", F.lit(0)))).first()
    assert r[0] > 0.99


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len([q for q in __spark_entry__.queries() if q.startswith("op")]) == 10


def test_odd_documents_and_columns_that_clash(spark, tmp_path):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "no id at all", "en", "s"), (9001, None, None, None), (9002, "", "xx", "s"), (9003, "word " * 60_000, "en", None), (9004, "the same row twice", "en", "s"), (9004, "the same row twice", "en", "s")], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(plain.schema["n_chars"].dataType))
    docs = plain.unionByName(odd).withColumns({c: F.lit(7) for c in ("kept", "tail", "class_id", "band", "mix_kept", "hash", "item_id", "node")})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for empty in (True, False):
            path = str(tmp_path / f"{k}-{empty}")
            stage(spark, docs.limit(0) if empty else docs, SF).write.parquet(path)
            out = spark.read.parquet(path)
            assert out.columns[:5] == corpus_pipeline.COLUMNS and (out.count() == 0) == empty, name
