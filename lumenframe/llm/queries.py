"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import chat, decontaminate, html, licenses, lm_score, mixing, near_dup, quality, topk, warc
from lumenframe.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return lm_score.score(docs, lm_score.train(docs.where(~held_out)), held_out)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"))
    return topk.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.read_archives(spark, path))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.select(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", *(F.get("tail", F.lit(i)).alias(f"p_grade_{i + 1}") for i in range(quality.GRADES - 1)), "kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source", "lang"]).where("mix_kept")
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.round("mix_weight", 6).alias("weight"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")))
    return chat.digests(chat.read_back(chat.format_chats(chat.records_of(rows), "conv_id", "record"), "conv_id"), "conv_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_lm_score": op1, "op2_html_text": op2, "op3_near_dup": op3, "op4_topk_search": op4, "op5_warc_revisits": op5, "op6_license_scan": op6, "op7_ordinal_quality": op7, "op8_source_mix": op8, "op9_chat_format": op9, "op10_decontaminate": op10, "pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {"op4_topk_search": topk.ORACLE, "op5_warc_revisits": warc.ORACLE, "op8_source_mix": mixing.ORACLE, "op9_chat_format": chat.ORACLE}
