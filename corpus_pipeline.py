"""Documents to training data: quality, near-duplicates, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; run() writes each result
as Parquet in the shared folder and reads it again for the next stage. Null ids stay through the first three stages.
Null and empty texts are documents like others; rows that repeat an id are one document for the near-duplicates; an
empty table stays empty; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, mixing, near_dup, quality
from lumenframe.llm.common import delete, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is more likely than not."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, labels).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.deduplicated(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target weights of sources, languages and topics."""
    mixed = mixing.mix(docs).where("mix_kept")
    return mixed.select(*COLUMNS, F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.round("mix_weight", 6).alias("weight"))


STAGES = [("quality", select_quality), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("source mix", mix_sources)]

#: The first three stages are a fitted model, sampled hashing and a token alignment, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage before has been read for the last time
            delete(spark, before)
        before = path
    return docs
