"""Plans on streams of volumes. A plan is a stateless map of rows, so a stream needs no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenframe.functions.volumes import VOLUME_SCHEMA, volumes
from lumenframe.plans.apply import augment
from lumenframe.plans.node import Transform


def read_volumes(spark: SparkSession, path: str, schema: str = VOLUME_SCHEMA, files_per_batch: int = 16) -> DataFrame:
    """Volumes from Parquet files as they arrive under path."""
    return volumes(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def augment_stream(stream: DataFrame, plan: Transform, path: str, checkpoint: str, seed: int | None = None, epoch: int = 0, available_now: bool = False) -> StreamingQuery:
    """Writes each arriving volume, augmented, as Parquet under path. Restarted, it goes on; draws depend on ids only."""
    writer = augment(stream, plan, seed, epoch).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
