"""Whole files on any file system: a table of names and contents as files in a folder, and back."""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of files that a task reads, about.
BLOCK = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only on a local master, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row (name, content) as a file into folder, a path or URI; the rows name and bytes, once all are written.

    Executors write to the file system of the URI themselves. Each file is written under another name and then moved,
    so retried tasks leave whole files. The rows returned are kept in the folder's _written.
    """

    def run(batches):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(path, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1)):
                part = f"{path}/.{uuid.uuid4().hex}"
                data = content.as_buffer()
                with where.open_output_stream(part) as out:
                    out.write(data)
                where.move(part, f"{path}/{name}")
                sizes.append(data.size)
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    kept = f"{folder}/_written"
    files.select(F.col("name").cast("string"), "content").mapInArrow(run, "name string, bytes long").write.mode("overwrite").parquet(kept)
    return files.sparkSession.read.schema("name string, bytes long").parquet(kept)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder of a mounted file system; None for globs, single files and other file systems."""
    if set(path) & set("{}[]*?\\"):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toUri().getPath() if system.getUri().getScheme() == "file" and system.isDirectory(where) else None


def entries(folder: str, deep: bool):
    """(path, size) of the files in folder, and below it where deep; else (path, null) of the folders in it. Names that Spark hides and empty files are left out."""
    folders = [folder]
    while folders:
        with os.scandir(folders.pop()) as found:
            for e in found:
                if e.name.startswith("_") and "=" not in e.name or e.name.startswith(".") or e.name.endswith("._COPYING_"):
                    continue
                if e.is_dir():
                    if deep:
                        folders.append(e.path)
                    else:
                        yield e.path, None
                elif e.is_file() and (size := e.stat().st_size):
                    yield e.path, size


def local_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of each file below a folder of a mounted file system, listed by executors: the folders in it side by side."""

    def run(batches, deep):
        def rows():
            for batch in batches:
                for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield from entries(path, deep) if size is None else [(path, size)]

        found = rows()
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in part], pa.string()), "size": pa.array([n for _, n in part], pa.int64())})

    top = spark.range(1, numPartitions=1).select(F.lit(folder).alias("path"), F.lit(None).cast("long").alias("size"))
    inside = top.mapInArrow(lambda batches: run(batches, False), "path string, size long")
    return inside.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(lambda batches: run(batches, True), "path string, size long")


def map_files(spark: SparkSession, path: str, wanted, run, schema: str) -> DataFrame:
    """The rows that run() makes, from pairs of path and content to record batches, of the files below path; wanted() is a condition on the column of their last names.

    A file costs the driver nothing where path is a folder of a mounted file system: executors list and read it. All
    other paths go through Spark's binaryFile, whose driver keeps the status of each file. Spark would give every few
    small files a task; here there are tasks of some tens of MB, or spark.sql.shuffle.partitions where that is more.
    """
    last = F.element_at(F.split("path", "/"), -1)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(name, "rb") as file:
                    yield f"file:{name}", file.read()

    def given(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield name, content.as_buffer().to_pybytes()

    if folder := local_folder(spark, path):
        files = local_files(spark, folder).where(wanted(last))
        count, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        tasks = max(min(count, least), size // BLOCK + 1)
        return files.select("path").repartition(tasks, "path").mapInArrow(lambda batches: run(read(batches)), schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = int(str(files._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return files.where(wanted(last)).select("path", "content").coalesce(max(least, size // BLOCK + 1)).mapInArrow(lambda batches: run(given(batches)), schema)
