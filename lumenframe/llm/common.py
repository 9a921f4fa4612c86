"""What the operators of this subpackage share: the folder for cut lineage, hashing and text helpers."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

MASK64 = 0xFFFFFFFFFFFFFFFF


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; a temporary one only on a local master, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this driver has stored and not removed: results that are read lazily still need it, so it goes when the driver ends.
KEPT: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"
    KEPT[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    KEPT.pop(path, None)


@atexit.register
def delete_all() -> None:
    """The last intermediate tables of the driver's sessions that are still open."""
    for path, spark in list(KEPT.items()):
        if spark._jsc.sc().isStopped() if spark._sc._jsc is not None else True:
            continue
        delete(spark, path)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written once in the shared folder and read from there: its lineage ends, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def sent(spark: SparkSession, value):
    """value broadcast with the source of its classes: workers need no copy of this package. See received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast):
    return pickle.loads(broadcast.value)


def remove(*frames: DataFrame) -> None:
    """Delete the files of stored() frames that nothing will read again."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """Word to a 64-bit hash; remembers words up to a fixed number, and then starts over."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str | bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of width words, by a polynomial over the words' hashes; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : n + k]
    return mix(out)
