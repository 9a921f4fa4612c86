"""NIfTI-1 files as volumes, and volumes as NIfTI-1 files.

Files are read with Spark's binaryFile source, so any file system will do, and decoded in Arrow batches.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.plans.apply import views
from lumenframe.sources.files import write_files

SCHEMA = "path string, shape array<int>, image array<float>, spacing array<double>, modality string, metadata map<string,string>, affine array<double>"
# Data type codes of the format.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER = 348


def decode(content: bytes, dtype=np.float32) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Image in (z, y, x) or (y, x) order, spacing in the same order, and the 4 x 4 affine of (x, y, z)."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = next((o for o in "<>" if len(data) >= HEADER and struct.unpack(o + "i", data[:4])[0] == HEADER), None)
    if order is None or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack(order + "8h", data[40:56])
    size, code = list(dims[1 : dims[0] + 1]), struct.unpack(order + "h", data[70:72])[0]
    if code not in TYPES:
        raise ValueError(f"NIfTI data type {code} is not supported")
    zooms = struct.unpack(order + "8f", data[76:108])
    offset, slope, intercept = struct.unpack(order + "3f", data[108:120])
    kind = np.dtype(order + TYPES[code])
    image = np.frombuffer(data, kind, int(np.prod(size)), int(offset)).reshape(size, order="F")
    while image.ndim > 3 and image.shape[-1] == 1:
        image = image[..., 0]
    if image.ndim not in (2, 3):
        raise ValueError(f"a volume has 2 or 3 dimensions, not {image.ndim}")
    values = image.astype(np.float64) * slope + intercept if np.isfinite(slope) and slope not in (0.0,) and (slope, intercept) != (1.0, 0.0) else image
    return np.ascontiguousarray(values.T.astype(dtype)), [float(z) for z in zooms[image.ndim : 0 : -1]], _affine(data, order, zooms, image.shape)


def _affine(data: bytes, order: str, zooms, shape) -> np.ndarray:
    qform, sform = struct.unpack(order + "2h", data[252:256])
    out = np.eye(4)
    if sform > 0:
        out[:3] = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack(order + "6f", data[256:280])
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        out[:3, :3] = turn * np.array([zooms[1], zooms[2], zooms[3] * (-1 if zooms[0] < 0 else 1)])
        out[:3, 3] = x, y, z
    else:
        out[:3, :3] = np.diag(zooms[1:4])
        out[:3, 3] = [-(n - 1) / 2 * z for n, z in zip((*shape, 1)[:3], zooms[1:4])]
    return out


def encode(image: np.ndarray, spacing, affine=None, compress: bool = True) -> bytes:
    """A NIfTI-1 file of an image in (z, y, x) or (y, x) order; the affine is that of the spacing if none is given."""
    stored = np.asarray(image, np.float32).T
    zooms = [1.0, *map(float, spacing[::-1])] + [1.0] * (7 - len(spacing))
    matrix = np.diag([*zooms[1:4], 1.0]) if affine is None else np.asarray(affine, float).reshape(4, 4)
    header = bytearray(HEADER + 4)
    struct.pack_into("<i", header, 0, HEADER)
    struct.pack_into("<8h", header, 40, stored.ndim, *stored.shape, *[1] * (7 - stored.ndim))
    struct.pack_into("<hh", header, 70, 16, 32)
    struct.pack_into("<8f", header, 76, *zooms)
    struct.pack_into("<3f", header, 108, HEADER + 4, 1.0, 0.0)
    header[123] = 2  # millimetres
    struct.pack_into("<hh", header, 252, 0, 2)
    struct.pack_into("<12f", header, 280, *matrix[:3].ravel())
    header[344:348] = b"n+1\0"
    data = bytes(header) + np.asfortranarray(stored).tobytes(order="F")
    return gzip.compress(data, 4, mtime=0) if compress else data


def load_nifti(spark: SparkSession, path: str) -> DataFrame:
    """One row a file under path (a file, a folder or a glob of .nii and .nii.gz): path, shape, image, spacing, metadata, affine."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                image, spacing, affine = decode(content.as_buffer().to_pybytes())
                metadata = [("source", name), ("nifti_zooms", ",".join(map(repr, spacing[::-1]))), ("affine", ",".join(repr(float(x)) for x in affine.ravel()))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([list(image.shape)], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, image.size], pa.int32()), pa.array(image.ravel())), pa.array([spacing], pa.list_(pa.float64())),
                    pa.nulls(1, pa.string()), pa.array([metadata], pa.map_(pa.string(), pa.string())), pa.array([affine.ravel().tolist()], pa.list_(pa.float64())),
                ], ["path", "shape", "image", "spacing", "modality", "metadata", "affine"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(r"\.nii(\.gz)?$")).select("path", "content").mapInArrow(run, SCHEMA)


def to_nifti(df: DataFrame, name: str = "volume_id") -> DataFrame:
    """name and content (the bytes of a .nii.gz file) of each volume. Masks and targets are not part of the format."""
    affine = F.when(F.col("metadata").isNotNull(), F.col("metadata")["affine"])

    def run(batches):
        for batch in batches:
            for row, values in zip(batch.select(["name", "shape", "spacing", "affine"]).to_pylist(), views(batch.column("image"))):
                matrix = [float(x) for x in row["affine"].split(",")] if row["affine"] else None
                image = values.reshape(row["shape"])
                yield pa.RecordBatch.from_pydict({"name": pa.array([f"{row['name']}.nii.gz"]), "content": pa.array([encode(image, row["spacing"] or [1.0] * image.ndim, matrix)], pa.binary())})

    return df.select(F.col(name).cast("string").alias("name"), "shape", "image", "spacing", affine.alias("affine")).mapInArrow(run, "name string, content binary")


def save_nifti(df: DataFrame, folder: str, name: str = "volume_id") -> DataFrame:
    """Writes a .nii.gz file for each volume into a folder (a path or a URI of a shared file system); the rows name and bytes, once written."""
    return write_files(to_nifti(df, name), folder)
