"""Queries of sources, sinks, adapters, plans as data, and validators, over the test tables, and the same in SQL.

Files are made from the tables, written to a shared folder and read back; the SQL has what must come out.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import operators as o
from lumenframe.functions import volumes as vol
from lumenframe.plans import node
from lumenframe.plans.apply import augment, plan_steps, reports
from lumenframe.plans.node import Guard, Transform, register_transform
from lumenframe.plans.presets import PRESETS
from lumenframe.plans.validate import VolumeValidator
from lumenframe.queries import ORACLE_SQL as BASE_SQL
from lumenframe.queries import SEED, V2, V3, _flip_gamma_noise, field, gather, images, rows, shown, six, stacks, uniform, unit, voxel_rows
from lumenframe.sources import adapt, dicom, nifti
from lumenframe.sources.files import new_folder, write_files
from lumenframe.streaming.augment import augment_stream, read_volumes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- DICOM -----------------------------------------------------------------------------------------------------------

EXPLICIT, IMPLICIT, PACKED = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.4.50"


def element(group: int, number: int, kind: bytes, value, explicit: bool = True) -> bytes:
    if isinstance(value, str):
        value = value.encode()
    value += b" " * (len(value) % 2)
    if not explicit:
        return struct.pack("<HHI", group, number, len(value)) + value
    return struct.pack("<HH2s", group, number, kind) + (struct.pack("<HI", 0, len(value)) if kind in dicom.LONG else struct.pack("<H", len(value))) + value


def dicom_file(syntax: str, body: list[tuple]) -> bytes:
    head = element(2, 0x0010, b"UI", syntax.encode() + b"\0" * (len(syntax) % 2))
    return b"\0" * 128 + b"DICM" + head + b"".join(element(*e, syntax != IMPLICIT) for e in sorted(body))


def whole(value: int) -> bytes:
    return struct.pack("<H", value)


def slice_of(vec_id: int, values: np.ndarray) -> tuple[str, bytes]:
    """A slice of 8 x 8 unsigned 16-bit pixels: its series is eight ids, ordered by position, location or instance number."""
    series, k = divmod(vec_id, 8)
    body = [
        (0x0008, 0x0060, b"CS", "CT" if series % 2 else "MR"), (0x0008, 0x0070, b"LO", "Maker"), (0x0010, 0x0020, b"LO", f"P{series}"), (0x0020, 0x000E, b"UI", f"1.2.{series}"), (0x0028, 0x0010, b"US", whole(8)), (0x0028, 0x0011, b"US", whole(8)),
        (0x0028, 0x0030, b"DS", "0.75\\0.5"), (0x0028, 0x0100, b"US", whole(16)), (0x0028, 0x0103, b"US", whole(0)), (0x0028, 0x1052, b"DS", "-10"), (0x7FE0, 0x0010, b"OW", np.floor((values + 1) * 1000).astype("<u2").tobytes()),
    ]
    if k != 2:
        body.append((0x0028, 0x1053, b"DS", "0.5"))
    if series % 3 == 0:
        body += [(0x0020, 0x0032, b"DS", f"1\\2\\{-2 * k}"), (0x0020, 0x0037, b"DS", "1\\0\\0\\0\\1\\0"), (0x0020, 0x0013, b"IS", str(k))]
    elif series % 3 == 1:
        body += [(0x0020, 0x1041, b"DS", str(3 * (k * 5 % 8))), (0x0020, 0x0013, b"IS", str(k))]
    else:
        body.append((0x0020, 0x0013, b"IS", str(8 - k)))
    return f"{vec_id}.dcm" if vec_id % 5 else f"IM{vec_id}", dicom_file(IMPLICIT if series % 4 == 1 else EXPLICIT, body)


def frames_of(vec_id: int, values: np.ndarray) -> tuple[str, bytes]:
    """Two frames of 4 x 8 signed 16-bit pixels in one file; some files are compressed, without pixels, or no DICOM at all."""
    body = [
        (0x0020, 0x000E, b"UI", f"1.3.{vec_id}"), (0x0028, 0x0008, b"IS", "2"), (0x0028, 0x0010, b"US", whole(4)), (0x0028, 0x0011, b"US", whole(8)), (0x0018, 0x0050, b"DS", "2.5"), (0x0028, 0x0030, b"DS", "1.5\\1.25"), (0x0028, 0x0100, b"US", whole(16)), (0x0028, 0x0103, b"US", whole(1)),
        (0x7FE0, 0x0010, b"OW", np.floor(values * 1000).astype("<i2").tobytes()),
    ]
    if vec_id % 10 == 7:
        body.pop()
    content = b"nothing of the kind" if vec_id % 10 == 8 else dicom_file(PACKED if vec_id % 10 == 9 else EXPLICIT, body)
    return f"{vec_id}.dcm", content


def files_of(spark: SparkSession, sf_dir: str, make, name: str) -> str:
    """The folder of the files that make() gives for each row of embeddings."""

    def run(batches):
        for batch in batches:
            found = [make(i, np.array(v, float)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in found], pa.string()), "content": pa.array([c for _, c in found], pa.binary())})

    folder = new_folder(spark, name)
    write_files(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(run, "name string, content binary"), folder)
    return folder


_order = """p AS MATERIALIZED (SELECT vec_id, vec_id // 8 AS s, embedding, CASE WHEN (vec_id // 8) % 3 = 0 THEN -2.0 * (vec_id % 8) WHEN (vec_id // 8) % 3 = 1 THEN 3.0 * ((vec_id % 8) * 5 % 8) ELSE 8.0 - vec_id % 8 END AS place FROM embeddings),
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY place) - 1 AS z, abs(place - lag(place) OVER (PARTITION BY s ORDER BY place)) AS step FROM p)"""


@query("dicom_series", f"WITH {_order} SELECT s::BIGINT AS volume_id, z::INTEGER AS z, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, {shown('floor((e + 1) * 1000) * 0.5 - 10')} AS v FROM (SELECT s, z, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM q)")
def dicom_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dicom.stacked(dicom.load_slices(spark, files_of(spark, sf_dir, slice_of, "dicom")))
    df = df.withColumns({"volume_id": F.split(F.col("metadata")["series_uid"], r"\.")[2].cast("long"), "mask": F.lit(None).cast("array<int>")})
    return vol.to_voxels(df).select("volume_id", "z", "y", "x", six(F.col("v").cast("double")).alias("v"))


@query("dicom_metadata", f"WITH {_order} SELECT s::BIGINT AS volume_id, count(*) || ',8,8' AS shape, median(step)::DOUBLE AS dz, 0.75::DOUBLE AS dy, 0.5::DOUBLE AS dx, CASE WHEN s % 2 = 1 THEN 'CT' ELSE 'MR' END AS modality, 'Maker' AS vendor, 'P' || s AS patient_id, count(*)::VARCHAR AS num_slices, '-10.0' AS rescale_intercept FROM q GROUP BY s")
def dicom_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dicom.stacked(dicom.load_slices(spark, files_of(spark, sf_dir, slice_of, "dicom")))
    fact = lambda k: F.col("metadata")[k].alias(k)
    return df.select(F.split(F.col("metadata")["series_uid"], r"\.")[2].cast("long").alias("volume_id"), F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), *(F.col("spacing")[i].alias(c) for i, c in enumerate(("dz", "dy", "dx"))), "modality", fact("vendor"), fact("patient_id"), fact("num_slices"), fact("rescale_intercept"))


@query("dicom_frames", "SELECT vec_id::BIGINT AS volume_id, '2,4,8' AS shape, '2.5,1.5,1.25' AS spacing, (i // 32)::INTEGER AS z, (i // 8 % 4)::INTEGER AS y, (i % 8)::INTEGER AS x, CASE WHEN floor(e * 1000) = 0 THEN 0.0::DOUBLE ELSE floor(e * 1000) END AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 10 < 7)")
def dicom_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dicom.stacked(dicom.load_slices(spark, files_of(spark, sf_dir, frames_of, "dicom")))
    df = df.withColumns({"volume_id": F.split(F.col("metadata")["series_uid"], r"\.")[2].cast("long"), "mask": F.lit(None).cast("array<int>")})
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return vol.to_voxels(df, "shape", "spacing").select("volume_id", text("shape"), text("spacing"), "z", "y", "x", six(F.col("v").cast("double")).alias("v"))


@query("dicom_unreadable", f"SELECT vec_id || '.dcm' AS name, CASE vec_id % 10 WHEN 9 THEN 'DICOM transfer syntax {PACKED} is not supported' ELSE 'no pixel data' END AS fault FROM embeddings WHERE vec_id % 10 >= 7")
def dicom_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dicom.unreadable(spark, files_of(spark, sf_dir, frames_of, "dicom")).select(F.element_at(F.split("path", "/"), -1).alias("name"), "fault")


@query("dicom_faulty_series", "SELECT 'group' || vec_id // 20 AS key, 'slices of a series differ in size' AS fault FROM embeddings GROUP BY vec_id // 20 HAVING count(DISTINCT vec_id % 3) > 1")
def dicom_faulty_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a series' UID in a folder for every twenty ids, of 8 x 8 or 4 x 8 pixels."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("x:/group"), F.floor(F.col("vec_id") / 20), F.lit("/"), F.col("vec_id")).alias("path"), F.lit(None).cast("string").alias("series_uid"), F.when(F.col("vec_id") % 3 == 0, 8).otherwise(4).alias("rows"), F.lit(8).alias("columns"), F.lit(1).alias("frames"))
    return dicom.faulty_series(ids).select(F.element_at(F.split("key", "/"), -1).alias("key"), "fault")


# --- NIfTI, Parquet, memory ------------------------------------------------------------------------------------------


def _nifti(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "nifti")
    nifti.save_nifti(stacks(spark, sf_dir).withColumn("spacing", F.array(F.lit(2.0), F.lit(0.75), F.lit(0.5))), folder)
    return nifti.load_nifti(spark, folder).withColumn("volume_id", F.regexp_extract("path", r"(\d+)\.nii\.gz$", 1).cast("long"))


@query("nifti_roundtrip", f"WITH {V3} SELECT volume_id::BIGINT AS volume_id, z::INTEGER AS z, y::INTEGER AS y, x::INTEGER AS x, {shown('v::FLOAT::DOUBLE')} AS v FROM v")
def nifti_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vol.to_voxels(_nifti(spark, sf_dir).withColumn("mask", F.lit(None).cast("array<int>"))).select("volume_id", "z", "y", "x", six(F.col("v").cast("double")).alias("v"))


@query("nifti_header", "SELECT DISTINCT (vec_id // 4)::BIGINT AS volume_id, '4,8,8' AS shape, '2.0,0.75,0.5' AS spacing, '0.5,0.0,0.0,0.0,0.0,0.75,0.0,0.0,0.0,0.0,2.0,0.0,0.0,0.0,0.0,1.0' AS affine FROM embeddings WHERE vec_id // 4 IN (SELECT vec_id // 4 FROM embeddings GROUP BY 1 HAVING count(*) = 4)")
def nifti_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _nifti(spark, sf_dir).select("volume_id", text("shape"), text("spacing"), text("affine"))


@query("nifti_written", "SELECT DISTINCT vec_id // 4 || '.nii.gz' AS name, TRUE AS some_bytes FROM embeddings WHERE vec_id // 4 IN (SELECT vec_id // 4 FROM embeddings GROUP BY 1 HAVING count(*) = 4)")
def nifti_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nifti.save_nifti(stacks(spark, sf_dir), new_folder(spark, "nifti")).select("name", (F.col("bytes") > 352).alias("some_bytes"))


@query("parquet_roundtrip", f"WITH {V2} {rows('v', 'v')}")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "parquet")
    vol.volumes(images(spark, sf_dir)).write.parquet(folder)
    return voxel_rows(vol.checked(spark.read.parquet(folder)))


@query("memory_source", "SELECT vec_id::BIGINT AS volume_id, '1.0,1.0' AS spacing, FALSE AS has_mask, 0 AS num_keypoints, 0 AS num_bboxes, 2 AS ndim FROM embeddings")
def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare arrays with a shape: all that they lack has its default."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("volume_id"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").alias("image"))
    df = vol.derived(vol.checked(vol.volumes(df)))
    return df.select("volume_id", F.array_join(F.col("spacing").cast("array<string>"), ",").alias("spacing"), "has_mask", "num_keypoints", "num_bboxes", "ndim")


@query("stream_augment", f"WITH {V2} SELECT volume_id::BIGINT AS volume_id, z::INTEGER AS z, (CASE WHEN {unit('flip0')} < 0.5 THEN 7 - y ELSE y END)::INTEGER AS y, (CASE WHEN {unit('flip1')} < 0.5 THEN 7 - x ELSE x END)::INTEGER AS x, {shown('v::FLOAT::DOUBLE')} AS v, m::INTEGER AS label FROM v")
def stream_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes that arrive as files, augmented as a stream until all are done."""
    path = new_folder(spark, "stream")
    df = vol.volumes(images(spark, sf_dir)).withColumn("image", F.col("image").cast("array<float>"))
    df.select(*vol.COLUMNS).repartition(4).write.parquet(f"{path}/in")
    stream = read_volumes(spark, f"{path}/in", files_per_batch=2)
    augment_stream(stream, o.RandomFlip(axes=("x", "y")), f"{path}/out", f"{path}/checkpoint", SEED, available_now=True).awaitTermination()
    return voxel_rows(spark.read.parquet(f"{path}/out").withColumn("image", F.col("image").cast("array<double>")))


# --- adapters and operators of one's own -----------------------------------------------------------------------------

_flip = o.RandomFlip(axes=("x", "y"))
_flip_sql = BASE_SQL["random_flip"]


def _named(spark: SparkSession, sf_dir: str, image: str, mask: str) -> DataFrame:
    return images(spark, sf_dir).select(F.col("volume_id").alias("case_id"), F.col("shape").alias("size"), F.col("image").alias(image), F.col("mask").cast("array<smallint>").alias(mask), F.lit("kept").alias("more"))


def _unnamed(df: DataFrame, image: str, mask: str) -> DataFrame:
    return voxel_rows(df.where("more = 'kept'").select(F.col("case_id").alias("volume_id"), F.col("size").alias("shape"), F.col(image).alias("image"), F.col(mask).cast("array<int>").alias("mask")))


@query("augment_columns", _flip_sql)
def augment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unnamed(adapt.augment_columns(_named(spark, sf_dir, "scan", "seg"), _flip, shape="size", volume_id="case_id", seed=SEED), "scan", "seg")


@query("augment_channel", _flip_sql)
def augment_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's axis in front of the image's axes, away for the plan and back afterwards."""
    df = _named(spark, sf_dir, "scan", "seg").withColumn("size", F.concat(F.array(F.lit(1)), "size"))
    out = adapt.augment_columns(df, _flip, "scan", "seg", shape="size", volume_id="case_id", channel="first", seed=SEED)
    return _unnamed(out.where("size[0] = 1").withColumn("size", F.slice("size", 2, 2)), "scan", "seg")


@query("monai_columns", _flip_sql)
def monai_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unnamed(adapt.monai_columns(_named(spark, sf_dir, "image", "label"), _flip, shape="size", volume_id="case_id", seed=SEED), "image", "label")


class Subject(dict):
    """The least that a subject of images must be."""

    class Image:
        def __init__(self, data):
            self.data, self.spacing = data, ()

        def set_data(self, data):
            self.data = data


def _in_memory(spark: SparkSession, sf_dir: str, call) -> DataFrame:
    """Voxel rows of what call(image, mask) returns for each image of the table, run sample by sample."""

    def run(batches):
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = np.array(v, float).reshape(8, 8)
                image, mask = call(image, np.where(image > 0.2, 2, np.where(image > 0.1, 1, 0)).astype(np.int16))
                at = np.arange(64)
                v = np.round(np.asarray(image, float).ravel(), 6) + 0.0
                yield pa.RecordBatch.from_pydict({"volume_id": pa.array([i] * 64, pa.int64()), "z": pa.array(at * 0, pa.int32()), "y": pa.array(at // 8, pa.int32()), "x": pa.array(at % 8, pa.int32()), "v": pa.array(v), "label": pa.array(np.asarray(mask).ravel().astype(np.int32))})

    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return df.mapInArrow(run, "volume_id long, z int, y int, x int, v double, label int")


_both = o.RandomFlip(axes=("x", "y"), p_per_axis=1.0)
_both_sql = f"WITH {V2} {rows('v', 'v', y='7 - y', x='7 - x')}"


@query("torch_transform", _both_sql)
def torch_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_memory(spark, sf_dir, lambda image, mask: adapt.TorchTransform(_both)((image, mask)))


@query("monai_map_transform", _both_sql)
def monai_map_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(image, mask):
        out = adapt.MonaiMapTransform(_both, channel="first")({"image": image[None], "label": mask[None]})
        return out["image"][0], out["label"][0]

    return _in_memory(spark, sf_dir, call)


@query("torchio_transform", _both_sql)
def torchio_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(image, mask):
        out = adapt.TorchIOTransform(_both)(Subject(scan=Subject.Image(image[None]), tumour_mask=Subject.Image(mask[None])))
        return out["scan"].data[0], out["tumour_mask"].data[0]

    return _in_memory(spark, sf_dir, call)


@query("custom_operator", f"WITH {V2} {rows('v', '2 * v + 1')}")
def custom_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator of one's own, registered under another name, and a plan read from its JSON form."""

    class Linear(Transform):
        def __init__(self, factor: float = 2.0, p: float = 1.0, seed: int | None = None):
            super().__init__(p, seed)
            self.factor = factor

        def apply(self, sample, draws):
            return sample.having(image=sample.image * self.factor + 1)

        def params(self):
            return {"factor": self.factor}

    register_transform(Linear, name="LinearOfMine", override=True)
    try:
        return voxel_rows(augment(images(spark, sf_dir), node.from_dict({"name": "LinearOfMine", "params": {"factor": 2.0}}), SEED))
    finally:
        node.REGISTRY.pop("LinearOfMine")


# --- plans as data ---------------------------------------------------------------------------------------------------


@query("plan_from_json", BASE_SQL["compose_gate"])
def plan_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel_rows(augment(images(spark, sf_dir), node.from_json(node.to_json(_flip_gamma_noise)), SEED))


@query("plan_from_yaml", BASE_SQL["compose_gate"])
def plan_from_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel_rows(augment(images(spark, sf_dir), node.from_yaml(node.to_yaml(_flip_gamma_noise)), SEED))


@query("plan_from_dict", BASE_SQL["some_of"])
def plan_from_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = lambda name, **params: {"name": name, "params": params}
    plan = child("SomeOf", transforms=[child("BrightnessContrast", brightness=0.1), child("GridArtifact"), child("BrightnessContrast", contrast=[2.0, 2.0])], n=[1, 2])
    return voxel_rows(augment(images(spark, sf_dir), node.from_dict(plan), SEED))


# The names under which plans are stored.
NAMES = """AnatomicCrop AnisotropicElastic BeamHardening BiasField BrightnessContrast CLAHEContrast CenterCrop CoarseDropout Compose CompressionVariation ElasticDeform GammaCorrection GaussianBlur GaussianNoise GhostingArtifact GridArtifact
Guard HistogramMatch KSpaceDropout LimitedAngleBlur MRIMotion MedianBlur MetalStreak OneOf Pad RandomAffine RandomFlip ReconStreak Resize RicianNoise ScatterSimulation Sharpen SimulateLowResolution SlabShift SliceDropout SomeOf WindowLevel""".split()


@query("registry", f"SELECT unnest([{', '.join(map(quoted, NAMES))}]) AS name")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(node.REGISTRY)], "name string")


_summary = [
    "Compose(p=1.0, seed=42)", "  0 RandomFlip(axes=['x'], p_per_axis=0.5, p=0.5)", "  1 GammaCorrection(gamma=[0.7, 1.4], invert=False, p=1.0)", "  2 GaussianNoise(std=0.01, relative=False, clip=None, p=0.5)",
]


@query("pipeline_summary", "SELECT i - 1 AS line, [" + ", ".join(map(quoted, _summary)) + f"][i] AS text FROM range(1, {len(_summary) + 1}) r(i)")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(node.pipeline_summary(_flip_gamma_noise).split("\n"))), "line long, text string")


# The steps of the presets, with the parameters that are not the operators' defaults.
_affine = lambda rotation, scale, **more: {"rotation": [-rotation, rotation], "scale": list(scale), **more}
PRESET_STEPS: dict[str, list[tuple]] = {
    "mri": [
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.7, _affine(10.0, (0.9, 1.1), translation=[-0.05, 0.05])), ("ElasticDeform", 0.5, {"alpha": 30.0, "sigma": 4.0}), ("BiasField", 0.7, {"alpha": 0.3}), ("RicianNoise", 0.5, {"std": [0.005, 0.02]}), ("GammaCorrection", 0.5, {"gamma": [0.85, 1.15]}),
        ("OneOf", 0.3, {}), ("GhostingArtifact", 1.0, {"ghost_intensity": [0.05, 0.12]}), ("KSpaceDropout", 1.0, {"dropout_fraction": [0.01, 0.04]}), ("MRIMotion", 1.0, {"degrees": [1.0, 4.0], "translation": [1.0, 3.0]}),
    ],
    "ct": [
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.7, _affine(8.0, (0.9, 1.1), translation=[-0.03, 0.03])), ("ElasticDeform", 0.4, {"alpha": 20.0, "sigma": 4.0}), ("WindowLevel", 0.6, {"center_shift_frac": 0.05, "width_scale": [0.85, 1.15]}), ("GaussianNoise", 0.4, {"std": [5.0, 20.0]}),
        ("GammaCorrection", 0.4, {"gamma": [0.9, 1.1]}), ("BeamHardening", 0.3, {"alpha": [0.02, 0.07]}), ("MetalStreak", 0.15, {"intensity": [0.1, 0.25]}),
    ],
    "dxr": [
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.6, _affine(5.0, (0.95, 1.05), axes_enabled=["x", "y"])), ("GaussianBlur", 0.4, {"sigma": [0.3, 1.2]}), ("BrightnessContrast", 0.5, {"brightness": [-0.05, 0.05], "contrast": [0.9, 1.1]}), ("GammaCorrection", 0.5, {"gamma": [0.8, 1.2]}), ("CLAHEContrast", 0.3, {"clip_limit": [1.0, 2.5]}),
        ("SimulateLowResolution", 0.3, {"zoom_range": [0.6, 0.95]}), ("OneOf", 0.25, {}), ("ScatterSimulation", 1.0, {"fraction": [0.1, 0.3]}), ("GridArtifact", 1.0, {"amplitude": [0.03, 0.08]}),
    ],
    "dbt": [
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.7, _affine(5.0, (0.95, 1.05), axes_enabled=["x", "y"])), ("AnisotropicElastic", 0.5, {"alpha": [80.0, 80.0, 6.0], "sigma": [8.0, 8.0, 2.0]}), ("CompressionVariation", 0.4, {"scale": [0.9, 1.1]}), ("SlabShift", 0.5, {"max_shift": 2}), ("LimitedAngleBlur", 0.6, {"arc_degrees": [15.0, 25.0]}),
        ("ReconStreak", 0.3, {"amplitude": [0.05, 0.15]}), ("SliceDropout", 0.3, {"num_slices": [1, 2]}), ("BiasField", 0.5, {"alpha": 0.2, "coarse_shape": 3}), ("GammaCorrection", 0.5, {"gamma": [0.85, 1.15]}),
    ],
}


def _preset_steps(name: str):
    want = [(i, step, p, k, json.dumps(v)) for i, (step, p, params) in enumerate(PRESET_STEPS[name]) for k, v in {"p": p, **params}.items()]
    sql = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(s)}, {quoted(k)}, {quoted(v)})" for i, s, _, k, v in want) + ") t(step, name, parameter, value)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The steps of the preset in order, and of each its p, the parameters of the table above, and all others that are not the operator's own."""
        steps = plan_steps(spark, PRESETS[name](SEED)).where(F.size("path") > 0)
        rows = []
        for i, r in enumerate(steps.orderBy("path").collect()):
            plain = {} if r.name == "OneOf" else node.plain(node.REGISTRY[r.name]().params())
            listed = PRESET_STEPS[name][i][2] if i < len(PRESET_STEPS[name]) else {}
            rows += [(i, r.name, k, json.dumps(v)) for k, v in json.loads(r.params).items() if k == "p" or r.name != "OneOf" and (k in listed or plain[k] != v)]
        return spark.createDataFrame(rows, "step int, name string, parameter string, value string")

    query(f"preset_{name}_steps", sql)(run)


for _name in PRESETS:
    _preset_steps(_name)

# --- resampling in three dimensions, and by cubic splines ------------------------------------------------------------

_turns = """p AS MATERIALIZED (SELECT DISTINCT volume_id, radians({z}) AS az, radians({y}) AS ay, radians({x}) AS ax, {s0} AS s0, {s1} AS s1, {s2} AS s2, 4 * {t0} AS t0, 8 * {t1} AS t1, 8 * {t2} AS t2 FROM v)""".format(
    **{a: uniform(f"angle.{a}", -15.0, 15.0) for a in "zyx"}, **{f"s{i}": uniform(f"scale{i}", 0.9, 1.1) for i in range(3)}, **{f"t{i}": uniform(f"shift{i}", -0.05, 0.05) for i in range(3)}
)
# undone in turn: the turn of the first two axes, then of the first and last, then of the last two, then the scale
_affine3 = [
    _turns,
    "d AS (SELECT volume_id, z, y, x, z - 1.5 - t0 AS d0, y - 3.5 - t1 AS d1, x - 3.5 - t2 AS d2, az, ay, ax, s0, s1, s2 FROM v JOIN p USING (volume_id))",
    "e AS (SELECT * EXCLUDE (d0, d1), cos(az) * d0 + sin(az) * d1 AS d0, -sin(az) * d0 + cos(az) * d1 AS d1 FROM d)",
    "f AS (SELECT * EXCLUDE (d0, d2), cos(ay) * d0 - sin(ay) * d2 AS d0, sin(ay) * d0 + cos(ay) * d2 AS d2 FROM e)",
    "g AS (SELECT * EXCLUDE (d1, d2), cos(ax) * d1 + sin(ax) * d2 AS d1, -sin(ax) * d1 + cos(ax) * d2 AS d2 FROM f)",
    "c AS MATERIALIZED (SELECT volume_id, z, y, x, d0 / s0 + 1.5 AS c_z, d1 / s1 + 3.5 AS c_y, d2 / s2 + 3.5 AS c_x FROM g)",
    "inside AS MATERIALIZED (SELECT * FROM c WHERE c_z BETWEEN 0 AND 3 AND c_y BETWEEN 0 AND 7 AND c_x BETWEEN 0 AND 7)",
    gather("h", "inside", "v", "zyx", lambda i, n: f"least({i}, {n} - 1)"),
    "k AS (SELECT c.volume_id, c.z, c.y, c.x, w.m FROM inside c JOIN v w ON w.volume_id = c.volume_id AND w.z = floor(c_z + 0.5) AND w.y = floor(c_y + 0.5) AND w.x = floor(c_x + 0.5))",
]


@query("random_affine_3d", f"WITH {', '.join([V3, *_affine3])} " + rows("(SELECT v.volume_id, v.z, v.y, v.x, coalesce(h.o, 0) AS o, coalesce(k.m, 0) AS m FROM v LEFT JOIN h USING (volume_id, z, y, x) LEFT JOIN k USING (volume_id, z, y, x))"))
def random_affine_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel_rows(augment(stacks(spark, sf_dir), o.RandomAffine(rotation=15.0, scale=(0.9, 1.1), translation=0.05), SEED))


def spline_rows(n: int, size: int, pad: int = 12) -> list[list[float]]:
    """The weights of n values in each of size points of their cubic spline, corners in place, edges repeated outside."""
    whole = n + 2 * pad
    system = np.zeros((whole, whole))
    for i in range(whole):
        for j, w in ((i - 1, 1 / 6), (i, 4 / 6), (i + 1, 1 / 6)):
            system[i, -j if j < 0 else 2 * whole - 2 - j if j >= whole else j] += w
    edges = np.zeros((whole, n))
    edges[np.arange(whole), np.clip(np.arange(whole) - pad, 0, n - 1)] = 1
    out = []
    for t in range(size):
        c = t * (n - 1) / (size - 1) + pad
        k, f = int(np.floor(c)), c - np.floor(c)
        taps = ((1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6)
        out.append(sum(w * np.linalg.inv(system)[k - 1 + i] @ edges for i, w in enumerate(taps)).tolist())
    return out


_weights = "w AS (SELECT t, k, [" + ", ".join("[" + ", ".join(map(repr, r)) + "]" for r in spline_rows(4, 8)) + "][t + 1][k + 1]::DOUBLE AS w FROM range(8) a(t) CROSS JOIN range(4) b(k))"


_cubic_sql = f"WITH {V2}, grid AS (SELECT volume_id, q.y, r.x, q.y * 4 + r.x AS i FROM (SELECT DISTINCT volume_id FROM v) CROSS JOIN range(4) q(y) CROSS JOIN range(4) r(x)), {field('f', 'grid', 'coarse')}, {_weights}, b AS MATERIALIZED (SELECT volume_id, wy.t AS y, wx.t AS x, sum(wy.w * wx.w * 0.3 * (2 * f - 1)) AS o FROM f JOIN w wy ON wy.k = f.y JOIN w wx ON wx.k = f.x GROUP BY ALL) " + rows("v JOIN b USING (volume_id, y, x)", "v * exp(o)")
ORACLE_SQL["bias_field_cubic"] = _cubic_sql


# --- validators and guards -------------------------------------------------------------------------------------------

# every fifth image has a value that is none, the next one is constant, the next has a mask of another size
_broken = f"""{V2}, n AS MATERIALIZED (SELECT volume_id, i, m, CASE volume_id % 5 WHEN 0 THEN CASE WHEN i = 3 THEN 'nan'::DOUBLE ELSE v END WHEN 1 THEN 0.3 ELSE v END AS v FROM v),
a AS MATERIALIZED (SELECT volume_id, count(*) FILTER (NOT isfinite(v)) AS bad, min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi FROM n GROUP BY volume_id)"""
_checks = VolumeValidator(intensity_bounds=(-0.25, 0.25), strict_bounds=True)
_found = "CASE WHEN bad > 0 THEN 'finite' END, CASE WHEN bad = 0 AND lo = hi THEN 'constant' END, CASE WHEN volume_id % 5 = 2 THEN 'mask_shape' END, CASE WHEN lo < -0.25 OR hi > 0.25 THEN 'intensity_bounds' END"


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("volume_id") % 5
    image = F.when(kind == 0, F.transform("image", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v))).when(kind == 1, F.transform("image", lambda v: F.lit(0.3))).otherwise(F.col("image"))
    return images(spark, sf_dir).withColumns({"image": image, "mask": F.when(kind == 2, F.slice("mask", 1, 60)).otherwise(F.col("mask"))})


@query("validate_strict", f"WITH {_broken} SELECT volume_id, unnest(list_filter([{_found}], lambda x: x IS NOT NULL)) AS \"check\", 'error' AS severity FROM a")
def validate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(spark, sf_dir).select("volume_id", F.explode(vol.issues(_checks)).alias("i")).select("volume_id", "i.check", "i.severity")


@query("validate_faults", f"WITH {V2} SELECT DISTINCT volume_id, 'mask does not fit shape' AS fault FROM v WHERE volume_id % 5 = 2")
def validate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(spark, sf_dir).select("volume_id", F.explode(vol.faults()).alias("fault"))


@query("report_objects", f"WITH {_broken} SELECT volume_id, len(f) = 0 AS ok, len(f)::BIGINT AS errors, 0::BIGINT AS warnings, CASE WHEN len(f) = 0 THEN 'no issues' ELSE array_to_string(f, ',') END AS checks FROM (SELECT volume_id, list_filter([{_found}], lambda x: x IS NOT NULL) AS f FROM a WHERE volume_id % 5 <> 2)")
def report_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of the validator as objects, read in one pass over the images."""
    out = reports(broken(spark, sf_dir).where("volume_id % 5 <> 2"), _checks)
    return out.select("volume_id", "ok", F.size("errors").cast("long").alias("errors"), F.size("warnings").cast("long").alias("warnings"), F.when(F.size("errors") == 0, F.col("text")).otherwise(F.array_join("errors", ",")).alias("checks"))


_bright = o.BrightnessContrast(brightness=0.2, contrast=(0.7, 0.9))
_bright_sql = f"WITH {V2} " + rows("v", f"v * {uniform('contrast', 0.7, 0.9, '0.0')} + {uniform('brightness', -0.2, 0.2, '0.0')}")


@query("guard_warn", _bright_sql)
def guard_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not valid, and kept all the same."""
    return voxel_rows(augment(images(spark, sf_dir), Guard(_bright, VolumeValidator(intensity_bounds=(-0.1, 0.1), strict_bounds=True), on_fail="warn"), SEED))


@query("guard_raise", _bright_sql)
def guard_raise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is wrong, so nothing is raised; tests have the other case."""
    return voxel_rows(augment(images(spark, sf_dir), Guard(_bright, VolumeValidator(intensity_bounds=(-9.0, 9.0), strict_bounds=True), on_fail="raise"), SEED))
