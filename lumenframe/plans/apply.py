"""Plans on volume tables: one narrow pass over Arrow batches, without a shuffle, whatever the plan.

Each row's image, mask and targets are views of the batch's buffers; all operators of the plan run on them in turn, so
a row crosses to Python and back once. Draws are keyed by the volume's id: partitions and retries change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from lumenframe.functions.draws import Draws
from lumenframe.functions.volumes import COLUMNS, volumes
from lumenframe.plans.node import Compose, Transform
from lumenframe.plans.sample import Sample

OWN = ("shape", "image", "mask", "spacing", "keypoints", "bboxes")
BATCH = 64 << 20


def simplified(plan: Transform) -> Transform | None:
    """The plan without nodes that cannot change a volume, so that Spark need not run them: None if nothing is left."""
    from lumenframe import operators as o

    idle = (
        plan.p == 0
        or isinstance(plan, Compose) and all(simplified(t) is None for t in plan.transforms)
        or isinstance(plan, o.GaussianBlur) and plan.given["sigma"] == (0.0, 0.0)
        or isinstance(plan, o.Sharpen) and plan.given["alpha"] == (0.0, 0.0) and plan.given["clip"] is None
        or isinstance(plan, o.BiasField) and plan.given["alpha"] == 0
        or isinstance(plan, o.MedianBlur) and plan.given["ksize"] == (1, 1)
        or isinstance(plan, o.HistogramMatch) and plan.given["reference"] is None
        or isinstance(plan, o.SlabShift) and plan.given["max_shift"] == (0, 0)
        or isinstance(plan, o.RandomFlip) and plan.given["p_per_axis"] == 0
    )
    return None if idle else plan


def sample_of(row: dict, image: np.ndarray, mask: np.ndarray | None) -> Sample:
    shape, ndim = tuple(row["shape"]), len(row["shape"])
    points, boxes = row["keypoints"], row["bboxes"]
    metadata = dict(row["metadata"] or ())
    if row.get("modality") is not None:
        metadata.setdefault("modality", row["modality"])
    array = lambda rows, key: np.array([r[key] for r in rows], float).reshape(-1, ndim)
    return Sample(
        image.reshape(shape), None if mask is None else mask.reshape(shape), tuple(row["spacing"] or (1.0,) * ndim), metadata,
        None if points is None else array(points, "coord"), tuple(r["label"] for r in points or ()),
        None if boxes is None else array(boxes, "lo"), None if boxes is None else array(boxes, "hi"), tuple(r["label"] for r in boxes or ()),
    )


def row_of(s: Sample) -> tuple:
    points = None if s.points is None else [{"coord": p.tolist(), "label": x} for p, x in zip(s.points, s.point_labels)]
    boxes = None if s.lows is None else [{"lo": lo.tolist(), "hi": hi.tolist(), "label": x} for lo, hi, x in zip(s.lows, s.highs, s.box_labels)]
    return list(s.shape), s.image.ravel(), None if s.mask is None else s.mask.ravel(), list(s.spacing), points, boxes


def lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list column of NumPy arrays, without a Python object for each element."""
    sizes = np.array([0 if a is None else len(a) for a in arrays])
    values = np.concatenate([a for a in arrays if a is not None]) if any(a is not None for a in arrays) else np.zeros(0)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.int32())
    missing = pa.array([a is None for a in arrays])
    return pa.ListArray.from_arrays(offsets, pa.array(values).cast(kind), mask=missing)


def views(column: pa.Array) -> list[np.ndarray | None]:
    offsets, values, valid = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def augment(df: DataFrame, plan: Transform, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """df with each volume replaced by the plan's output; other columns stay. Works on streaming tables too.

    seed is the plan's own if it is None, else 0. Images stay in their type (array<float> or array<double>; others
    become float). Null images stay null.
    """
    plan_seed = seed if seed is not None else plan.seed or 0
    df = volumes(df)
    kind = df.schema["image"].dataType
    if not isinstance(kind, ArrayType) or kind.elementType.simpleString() not in ("float", "double"):
        df = df.withColumn("image", F.col("image").cast("array<float>"))
    if simplified(plan) is None:
        return df
    others = [c for c in df.columns if c not in OWN]
    schema = StructType([*(df.schema[c] for c in others), *(df.schema[c] for c in OWN)])
    value = pa.float64() if isinstance(df.schema["image"].dataType.elementType, DoubleType) else pa.float32()
    kinds = [pa.list_(pa.int32()), pa.list_(value), pa.list_(pa.int32()), pa.list_(pa.float64()), None, None]
    points = pa.list_(pa.struct([("coord", pa.list_(pa.float64())), ("label", pa.string())]))
    boxes = pa.list_(pa.struct([("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("label", pa.string())]))
    small = [c for c in COLUMNS if c not in ("image", "mask")]

    def run(batches):
        for batch in batches:
            rows = batch.select(small).to_pylist()
            images, masks = views(batch.column("image")), views(batch.column("mask"))
            first, held, out = 0, 0, []
            for i, (row, image, mask) in enumerate(zip(rows, images, masks)):
                if image is None:
                    out.append((row["shape"], None, mask, row["spacing"], row["keypoints"], row["bboxes"]))
                else:
                    result = plan(sample_of(row, image, mask), Draws(plan_seed, "0", row["volume_id"], epoch))
                    out.append(row_of(result))
                    held += result.image.nbytes
                if held < BATCH and i + 1 < len(rows):
                    continue
                shape, image, mask, spacing, kp, bb = zip(*out)
                columns = [pa.array(shape, kinds[0]), lists(list(image), value), lists(list(mask), pa.int32()), pa.array(spacing, kinds[3]), pa.array(kp, points), pa.array(bb, boxes)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(out)) for c in others), *columns], [*others, *OWN])
                first, held, out = i + 1, 0, []

    columns = df.columns
    return df.select(*others, *OWN).mapInArrow(run, schema).select(*columns)


def reports(df: DataFrame, validator) -> DataFrame:
    """volume_id, ok, errors and warnings (the checks' names) and text of the validator's report on each volume, without a reference.

    vol.issues() has the same findings as a column expression; this is for the messages.
    """

    def run(batches):
        for batch in batches:
            rows = batch.select(["volume_id", "shape"]).to_pylist()
            out = []
            for row, image, mask in zip(rows, views(batch.column("image")), views(batch.column("mask"))):
                shaped = lambda a: None if a is None else a.reshape(row["shape"]) if a.size == np.prod(row["shape"]) else a  # noqa: B023, E731
                found = validator.validate(Sample(shaped(image), shaped(mask)))
                out.append((row["volume_id"], found.ok, [i.check for i in found.errors], [i.check for i in found.warnings], str(found)))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()))], ["volume_id", "ok", "errors", "warnings", "text"])

    own = volumes(df).where("image is not null").select(F.col("volume_id").cast("long").alias("volume_id"), "shape", "image", "mask")
    return own.mapInArrow(run, "volume_id long, ok boolean, errors array<string>, warnings array<string>, text string")


def plan_steps(spark, plan: Transform) -> DataFrame:
    """path, name, params (as JSON) and depth of each node of a plan."""
    import json

    from lumenframe.plans.node import iter_pipeline, plain

    rows = [(list(s.path), s.name, json.dumps(plain(s.params), sort_keys=True), s.depth) for s in iter_pipeline(plan)]
    return spark.createDataFrame(rows, "path array<int>, name string, params string, depth int")
