"""The volume table: its schema, invariants, voxel form, and column functions over points, boxes and values.

Everything here is Spark expressions: no Python runs on executors.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<coord:array<double>,label:string>>"
BOXES = "array<struct<lo:array<double>,hi:array<double>,label:string>>"
VOLUME_SCHEMA = f"volume_id long, shape array<int>, image array<float>, mask array<int>, spacing array<double>, modality string, metadata map<string,string>, keypoints {POINTS}, bboxes {BOXES}"
COLUMNS = ("volume_id", "shape", "image", "mask", "spacing", "modality", "metadata", "keypoints", "bboxes")


def volumes(df: DataFrame) -> DataFrame:
    """df with all columns of a volume table: those that it lacks are null; a missing spacing is 1 on each axis."""
    missing = {f.split(" ")[0]: f.split(" ", 1)[1] for f in ("mask array<int>", "spacing array<double>", "modality string", "metadata map<string,string>", f"keypoints {POINTS}", f"bboxes {BOXES}")}
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in df.columns})
    return df.withColumn("spacing", F.when(F.coalesce(F.size("spacing"), F.lit(0)) <= 0, F.transform("shape", lambda _: F.lit(1.0))).otherwise(F.col("spacing")))


def faults() -> Column:
    """Which of a volume's invariants do not hold, as an array of texts."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, s: a * s)
    dims = F.size("shape")
    rules = {
        "shape must have 2 or 3 axes": ~dims.isin(2, 3) | F.col("shape").isNull(),
        "image does not fit shape": F.col("image").isNull() | (F.size("image") != n),
        "mask does not fit shape": F.col("mask").isNotNull() & (F.size("mask") != n),
        "spacing must have one value an axis": F.size("spacing") != dims,
        "keypoints must have one coordinate an axis": F.exists("keypoints", lambda k: F.size(k["coord"]) != dims),
        "bboxes must have one range an axis": F.exists("bboxes", lambda b: (F.size(b["lo"]) != dims) | (F.size(b["hi"]) != dims)),
        "bboxes must not end before they begin": F.exists("bboxes", lambda b: F.exists(F.zip_with(b["lo"], b["hi"], lambda lo, hi: lo > hi), lambda x: x)),
    }
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in rules.items())), lambda x: x.isNotNull())


def checked(df: DataFrame) -> DataFrame:
    """df; a row that breaks an invariant raises an error when it is read."""
    found = faults()
    return df.where(F.when(F.size(found) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("volume "), F.col("volume_id").cast("string"), F.lit(": "), F.array_join(found, "; "))).cast("boolean")))


def derived(df: DataFrame) -> DataFrame:
    """df with ndim, is_3d, has_mask, num_keypoints, num_bboxes, has_keypoints and has_bboxes."""
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return df.withColumns({
        "ndim": F.size("shape"), "is_3d": F.size("shape") == 3, "has_mask": F.col("mask").isNotNull(), "num_keypoints": count("keypoints"), "num_bboxes": count("bboxes"),
        "has_keypoints": count("keypoints") > 0, "has_bboxes": count("bboxes") > 0,
    })


def to_voxels(df: DataFrame, *more: str) -> DataFrame:
    """volume_id, z, y, x, v and label of each voxel, and more columns of its volume; z is 0 in two dimensions."""
    own = df.select("volume_id", *more, F.element_at("shape", -1).alias("w"), F.element_at("shape", -2).alias("h"), "mask", F.posexplode("image").alias("i", "v"))
    return own.select(
        "volume_id", F.floor(F.col("i") / (F.col("w") * F.col("h"))).cast("int").alias("z"), (F.floor(F.col("i") / F.col("w")) % F.col("h")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v",
        F.get("mask", F.col("i")).alias("label"), *more,
    )


def from_voxels(voxels: DataFrame, ndim: int) -> DataFrame:
    """volume_id, shape, image and mask from rows of voxels; every voxel has to be there."""
    rows = F.sort_array(F.collect_list(F.struct("z", "y", "x", "v", "label")))
    size = [F.max(c) + 1 for c in ("z", "y", "x")[3 - ndim :]]
    df = voxels.groupBy("volume_id").agg(F.array(*size).alias("shape"), rows.alias("rows"))
    return df.select("volume_id", "shape", F.transform("rows", lambda r: r["v"]).alias("image"), F.when(~F.exists("rows", lambda r: r["label"].isNull()), F.transform("rows", lambda r: r["label"])).alias("mask"))


def moved_points(points: Column, move) -> Column:
    """points with coordinates moved by a function from an array column to an array column."""
    return F.transform(points, lambda k: F.struct(move(k["coord"]).alias("coord"), k["label"].alias("label")))


def moved_boxes(boxes: Column, move, ndim: int) -> Column:
    """The boxes around the moved corners."""

    def box(b):
        corners = [move(F.array(*((b["hi"] if bit else b["lo"])[i] for i, bit in enumerate(bits)))) for bits in product((0, 1), repeat=ndim)]
        ends = lambda pick: F.array(*(pick(*(c[i] for c in corners)) for i in range(ndim)))
        return F.struct(ends(F.least).alias("lo"), ends(F.greatest).alias("hi"), b["label"].alias("label"))

    return F.transform(boxes, box)


def flip_map(shape: Column, axes: list[int], ndim: int):
    return lambda c: F.array(*((shape[i] - 1) - c[i] if i in axes else c[i] for i in range(ndim)))


def translate_map(offset: list[float]):
    return lambda c: F.array(*(c[i] + F.lit(float(o)) for i, o in enumerate(offset)))


def scale_map(factors: list[float]):
    return lambda c: F.array(*(c[i] * F.lit(float(f)) for i, f in enumerate(factors)))


def affine_map(matrix: list[list[float]], shape: Column, offset: list[float]):
    """matrix x (point - centre) + centre + offset."""
    centre = lambda i: (shape[i] - 1) / 2.0
    n = len(matrix)
    return lambda c: F.array(*(sum((F.lit(float(matrix[i][j])) * (c[j] - centre(j)) for j in range(n)), F.lit(0.0)) + centre(i) + F.lit(float(offset[i])) for i in range(n)))


def prune_targets(df: DataFrame, min_visibility: float = 0.0) -> DataFrame:
    """df without points outside 0 <= c < size; boxes cut to 0..size-1, kept if an area and the share min_visibility is left."""
    if not 0 <= min_visibility <= 1:
        raise ValueError("min_visibility must be from 0 to 1")
    inside = lambda k: F.forall(F.arrays_zip(k["coord"], F.col("shape")), lambda z: (z["coord"] >= 0) & (z["coord"] < z["shape"]))
    cut = lambda c: F.zip_with(c, F.col("shape"), lambda x, s: F.least(F.greatest(x, F.lit(0.0)), (s - 1).cast("double")))
    area = lambda lo, hi: F.aggregate(F.zip_with(lo, hi, lambda a, b: b - a), F.lit(1.0), lambda acc, x: acc * x)
    boxes = F.transform("bboxes", lambda b: F.struct(cut(b["lo"]).alias("lo"), cut(b["hi"]).alias("hi"), b["label"].alias("label"), area(b["lo"], b["hi"]).alias("whole")))
    boxes = F.filter(boxes, lambda b: (area(b["lo"], b["hi"]) > 0) & (area(b["lo"], b["hi"]) >= F.lit(float(min_visibility)) * b["whole"]))
    return df.withColumns({"keypoints": F.filter("keypoints", inside), "bboxes": F.transform(boxes, lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["label"].alias("label")))})


def statistics(image: Column) -> Column:
    """n, bad (not finite), low and high (NaN aside), mean and std (population) of an array of values."""
    image = F.transform(image, lambda x: x.cast("double"))
    known = F.filter(image, lambda x: ~F.isnan(x))
    mean = F.aggregate(image, F.lit(0.0), lambda a, x: a + x) / F.size(image)
    return F.struct(
        F.size(image).alias("n"),
        F.size(F.filter(image, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
        F.array_min(known).alias("low"),
        F.array_max(known).alias("high"),
        mean.alias("mean"),
        F.sqrt(F.aggregate(image, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.greatest(F.lit(0.0), a["q"] / F.size(image) - (a["s"] / F.size(image)) * (a["s"] / F.size(image))))).alias("std"),
    )


def issues(validator, image: str = "image", mask: str = "mask", reference: str | None = None, reference_mask: str | None = None) -> Column:
    """A validator's findings as array<struct<check, severity>>, for columns of images and masks and of their references."""
    s, m = statistics(F.col(image)), F.col(mask)
    labelled = lambda c: F.filter(c, lambda x: x != 0)
    share = lambda c: F.size(labelled(c)) / F.size(c)
    rules = []
    if validator.require_finite:
        rules.append(("finite", "error", s["bad"] > 0))
    if validator.forbid_constant:
        rules.append(("constant", "error", (s["n"] > 0) & (s["bad"] == 0) & (s["low"] == s["high"])))
    if validator.check_mask_shape:
        rules.append(("mask_shape", "error", m.isNotNull() & (F.size(m) != F.size(image))))
    if validator.intensity_bounds is not None:
        lo, hi = validator.intensity_bounds
        rules.append(("intensity_bounds", "error" if validator.strict_bounds else "warning", (s["low"] < lo) | (s["high"] > hi)))
    if validator.min_foreground_fraction is not None:
        rules.append(("min_foreground", "error", m.isNotNull() & (share(m) < validator.min_foreground_fraction)))
    if reference_mask is not None:
        r = F.col(reference_mask)
        if validator.preserve_mask_labels:
            rules.append(("mask_labels", "error", F.size(F.array_except(labelled(r), m)) > 0))
        if validator.max_foreground_loss is not None:
            rules.append(("foreground_loss", "error", (share(r) > 0) & (1 - share(m) / share(r) > validator.max_foreground_loss)))
    if reference is not None and validator.max_intensity_shift is not None:
        t = statistics(F.col(reference))
        rules.append(("intensity_shift", "warning", (s["bad"] == 0) & (t["bad"] == 0) & (t["std"] > 0) & (F.abs(s["mean"] - t["mean"]) > F.lit(float(validator.max_intensity_shift)) * t["std"])))
    found = (F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))) for check, severity, bad in rules)
    return F.filter(F.array(*found), lambda x: x.isNotNull())
