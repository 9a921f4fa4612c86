"""DICOM series as volumes: uncompressed files in explicit or implicit little-endian form.

Files are read where executors run (see files.map_files) and parsed to one row each; slices of a series are put in order
and stacked by Spark: grouping, sorting and spacing are DataFrame operations.
"""

from __future__ import annotations

import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.files import map_files

SLICES = "path string, series_uid string, study_uid string, patient_id string, modality string, vendor string, ipp array<double>, iop array<double>, slice_location double, instance_number double, pixel_spacing array<double>, thickness double, slope double, intercept double, window_center double, window_width double, frames int, rows int, columns int, pixels array<float>"
# Transfer syntaxes and tags of the standard.
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
TAGS = {
    (0x0008, 0x0060): "modality", (0x0008, 0x0070): "vendor", (0x0010, 0x0020): "patient_id", (0x0020, 0x000D): "study_uid", (0x0020, 0x000E): "series_uid", (0x0020, 0x0032): "ipp", (0x0020, 0x0037): "iop", (0x0020, 0x1041): "slice_location",
    (0x0020, 0x0013): "instance_number", (0x0028, 0x0030): "pixel_spacing", (0x0018, 0x0050): "thickness", (0x0028, 0x1053): "slope", (0x0028, 0x1052): "intercept", (0x0028, 0x1050): "window_center", (0x0028, 0x1051): "window_width", (0x0028, 0x0008): "frames", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns",
    (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed", (0x7FE0, 0x0010): "pixels", (0x0002, 0x0010): "syntax",
}
LONG = frozenset((b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"))
WHOLE = frozenset(("rows", "columns", "bits", "signed"))


def elements(data: bytes):
    """(name, value) of the known elements of the top level."""
    at = 132 if data[128:132] == b"DICM" else 0
    explicit, syntax = True, None
    if at == 0:
        explicit = data[4:6].isalpha() and data[4:6].isupper()
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if group != 2 and syntax is not None:
            if syntax not in (IMPLICIT, EXPLICIT):
                raise ValueError(f"DICOM transfer syntax {syntax} is not supported")
            explicit, syntax = syntax == EXPLICIT, None
        if group == 0xFFFE:
            at += 8
            continue
        if explicit or group == 2:
            kind = data[at + 4 : at + 6]
            size, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if kind in LONG else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
        else:
            size, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
        name = TAGS.get((group, element))
        if size == 0xFFFFFFFF:
            if name == "pixels":
                raise ValueError("compressed pixel data is not supported")
            at = _skip(data, at, explicit)
            continue
        value = data[at : at + size]
        at += size
        if name == "syntax":
            syntax = value.rstrip(b"\0 ").decode("ascii", "replace")
        elif name:
            yield name, value


def _skip(data: bytes, at: int, explicit: bool) -> int:
    """The end of a sequence of undefined length."""
    depth = 1
    while depth and at + 8 <= len(data):
        group, element, size = struct.unpack_from("<HHI", data, at)
        if (group, element) == (0xFFFE, 0xE0DD):
            depth, at = depth - 1, at + 8
        elif group == 0xFFFE:
            at += 8 if size == 0xFFFFFFFF or element == 0xE00D else 8 + size
        else:
            kind = data[at + 4 : at + 6]
            if explicit:
                size, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if kind in LONG else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
            else:
                at += 8
            if size == 0xFFFFFFFF:
                depth += 1
            else:
                at += size
    return at


def decode(path: str, content: bytes) -> dict:
    """A row of SLICES; ValueError for what is no readable image."""
    try:
        found = dict(elements(content))
        if "pixels" not in found:
            raise ValueError("no pixel data")
        text = lambda n: found[n].decode("latin-1").strip("\0 ") or None if n in found else None
        numbers = lambda n: [float(x) for x in text(n).split("\\")] if text(n) else None
        number = lambda n: numbers(n)[0] if text(n) else None
        whole = {n: struct.unpack("<H", found[n][:2])[0] if n in found else 0 for n in WHOLE}
        frames = int(number("frames") or 1)
        kind = np.dtype(("<i" if whole["signed"] else "<u") + str(max(8, whole["bits"]) // 8))
        pixels = np.frombuffer(found["pixels"], kind, frames * whole["rows"] * whole["columns"]).astype(np.float32)
    except (KeyError, struct.error, TypeError) as e:
        raise ValueError(f"not a DICOM image: {e}") from e
    return {
        "path": path, "series_uid": text("series_uid"), "study_uid": text("study_uid"), "patient_id": text("patient_id"), "modality": text("modality"), "vendor": text("vendor"), "ipp": numbers("ipp"), "iop": numbers("iop"),
        "slice_location": number("slice_location"), "instance_number": number("instance_number"), "pixel_spacing": numbers("pixel_spacing"), "thickness": number("thickness"), "slope": number("slope"), "intercept": number("intercept"), "window_center": number("window_center"), "window_width": number("window_width"),
        "frames": frames, "rows": whole["rows"], "columns": whole["columns"], "pixels": pixels,
    }


def wanted(name: Column) -> Column:
    """Names that may be DICOM: .dcm and .dicom, and those without a dot."""
    return ~name.startswith(".") & (F.lower(name).rlike(r"\.(dcm|dicom)$") | ~name.contains("."))


def load_slices(spark: SparkSession, path: str) -> DataFrame:
    """One row for each readable DICOM image under path. unreadable() has the other files."""

    def run(files):
        rows, values, size = [], [], 0
        for name, content in files:
            try:
                row = decode(name, content)
            except ValueError:
                continue
            pixels = row.pop("pixels")
            if rows and (len(rows) == ROWS or size + pixels.nbytes > BYTES):
                yield batch_of(rows, values)
                rows, values, size = [], [], 0
            rows.append(row)
            values.append(pixels)
            size += pixels.nbytes
        if rows:
            yield batch_of(rows, values)

    return map_files(spark, path, wanted, run, SLICES)


def batch_of(rows: list[dict], values: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of SLICES and their pixels."""
    own = pa.Table.from_pylist(rows, pa.schema([(f.split(" ")[0], KINDS[f.split(" ")[1]]) for f in SLICES.split(", ")[:-1]]))
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[0] if len(values) == 1 else np.concatenate(values)))
    return own.append_column("pixels", pixels).to_batches()[0]


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """path and fault of the files under path that load_slices() leaves out."""

    def faults(files):
        for name, content in files:
            try:
                decode(name, content)
            except ValueError as e:
                yield name, str(e)

    def run(files):
        found = faults(files)
        while part := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_pydict({"path": pa.array([n for n, _ in part], pa.string()), "fault": pa.array([f for _, f in part], pa.string())})

    return map_files(spark, path, wanted, run, "path string, fault string")


# Rows and bytes of pixels that go back to Spark at once; a larger image goes alone.
ROWS, BYTES = 1000, 1 << 24
KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def slice_position() -> Column:
    """Along the normal of the plane, else the slice location, else the instance number, else 0."""
    p, o = F.col("ipp"), F.col("iop")
    cross = [(1, 5, 2, 4), (2, 3, 0, 5), (0, 4, 1, 3)]
    normal = [F.get(o, F.lit(a)) * F.get(o, F.lit(b)) - F.get(o, F.lit(c)) * F.get(o, F.lit(d)) for a, b, c, d in cross]
    return F.coalesce(sum((F.get(p, F.lit(i)) * n for i, n in enumerate(normal)), F.lit(0.0)), F.col("slice_location"), F.col("instance_number"), F.lit(0.0))


def series_key() -> Column:
    """The series' UID; without one, the folder of the file."""
    return F.coalesce(F.nullif("series_uid", F.lit("")), F.concat(F.lit("folder:"), F.regexp_replace("path", "/[^/]*$", "")))


def faulty_series(slices: DataFrame) -> DataFrame:
    """key and fault of the series that stacked() leaves out."""
    sizes = slices.groupBy(series_key().alias("key")).agg(F.count_distinct("rows", "columns").alias("sizes"), F.count("*").alias("n"), F.max("frames").alias("frames"))
    fault = F.when(F.col("sizes") > 1, "slices of a series differ in size").when((F.col("n") > 1) & (F.col("frames") > 1), "several images with frames in one series")
    return sizes.withColumn("fault", fault).where("fault is not null").select("key", "fault")


def stacked(slices: DataFrame) -> DataFrame:
    """One volume for each series, as from load_slices(): slices in order, rescaled, with the spacing of their positions.

    Values are pixel x slope + intercept, with the first slice's where a slice has none. The distance of slices is the
    median of the differences of their positions, else the slice thickness, else 1. Files without a series UID are a
    series for each folder. Series whose slices cannot be stacked are left out: faulty_series() has them. The
    first slice's window is in columns of its own; to have WindowLevel use it, put it in the metadata. Pixels are shuffled once, to their series.
    """
    row = F.struct(slice_position().alias("position"), "path", "pixels", "slope", "intercept", "rows", "columns", "frames", "pixel_spacing", "thickness", "window_center", "window_width", "modality", "vendor", "patient_id", "study_uid", "series_uid")
    df = slices.groupBy(series_key().alias("key")).agg(F.sort_array(F.collect_list(row)).alias("s"))
    f = lambda c: F.col("s")[0][c]
    n = F.size("s")
    df = df.where(F.forall("s", lambda x: (x["rows"] == f("rows")) & (x["columns"] == f("columns")) & ((n == 1) | (x["frames"] == 1))))
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.col("s")[i]["position"] - F.col("s")[i - 1]["position"])))
    df = df.withColumn("gaps", F.when(n > 1, gaps))
    half = F.floor((n - 2) / 2).cast("int")
    step = F.when(n > 1, (F.get("gaps", half) + F.get("gaps", n - 2 - half)) / 2)
    many, frames = n > 1, f("frames")
    plane = [F.coalesce(f("pixel_spacing")[i], F.lit(1.0)) for i in (0, 1)]
    thick = F.coalesce(F.when(many & (step > 0), step), f("thickness"), F.lit(1.0))
    own = lambda x, c, otherwise: F.coalesce(x[c], f(c), F.lit(otherwise))
    values = F.transform("s", lambda x: F.transform(x["pixels"], lambda v: (v * own(x, "slope", 1.0) + own(x, "intercept", 0.0)).cast("float")))
    facts = {"source": F.lit("dicom"), "modality": f("modality"), "vendor": f("vendor"), "patient_id": f("patient_id"), "study_uid": f("study_uid"), "series_uid": f("series_uid"), "rescale_slope": f("slope").cast("string"), "rescale_intercept": f("intercept").cast("string"), "num_slices": F.when(many, n.cast("string"))}
    metadata = F.map_filter(F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return df.select(
        F.xxhash64("key").alias("volume_id"), F.when(many, F.array(n, f("rows"), f("columns"))).when(frames > 1, F.array(frames, f("rows"), f("columns"))).otherwise(F.array(f("rows"), f("columns"))).alias("shape"),
        F.flatten(values).alias("image"), F.when(many | (frames > 1), F.array(thick, *plane)).otherwise(F.array(*plane)).alias("spacing"), f("modality").alias("modality"), metadata.alias("metadata"), f("window_center").alias("window_center"), f("window_width").alias("window_width"),
    )


def load_dicom_series(spark: SparkSession, path: str) -> DataFrame:
    """The one volume under path; an error if there is no readable image, more than one series, or one that cannot be stacked."""
    slices = load_slices(spark, path)
    found = [r[0] for r in slices.select("series_uid").where("series_uid is not null").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("there is more than one series; use stacked(load_slices(...)) for all of them")
    if not found and not slices.limit(1).count():
        raise FileNotFoundError(f"no readable DICOM image under {path}")
    if fault := faulty_series(slices).first():
        raise ValueError(fault.fault)
    return stacked(slices)
