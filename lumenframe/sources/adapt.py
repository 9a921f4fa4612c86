"""Plans on tables and samples of other layouts: column names, channels, in-memory pairs and mappings."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.draws import Draws
from lumenframe.plans.apply import augment
from lumenframe.plans.node import Transform
from lumenframe.plans.sample import Sample

LABEL_NAME = re.compile(r"label|mask|seg", re.I)


def channel_axis(shape, channel: str | int | None) -> int | None:
    """The axis of one element that is a channel: named, or the first or last of four (auto); None if there is none."""
    if channel is None:
        return None
    n = len(shape)
    if channel == "auto":
        if n == 4 or n == 3 and 1 in (shape[0], shape[-1]):
            return 0 if shape[0] == 1 else n - 1 if shape[-1] == 1 else None
        return None
    at = 0 if channel == "first" else n - 1 if channel == "last" else int(channel) % n
    if shape[at] != 1:
        raise ValueError("only one channel is supported")
    return at


def without_axis(shape: Column, channel: str | int | None) -> Column:
    """The shape column without the channel's axis."""
    if channel is None:
        return shape
    n = F.size(shape)
    first, last = F.element_at(shape, 1), F.element_at(shape, -1)
    at = {
        "first": F.lit(0), "last": n - 1, "auto": F.when((n == 4) | (n == 3) & ((first == 1) | (last == 1)), F.when(first == 1, 0).when(last == 1, n - 1)),
    }.get(channel, F.pmod(F.lit(0 if isinstance(channel, str) else channel), n))
    bad = F.raise_error(F.lit("only one channel is supported")).cast("array<int>")
    return F.when(at.isNull(), shape).when(F.get(shape, at) != 1, bad).otherwise(F.filter(shape, lambda s, i: i != at))


def image_columns(df: DataFrame, *used: str | None) -> tuple[str, str | None]:
    """The one array column that is not named like a label, and one that is, if any."""
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("array<float>", "array<double>", "array<int>", "array<smallint>", "array<bigint>") and f.name not in ("shape", "spacing", "affine", *used)]
    plain, labels = [c for c in arrays if not LABEL_NAME.search(c)], [c for c in arrays if LABEL_NAME.search(c)]
    if len(plain) != 1 or len(labels) > 1:
        raise KeyError(f"name the image column and the mask column: candidates are {plain} and {labels}")
    return plain[0], labels[0] if labels else None


def augment_columns(df: DataFrame, plan: Transform, image: str | None = None, mask: str | None = None, shape: str = "shape", volume_id: str = "volume_id", spacing: str | None = None, metadata: str | None = None, channel: str | int | None = None, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """augment() where the columns have other names; all columns keep their names, order and, masks included, types."""
    if image is None:
        image, found = image_columns(df, shape, spacing)
        mask = mask or found
    if image not in df.columns:
        raise KeyError(f"there is no column {image!r}")
    names = {"volume_id": volume_id, "shape": shape, "image": image, "mask": mask, "spacing": spacing, "metadata": metadata}
    names = {k: c for k, c in names.items() if c}
    if metadata and not df.schema[metadata].dataType.simpleString().startswith("map<"):
        raise TypeError("metadata must be a map")
    kept = F.struct(*(F.col(c) for c in df.columns if c not in (image, mask, shape, spacing)) or (F.lit(0),)).alias("_kept")
    inner = df.select(*(F.col(c).alias(k) for k, c in names.items() if k not in ("shape", "mask")), without_axis(F.col(shape), channel).alias("shape"), F.col(shape).alias("_full"), *([F.col(mask).cast("array<int>").alias("mask")] if mask else []), kept)
    out = augment(inner, plan, seed, epoch)
    # the channel's axis goes back to where it was
    back = F.when(F.size("_full") > F.size("shape"), F.when(F.lit(channel == "last") | (F.lit(channel == "auto") & (F.element_at("_full", 1) != 1)), F.concat("shape", F.array(F.lit(1)))).otherwise(F.concat(F.array(F.lit(1)), "shape"))).otherwise(F.col("shape"))
    made = {image: F.col("image"), shape: back} | ({mask: F.col("mask").cast(df.schema[mask].dataType)} if mask else {}) | ({spacing: F.col("spacing")} if spacing else {})
    return out.select(*(made[c].alias(c) if c in made else F.col("_kept")[c].alias(c) for c in df.columns))


def monai_columns(df: DataFrame, plan: Transform, **settings) -> DataFrame:
    """augment_columns() with the column names image and label."""
    return augment_columns(df, plan, "image", "label" if "label" in df.columns else None, **settings)


class SampleTransform:
    """A plan on single samples in memory: an array, a pair (image, mask), or a mapping with keys for them."""

    def __init__(self, plan: Transform, image_key: str = "image", mask_key: str = "mask", spacing_key: str = "spacing", metadata_key: str = "metadata", channel: str | int | None = None, restore_image_dtype: bool = False, restore_mask_dtype: bool = True, seed: int | None = None):
        self.plan, self.keys, self.channel = plan, (image_key, mask_key, spacing_key, metadata_key), channel
        self.restore, self.seed, self.calls = (restore_image_dtype, restore_mask_dtype), seed, 0

    def _run(self, image, mask, spacing=(), metadata=None):
        to_array = lambda x: np.asarray(x.detach().cpu().numpy() if hasattr(x, "detach") else x)
        image, mask = to_array(image), None if mask is None else to_array(mask)
        at = channel_axis(image.shape, self.channel)
        strip = lambda x: x if x is None or at is None or x.ndim != image.ndim else np.squeeze(x, at)
        plain, labels = strip(image), strip(mask)
        if plain.ndim not in (2, 3):
            raise ValueError(f"a volume has 2 or 3 dimensions, not {plain.ndim}")
        self.calls += 1
        out = self.plan(Sample(plain, labels, tuple(spacing) or (1.0,) * plain.ndim, dict(metadata or {})), Draws(self.seed if self.seed is not None else self.plan.seed or 0, "0", self.calls))
        put = lambda x, like: x if at is None or like.ndim == x.ndim else np.expand_dims(x, at)
        result = put(out.image, image)
        labels = None if out.mask is None else put(out.mask, mask)
        return result.astype(image.dtype) if self.restore[0] else result, None if labels is None else labels.astype(mask.dtype) if self.restore[1] else labels, out

    def __call__(self, sample):
        image_key, mask_key, spacing_key, metadata_key = self.keys
        if isinstance(sample, Mapping):
            if image_key not in sample:
                raise KeyError(f"the sample has no {image_key!r}")
            metadata = sample.get(metadata_key)
            if metadata is not None and not isinstance(metadata, Mapping):
                raise TypeError("metadata must be a mapping")
            image, mask, out = self._run(sample[image_key], sample.get(mask_key), sample.get(spacing_key, ()), metadata)
            return {**sample, image_key: image, **({mask_key: mask} if mask is not None else {}), **({spacing_key: out.spacing} if spacing_key in sample else {})}
        if isinstance(sample, (tuple, list)) and not isinstance(sample, np.ndarray):
            if len(sample) != 2:
                raise ValueError("a sequence has to be a pair of image and mask")
            return type(sample)(self._run(*sample)[:2])
        return self._run(sample, None)[0]


TorchTransform = SampleTransform


class MonaiMapTransform(SampleTransform):
    def __init__(self, plan: Transform, keys: tuple[str, str] = ("image", "label"), **settings):
        super().__init__(plan, keys[0], keys[1], **settings)


class TorchIOTransform:
    """A plan on subjects: mappings of objects with data (a tensor or array with a channel) and set_data().

    The image is the one entry not named like a label, the mask the one that is, unless they are named.
    """

    def __init__(self, plan: Transform, image_key: str | None = None, mask_key: str | None = None, copy: bool = True, seed: int | None = None):
        self.plan, self.image_key, self.mask_key, self.copy, self.seed = plan, image_key, mask_key, copy, seed
        self.inner = SampleTransform(plan, channel="first", seed=seed)

    def __call__(self, subject):
        import copy as copying

        entries = {k: v for k, v in subject.items() if hasattr(v, "data") and hasattr(v, "set_data")}
        plain = [k for k in entries if not LABEL_NAME.search(k)]
        labels = [k for k in entries if LABEL_NAME.search(k)]
        image_key = self.image_key or (plain[0] if len(plain) == 1 else None)
        if image_key is None or image_key not in entries:
            raise KeyError("name the image: the subject has no single entry for it")
        mask_key = self.mask_key or (labels[0] if len(labels) == 1 else None)
        out = copying.deepcopy(subject) if self.copy else subject
        source = out[image_key]
        metadata = {k: getattr(source, k) for k in ("affine",) if hasattr(source, k)}
        image, mask, _ = self.inner._run(source.data, out[mask_key].data if mask_key else None, getattr(source, "spacing", ()), metadata)
        source.set_data(image)
        if mask_key:
            out[mask_key].set_data(mask)
        return out
