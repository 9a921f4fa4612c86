"""Intensity operators: masks and targets stay as they are."""

from __future__ import annotations

import math

import numpy as np

from lumenframe.functions import kernels
from lumenframe.operators.spatial import MODE, ORDER3, like
from lumenframe.plans.node import PAIR_OR_NONE, OddSpan, Span, Tuple, number, operator


def limited(values, clip):
    return values if clip is None else np.clip(values, *clip)


@operator(std=Span(least=0), clip=PAIR_OR_NONE)
def GaussianNoise(v, d, std=0.01, relative=False, clip=None):
    """Adds normal noise; relative: its deviation is a share of the image's."""
    scale = d.uniform("std", std) * (v.values.std() + 1e-8 if relative else 1.0)
    noise = d.normal("noise", v.shape)
    noise *= scale
    noise += v.image
    return v.having(image=like(limited(noise, clip), v.image))


@operator(std=Span(least=0), clip=PAIR_OR_NONE)
def RicianNoise(v, d, std=0.01, clip=None):
    """The magnitude of the image as a complex signal with normal noise in both parts."""
    scale = d.uniform("std", std)
    values = np.hypot(v.values + scale * d.normal("real", v.shape), scale * d.normal("imaginary", v.shape))
    return v.having(image=like(limited(values, clip), v.image))


@operator(gamma=Span(least=0, above=True, scalar_free=True))
def GammaCorrection(v, d, gamma=(0.8, 1.2), invert=False):
    """A power of the values between their extremes; invert: of their distances from the maximum."""
    values, g = v.values, d.uniform("gamma", gamma)
    low, high = values.min(), values.max()
    if high - low < 1e-12:
        return v
    x = (values - low) / (high - low)
    x = 1 - (1 - x) ** g if invert else x**g
    return v.having(image=like(x * (high - low) + low, v.image))


@operator(alpha=number(0), coarse_shape=Tuple(kind=int, scalar=True), order=ORDER3)
def BiasField(v, d, alpha=0.3, coarse_shape=4, order=3):
    """Multiplies by the exponential of a smooth field, a coarse random grid resampled by splines."""
    coarse = coarse_shape if isinstance(coarse_shape, tuple) else (coarse_shape,) * v.ndim
    if len(coarse) != v.ndim:
        raise ValueError(f"coarse_shape has {len(coarse)} elements for {v.ndim} dimensions")
    if alpha == 0:
        return v
    field = alpha * (2 * d.field("coarse", coarse) - 1)
    return v.having(image=like(v.values * np.exp(kernels.zoom(field, v.shape, order, "nearest")), v.image))


@operator(center_shift_frac=Span(signed=True), width_scale=Span(least=0, above=True))
def WindowLevel(v, d, center_shift_frac=0.1, width_scale=(0.8, 1.2), rescale_output=True):
    """Cuts to a varied window, from the metadata's window_center and window_width or the extremes; rescales to 0..1."""
    values = v.values
    if "window_center" in v.metadata and "window_width" in v.metadata:
        centre, width = float(v.metadata["window_center"]), float(v.metadata["window_width"])
    else:
        low, high = values.min(), values.max()
        centre, width = (low + high) / 2, max(high - low, 1e-8)
    centre += d.uniform("shift", center_shift_frac) * width
    width = max(width * d.uniform("width", width_scale), 1e-8)
    out = np.clip(values, centre - width / 2, centre + width / 2)
    return v.having(image=like((out - (centre - width / 2)) / width if rescale_output else out, v.image))


@operator(brightness=Span(signed=True, list_form=True), contrast=Span(least=0, above=True, list_form=True), clip=PAIR_OR_NONE)
def BrightnessContrast(v, d, brightness=0.0, contrast=(0.9, 1.1), clip=None):
    """Times the contrast plus the brightness."""
    b, c = d.uniform("brightness", brightness), d.uniform("contrast", contrast)
    return v.having(image=like(limited(v.values * c + b, clip), v.image))


@operator(sigma=Span(least=0), order=ORDER3, mode=MODE)
def GaussianBlur(v, d, sigma=(0.5, 1.5), order=0, mode="reflect"):
    """A Gaussian filter, or its derivative of an order, along all axes."""
    s = d.uniform("sigma", sigma)
    return v if s == 0 else v.having(image=like(kernels.gaussian(v.values, s, order, mode), v.image))


@operator(zoom_range=Span(least=0, above=True, most=1), order_down=ORDER3, order_up=ORDER3)
def SimulateLowResolution(v, d, zoom_range=(0.5, 0.9), order_down=1, order_up=1, per_axis=False):
    """Resampled down and up again."""
    factors = [d.uniform(f"zoom{a}", zoom_range) for a in range(v.ndim)] if per_axis else [d.uniform("zoom", zoom_range)] * v.ndim
    small = kernels.zoom(v.values, tuple(max(1, n) for n in kernels.zoomed_size(v.shape, factors)), order_down, "reflect")
    return v.having(image=like(kernels.zoom(small, v.shape, order_up, "reflect"), v.image))


@operator(ksize=OddSpan(least=1, whole=True), mode=MODE)
def MedianBlur(v, d, ksize=3, mode="reflect"):
    """The median of each voxel's cube of an odd size, drawn from the odd numbers of the range."""
    k = ksize[0] + 2 * d.integer("size", (0, (ksize[1] - ksize[0]) // 2))
    return v if k <= 1 else v.having(image=like(kernels.median(v.values, k, mode), v.image))


@operator(alpha=Span(least=0), sigma=Span(least=0, above=True), clip=PAIR_OR_NONE)
def Sharpen(v, d, alpha=(0.2, 0.8), sigma=(0.7, 1.5), clip=None):
    """Adds a share of the difference from the blurred image."""
    a, s, values = d.uniform("alpha", alpha), d.uniform("sigma", sigma), v.values
    return v if a == 0 else v.having(image=like(limited(values + a * (values - kernels.gaussian(values, s)), clip), v.image))


def equalised(plane: np.ndarray, bins: int, rows: int, columns: int, limit: float) -> np.ndarray:
    """Contrast-limited adaptive equalisation of a plane of values 0..1, by tile histograms blended between tile centres."""
    h, w = plane.shape
    th, tw = math.ceil(h / rows), math.ceil(w / columns)
    level = np.rint(np.pad(plane, ((0, th * rows - h), (0, tw * columns - w)), mode="edge") * (bins - 1)).astype(np.int64).clip(0, bins - 1)
    most = max(1, int(limit * th * tw / bins))
    tile = (np.arange(th * rows) // th)[:, None] * columns + np.arange(tw * columns) // tw
    counts = np.bincount((tile * bins + level).ravel(), minlength=rows * columns * bins).reshape(-1, bins).astype(float)
    over = np.maximum(counts - most, 0).sum(1, keepdims=True)
    shares = np.cumsum(np.minimum(counts, most) + over / bins, 1)
    shares /= shares[:, -1:]

    def between(size, n, length):
        at = ((np.arange(length) - (size / 2 - 0.5)) / size).clip(0, n - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), at - low

    top, bottom, fy = between(th, rows, h)
    left, right, fx = between(tw, columns, w)
    level = level[:h, :w]
    out = np.zeros((h, w))
    for ty, wy in ((top, 1 - fy), (bottom, fy)):
        for tx, wx in ((left, 1 - fx), (right, fx)):
            out += wy[:, None] * wx * shares[ty[:, None] * columns + tx, level]
    return out


@operator(clip_limit=Span(least=0, above=True), grid=Tuple(kind=int, least=1, size=2), n_bins=number(2))
def CLAHEContrast(v, d, clip_limit=(1.0, 3.0), grid=(8, 8), n_bins=256):
    """Contrast-limited adaptive histogram equalisation of each plane, between the volume's extremes."""
    values = v.values
    low, high = values.min(), values.max()
    if high - low < 1e-12:
        return v
    limit = d.uniform("clip_limit", clip_limit)
    planes = ((values - low) / (high - low)).reshape(-1, *v.shape[-2:])
    out = np.stack([equalised(x, n_bins, *grid, limit) for x in planes]).reshape(v.shape)
    return v.having(image=like(out * (high - low) + low, v.image))


def by_share(values: np.ndarray, look_up) -> np.ndarray:
    """look_up(share of values that are at most as great), for each value; look_up gets ascending shares.

    Single-precision values are sorted as whole numbers with their places in the low bits.
    """
    n = len(values)
    if values.dtype == np.float32 and n < 1 << 32:
        bits = (values + np.float32(0)).view(np.uint32)  # -0 counts as 0
        keys = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)
        keys |= np.arange(n, dtype=np.uint64)
        keys.sort()
        order, ordered = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), keys >> np.uint64(32)
    else:
        order = np.argsort(values)
        ordered = values[order]
    ends = np.flatnonzero(np.r_[ordered[1:] != ordered[:-1], True]) + 1 if n else np.zeros(0, np.int64)
    out = np.empty(n, values.dtype)
    out[order] = np.repeat(look_up(ends / max(1, n)), np.diff(np.r_[0, ends]))
    return out


@operator(blend=Span(least=0, most=1), n_quantiles=number(2))
def HistogramMatch(v, d, reference=None, blend=1.0, n_quantiles=256):
    """Each value's place in the distribution, looked up in the reference's quantiles, and mixed in by the share blend."""
    if reference is None:
        return v
    at = np.linspace(0, 1, n_quantiles)
    found = np.quantile(np.asarray(reference, float).ravel(), at)
    values = v.values
    matched = by_share(values.ravel(), lambda share: np.interp(share, at, found))
    share = d.uniform("blend", blend)
    return v.having(image=like((1 - share) * values + share * matched.reshape(v.shape), v.image))
