"""Spatial operators: image, mask, points and boxes move together; masks are resampled by the nearest voxel."""

from __future__ import annotations

import numpy as np

from lumenframe.functions import kernels
from lumenframe.plans.node import Plain, Span, Tuple, number, one_of, operator
from lumenframe.plans.sample import axis_of


def like(values: np.ndarray, image: np.ndarray) -> np.ndarray:
    """values in the image's type if that is a float type, else in single precision."""
    return values.astype(image.dtype if image.dtype.kind == "f" else np.float32, copy=False)


def check_size(name: str, size: tuple, ndim: int) -> None:
    if len(size) != ndim:
        raise ValueError(f"{name} has {len(size)} elements for {ndim} dimensions")


SIZE = Tuple(kind=int, least=1, scalar=False)
ORDER3, ORDER5 = Plain(lambda v: v in (0, 1, 2, 3), "0 to 3"), Plain(lambda v: v in (0, 1, 2, 3, 4, 5), "0 to 5")
MODE = one_of(*kernels.MODES)


@operator(axes=Tuple(kind=int, scalar=True), p_per_axis=number(0, most=1))
def RandomFlip(v, d, axes=("x",), p_per_axis=0.5):
    """Flips each of the axes with probability p_per_axis."""
    picked = sorted({axis_of(a, v.ndim) for a in (axes if isinstance(axes, tuple) else (axes,))})
    picked = [a for a in picked if d.unit(f"flip{a}") < p_per_axis]
    if not picked:
        return v
    size = np.array(v.shape)

    def move(points):
        out = points.astype(float)
        out[:, picked] = size[picked] - 1 - out[:, picked]
        return out

    return v.moved(move, image=np.flip(v.image, picked), mask=None if v.mask is None else np.flip(v.mask, picked))


@operator(rotation=Span(signed=True, list_form=True), scale=Span(list_form=True), translation=Span(signed=True, list_form=True), axes_enabled=Tuple(kind=str), order=ORDER5, mode=MODE)
def RandomAffine(v, d, rotation=0.0, scale=(1.0, 1.0), translation=0.0, axes_enabled=("x", "y", "z"), order=1, mode="constant", cval=0.0):
    """Rotation (degrees), scale and translation (share of the size) about the centre, drawn for each axis.

    The angle of label x turns the last two axes, that of y the first and last, that of z the first two. In two
    dimensions there is one angle, drawn if x or y is enabled.
    """
    n, forward = v.ndim, np.eye(v.ndim)
    if n == 3:
        for label, (a, b) in (("z", (0, 1)), ("y", (0, 2)), ("x", (1, 2))):
            angle = np.deg2rad(d.uniform(f"angle.{label}", rotation)) if label in axes_enabled else 0.0
            turn = np.eye(3)
            sign = -1.0 if (a, b) == (0, 2) else 1.0
            turn[a, a] = turn[b, b] = np.cos(angle)
            turn[a, b], turn[b, a] = -sign * np.sin(angle), sign * np.sin(angle)
            forward = forward @ turn
    elif "x" in axes_enabled or "y" in axes_enabled:
        angle = np.deg2rad(d.uniform("angle", rotation))
        forward = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    forward = forward @ np.diag([d.uniform(f"scale{a}", scale) for a in range(n)])
    shift = np.array([d.uniform(f"shift{a}", translation) * s for a, s in enumerate(v.shape)])
    centre, back = (np.array(v.shape) - 1) / 2, np.linalg.inv(forward)
    steps = [np.arange(s) - c - t for s, c, t in zip(v.shape, centre, shift)]
    mesh = np.meshgrid(*steps, indexing="ij", sparse=True)
    kind = v.values.dtype  # single precision is exact to a few millionths of a voxel here
    mesh = [m.astype(kind) for m in mesh]
    coords = [sum(kind.type(back[a, b]) * mesh[b] for b in range(n)) + kind.type(centre[a]) for a in range(n)]
    image = kernels.sample(v.values, coords, order, mode, cval)
    mask = None if v.mask is None else kernels.sample(v.mask, coords, 0, "constant", 0)
    return v.moved(lambda p: (p - centre) @ forward.T + centre + shift, image=like(image, v.image), mask=mask)


def cut(v, start, size):
    region = tuple(slice(a, a + s) for a, s in zip(start, size))
    return v.moved(lambda p: p - np.array(start, float), image=v.image[region], mask=None if v.mask is None else v.mask[region])


@operator(size=Tuple(kind=int), foreground_prob=number(0, most=1))
def AnatomicCrop(v, d, size, foreground_prob=0.5, foreground_threshold=0.0):
    """A random window, with probability foreground_prob around a random foreground voxel (mask, else values above the threshold)."""
    check_size("size", size, v.ndim)
    size = [min(s, n) for s, n in zip(size, v.shape)]
    low, high = [0] * v.ndim, [n - s for s, n in zip(size, v.shape)]
    inside = np.flatnonzero(v.mask > 0 if v.mask is not None else v.image > foreground_threshold)
    if len(inside) and d.unit("foreground") < foreground_prob:
        anchor = np.unravel_index(inside[d.integer("anchor", (0, len(inside) - 1))], v.shape)
        low = [max(0, int(a) - s + 1) for a, s in zip(anchor, size)]
        high = [min(h, int(a)) for a, h in zip(anchor, high)]
    return cut(v, [d.integer(f"origin{i}", (a, b)) if b > a else a for i, (a, b) in enumerate(zip(low, high))], size)


@operator(size=SIZE)
def CenterCrop(v, d, size):
    """The middle window; axes that are smaller stay whole."""
    check_size("size", size, v.ndim)
    size = [min(s, n) for s, n in zip(size, v.shape)]
    return cut(v, [(n - s) // 2 for s, n in zip(size, v.shape)], size)


@operator(size=SIZE)
def Pad(v, d, size, mode="constant", cval=0.0):
    """At least size, padded on both sides; masks are padded with 0."""
    check_size("size", size, v.ndim)
    widths = [((s - n) // 2, s - n - (s - n) // 2) if s > n else (0, 0) for s, n in zip(size, v.shape)]
    if not any(b for _, b in widths):
        return v
    image = np.pad(like(v.image, v.image), widths, mode=mode, **({"constant_values": cval} if mode == "constant" else {}))
    before = np.array([a for a, _ in widths], float)
    return v.moved(lambda p: p + before, image=image, mask=None if v.mask is None else np.pad(v.mask, widths))


@operator(size=SIZE, order=ORDER3)
def Resize(v, d, size, order=1):
    """Resampled to size with the corner voxels kept in place; points are multiplied by the ratio of the sizes."""
    check_size("size", size, v.ndim)
    if tuple(size) == v.shape:
        return v
    ratio = np.array(size) / np.array(v.shape)
    image = kernels.zoom(v.values, size, order, "reflect")
    mask = None if v.mask is None else kernels.zoom(v.mask, size, 0, "nearest")
    return v.moved(lambda p: p * ratio, image=like(image, v.image), mask=mask, spacing=tuple(float(s / r) for s, r in zip(v.spacing, ratio)))


def displaced(v, d, alpha, sigma, order, mode, cval):
    n = v.ndim
    alpha, sigma = (x if isinstance(x, tuple) else (x,) * n for x in (alpha, sigma))
    if len(alpha) != n or len(sigma) != n:
        raise ValueError(f"alpha and sigma need one value, or one for each of {n} dimensions")
    kind = v.values.dtype
    noise = lambda a: (2 * d.field(f"field{a}", v.shape) - 1).astype(kind, copy=False)
    fields = [kernels.gaussian(noise(a), sigma[a]) * kind.type(alpha[a]) for a in range(n)]
    coords = [g + f for g, f in zip(kernels.grid(v.shape, kind, True), fields)]
    image = kernels.sample(v.values, coords, order, mode, cval)
    mask = None if v.mask is None else kernels.sample(v.mask, coords, 0, "constant", 0)

    def move(points):
        at = list(points.T)
        return points - np.stack([kernels.sample(f, at, 1, mode) for f in fields], 1)

    return v.moved(move, image=like(image, v.image), mask=mask)


@operator(alpha=Tuple(scalar=True), sigma=Tuple(scalar=True), order=ORDER3, mode=MODE)
def ElasticDeform(v, d, alpha=30.0, sigma=4.0, order=1, mode="reflect", cval=0.0):
    """A smooth random displacement: for each axis, noise smoothed by its sigma and scaled by its alpha."""
    return displaced(v, d, alpha, sigma, order, mode, cval)


@operator(num_holes=Span(least=0, whole=True), hole_size=Span(least=0, above=True, most=1))
def CoarseDropout(v, d, num_holes=(1, 4), hole_size=(0.05, 0.2), fill_value=0.0, fill_mask=False):
    """Random boxes set to a value; sizes are shares of each axis."""
    n = d.integer("holes", num_holes)
    if not n:
        return v
    image, mask = v.image.copy(), v.mask.copy() if v.mask is not None and fill_mask else v.mask
    for k in range(n):
        region = []
        for a, dim in enumerate(v.shape):
            size = min(dim, max(1, round(d.uniform(f"size{k}.{a}", hole_size) * dim)))
            at = d.integer(f"origin{k}.{a}", (0, dim - size))
            region.append(slice(at, at + size))
        image[tuple(region)] = fill_value
        if mask is not None and fill_mask:
            mask[tuple(region)] = 0
    return v.having(image=image, mask=mask)
