"""Array kernels on NumPy: interpolation by B-splines, Gaussian and median filters, with the usual edge rules.

Edges: reflect (d c b a | a b c d | d c b a), mirror (d c b | a b c d | c b a), nearest, wrap and constant.
"""

from __future__ import annotations

import math

import numpy as np

MODES = ("reflect", "constant", "nearest", "mirror", "wrap")


def fold(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Whole positions outside 0..n-1, brought inside; constant folds as mirror."""
    if n == 1:
        return np.zeros_like(i)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return i % n
    if mode == "reflect":
        i = i % (2 * n)
        return np.where(i >= n, 2 * n - 1 - i, i)
    i = i % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def bring(c: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Real coordinates brought to the array's range."""
    if mode == "nearest":
        return np.clip(c, 0, n - 1)
    if n == 1 or mode == "constant":
        return c if mode == "constant" else np.zeros_like(c)
    if mode == "reflect":
        c = np.mod(c + 0.5, 2 * n)
        return np.where(c > n, 2 * n - c, c) - 0.5
    if mode == "mirror":
        c = np.mod(c, 2 * (n - 1))
        return np.where(c > n - 1, 2 * (n - 1) - c, c)
    return np.where((c < 0) | (c > n - 1), np.mod(c, n - 1), c)  # the ends count as one voxel


# Poles of the interpolating B-splines of order 2 to 5.
POLES = {
    2: (math.sqrt(8) - 3,),
    3: (math.sqrt(3) - 2,),
    4: (math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19),
    5: (math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5),
}


def basis(order: int, x: np.ndarray) -> np.ndarray:
    """The centred B-spline of an order, by the recursion of its truncated powers."""
    out = np.zeros_like(x)
    for k in range(order + 2):
        out += (-1) ** k * math.comb(order + 1, k) * np.maximum(x + (order + 1) / 2 - k, 0) ** order
    return out / math.factorial(order)


def coefficients(a: np.ndarray, order: int, mode: str) -> np.ndarray:
    """Spline coefficients whose spline passes through a: the banded system of each axis, solved for all lines."""
    out = np.asarray(a, np.float64)
    if order < 2:
        return out
    rule = "reflect" if mode == "reflect" else "mirror"
    taps = np.arange(-(order // 2), order // 2 + 1)
    weight = basis(order, taps.astype(float))
    for axis, n in enumerate(out.shape):
        if n == 1:
            continue
        system = np.zeros((n, n))
        rows = np.arange(n)
        for t, w in zip(taps, weight):
            np.add.at(system, (rows, fold(rows + t, n, rule)), w)
        moved = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.linalg.solve(system, moved.reshape(n, -1)).reshape(moved.shape), 0, axis)
    return out


SLAB = 1 << 15  # coordinates at a time, so that what is made of them stays in the cache


def sample(a: np.ndarray, coords: list[np.ndarray], order: int = 1, mode: str = "constant", cval: float = 0.0) -> np.ndarray:
    """Values of the spline through a at coords, one array of coordinates for each axis. Single-precision arrays give such values in linear order."""
    pad = 12 if order > 1 and mode == "nearest" else 0
    source = coefficients(np.pad(a, pad, mode="edge") if pad else a, order, mode) if order > 1 else a
    flat = np.ascontiguousarray(source).reshape(-1)
    if order == 1 and flat.dtype.kind != "f":
        flat = flat.astype(np.float64)
    shape, coords = coords[0].shape, [c.reshape(-1) for c in coords]
    single = order == 1 and flat.dtype == np.float32
    out = np.empty(len(coords[0]), flat.dtype if order == 0 or single else np.float64)
    for at in range(0, len(out), SLAB):
        part = [c[at : at + SLAB] for c in coords]
        out[at : at + SLAB] = _linear(flat, a.shape, part, mode, cval) if order == 1 else _nearest(flat, a.shape, part, mode, cval) if order == 0 else _sample(flat, source.shape, a.shape, part, order, mode, cval, pad)
    return out.reshape(shape)


def _taps(c: np.ndarray, n: int, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two voxels around each coordinate, and the weight of the second. Brought coordinates leave an edge by less than a voxel."""
    if mode != "constant" and (c.min() < 0 or c.max() > n - 1):
        c = bring(c, n, mode)
    low = np.floor(c)
    first = low.astype(np.int64)
    return np.clip(first, 0, n - 1), np.clip(first + 1, 0, n - 1), c - low


def _inside(coords: list[np.ndarray], shape: tuple) -> np.ndarray | None:
    """Which coordinates are within the array, None for all."""
    out = None
    for c, n in zip(coords, shape):
        if c.min() < 0 or c.max() > n - 1:
            ok = (c >= 0) & (c <= n - 1)
            out = ok if out is None else out & ok
    return out


def _nearest(flat: np.ndarray, shape: tuple, coords: list[np.ndarray], mode: str, cval: float) -> np.ndarray:
    inside = _inside(coords, shape) if mode == "constant" else None
    at = 0
    for c, n in zip(coords, shape):
        if mode != "constant" and (c.min() < 0 or c.max() > n - 1):
            c = bring(c, n, mode)
        i = (c + c.dtype.type(0.5)).astype(np.int64)  # cuts toward 0: below 0 only where it is clipped
        at = at * n + np.clip(i, 0, n - 1)
    return flat[at] if inside is None else np.where(inside, flat[at], np.asarray(cval, flat.dtype))


def _linear(flat: np.ndarray, shape: tuple, coords: list[np.ndarray], mode: str, cval: float) -> np.ndarray:
    inside = _inside(coords, shape) if mode == "constant" else None
    taps = [_taps(c, n, mode) for c, n in zip(coords, shape)]
    rows = [0]  # the first voxel of each line along the last axis
    for (first, second, _), n in zip(taps[:-1], shape[1:]):
        rows = [(at + x) * n for at in rows for x in (first, second)]
    left, right, weight = taps[-1]
    weight = weight.astype(flat.dtype, copy=False)
    lines = []
    for at in rows:
        a = flat[at + left]
        lines.append(a + weight * (flat[at + right] - a))
    for _, _, weight in taps[-2::-1]:
        weight = weight.astype(flat.dtype, copy=False)
        lines = [a + weight * (b - a) for a, b in zip(lines[::2], lines[1::2])]
    return lines[0] if inside is None else np.where(inside, lines[0], np.asarray(cval, lines[0].dtype))


def _sample(flat: np.ndarray, size: tuple, shape: tuple, coords: list[np.ndarray], order: int, mode: str, cval: float, pad: int) -> np.ndarray:
    inside = np.ones(coords[0].shape, bool)
    if mode == "constant":
        for c, n in zip(coords, shape):
            inside &= (c >= 0) & (c <= n - 1)
    if pad:
        coords = [bring(c, n, mode) + pad for c, n in zip(coords, shape)]
    parts, step = [], len(flat)
    for c, n in zip(coords, size):
        step //= n
        c = c if pad else bring(c, n, mode)
        first = np.floor(c + 0.5 if order % 2 == 0 else c).astype(np.int64)
        taps = []
        for k in range(-(order // 2), order // 2 + 1 + order % 2):
            at = first + k
            taps.append((fold(at, n, "mirror" if mode == "wrap" else mode) * step, basis(order, c - at)))
        parts.append(taps)

    def total(axis, at, weight):
        """The sum over the taps of the axes from axis on, for the position and weight of the axes before."""
        if axis == len(parts):
            return flat[at] if weight is None else weight * flat[at]
        out = 0
        for i, w in parts[axis]:
            out = out + total(axis + 1, i if at is None else at + i, w if weight is None else weight * w)
        return out

    out = total(0, None, None)
    return np.where(inside, out, cval) if mode == "constant" else out


def sample_planes(planes: np.ndarray, coords: list[np.ndarray], mode: str) -> np.ndarray:
    """Linear sample() of each plane at the same coordinates."""
    (h, w), flat = planes.shape[1:], planes.reshape(len(planes), -1)
    top, bottom, fy = (x.ravel() for x in _taps(coords[0], h, mode))
    left, right, fx = (x.ravel() for x in _taps(coords[1], w, mode))
    fy, fx = fy.astype(planes.dtype), fx.astype(planes.dtype)
    corners = [top * w + left, top * w + right, bottom * w + left, bottom * w + right]
    out = np.empty((len(planes), top.size), planes.dtype)
    for z, plane in enumerate(flat):
        a, b, c, e = (plane[at] for at in corners)
        a += fx * (b - a)
        c += fx * (e - c)
        out[z] = a + fy * (c - a)
    return out.reshape(len(planes), *coords[0].shape)


def along(a: np.ndarray, axis: int, coords: np.ndarray, order: int, mode: str, cval: float = 0.0) -> np.ndarray:
    """sample() where only one axis is resampled, at the same coordinates for all lines."""
    n = a.shape[axis]
    gone = (coords < 0) | (coords > n - 1) if mode == "constant" else np.zeros(len(coords), bool)
    if order <= 1:
        if order:
            first, second, weight = _taps(np.asarray(coords, np.float64), n, mode)
        else:
            c = coords if mode == "constant" else bring(np.asarray(coords, np.float64), n, mode)
            first = np.clip(np.floor(c + 0.5).astype(np.int64), 0, n - 1)
        picked = np.take(a, first, axis)
        if order and weight.any():
            weight = weight.astype(a.dtype if a.dtype.kind == "f" else np.float64).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
            step = np.take(a, second, axis) - picked
            step *= weight
            picked = picked + step
    else:
        table, unit = np.zeros((len(coords), n)), np.eye(n)
        for j in range(n):
            table[:, j] = sample(unit[j], [coords], order, mode, 0.0)
        picked = np.moveaxis(np.tensordot(table, a, (1, axis)), 0, axis)
    if gone.any():
        picked = picked.copy()
        np.moveaxis(picked, axis, 0)[gone] = cval
    return picked


def zoom(a: np.ndarray, size: tuple[int, ...], order: int, mode: str) -> np.ndarray:
    """a resampled to size with the corners kept in place, axis by axis."""
    out = a
    for axis, (s, t) in enumerate(zip(a.shape, size)):
        coords = np.arange(t) * ((s - 1) / (t - 1)) if t > 1 else np.zeros(t)
        out = along(out, axis, np.minimum(coords, s - 1), order, mode)
    return out


def zoomed_size(shape: tuple[int, ...], factors) -> tuple[int, ...]:
    return tuple(int(round(s * f)) for s, f in zip(shape, factors))


def fitted(a: np.ndarray, shape: tuple[int, ...], fill: float | None = None) -> np.ndarray:
    """a cut, and padded at the ends, to shape: by fill, or by its edge."""
    a = a[tuple(slice(0, t) for t in shape)]
    pad = [(0, t - s) for s, t in zip(a.shape, shape)]
    if not any(k for _, k in pad):
        return a
    return np.pad(a, pad, mode="edge") if fill is None else np.pad(a, pad, constant_values=fill)


def gaussian_weights(sigma: float, derivative: int = 0) -> np.ndarray:
    """Taps of a sampled Gaussian, or of its derivative, out to 4 sigma."""
    radius = int(4 * sigma + 0.5)
    x = np.arange(-radius, radius + 1, dtype=float)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if derivative:
        polynomial = np.polynomial.Polynomial([1.0])
        for _ in range(derivative):
            polynomial = polynomial.deriv() - polynomial * np.polynomial.Polynomial([0, 1 / sigma**2])
        g = g * polynomial(x)
    return g[::-1]  # correlated, so that it convolves


def filtered(a: np.ndarray, weights: np.ndarray, axis: int, mode: str = "reflect") -> np.ndarray:
    """Correlation along one axis. Wide filters use a table of each output's weights by input."""
    n, radius = a.shape[axis], len(weights) // 2
    moved = np.moveaxis(a, axis, 0)
    if 24 * len(weights) > n or n <= 64:  # products of matrices are fast
        table = np.zeros((n, n))
        rows = np.arange(n)
        for k, w in zip(range(-radius, radius + 1), weights):
            at = rows + k
            ok = (at >= 0) & (at < n) if mode == "constant" else slice(None)
            np.add.at(table, (rows[ok], fold(at, n, mode)[ok]), w)
        table = table.astype(a.dtype) if a.dtype == np.float32 else table
        if axis == a.ndim - 1:
            return a @ table.T
        lead = int(np.prod(a.shape[:axis]))  # products that leave the result in row-major order
        return np.matmul(table, a.reshape(lead, n, -1)).reshape(a.shape)
    pad = [(radius, radius)] + [(0, 0)] * (a.ndim - 1)
    names = {"reflect": "symmetric", "mirror": "reflect", "nearest": "edge", "wrap": "wrap", "constant": "constant"}
    wide = np.pad(moved, pad, mode=names[mode])
    out = np.zeros(moved.shape, np.result_type(a.dtype, np.float32))
    for k, w in enumerate(weights.tolist()):
        out += w * wide[k : k + n]
    return np.moveaxis(out, 0, axis)


def gaussian(a: np.ndarray, sigma: float, derivative: int = 0, mode: str = "reflect") -> np.ndarray:
    out = a if a.dtype == np.float32 else np.asarray(a, np.float64)
    if sigma <= 0:
        return out
    weights = gaussian_weights(sigma, derivative)
    for axis in range(out.ndim):
        out = filtered(out, weights, axis, mode)
    return out


def median(a: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """The median of the cube of size (odd) voxels a side around each voxel, slab by slab."""
    names = {"reflect": "symmetric", "mirror": "reflect", "nearest": "edge", "wrap": "wrap", "constant": "constant"}
    wide = np.pad(a, size // 2, mode=names[mode])
    views = np.lib.stride_tricks.sliding_window_view(wide, (size,) * a.ndim)
    out, half = np.empty(a.shape, a.dtype), size**a.ndim // 2
    slab = max(1, (1 << 22) // max(1, size**a.ndim * int(np.prod(a.shape[1:]))))
    for at in range(0, a.shape[0], slab):
        block = views[at : at + slab]
        flat = block.reshape(*block.shape[: a.ndim], -1)
        out[at : at + slab] = np.partition(flat, half, -1)[..., half]
    return out


def grid(shape: tuple[int, ...], dtype=np.float64, sparse: bool = False) -> list[np.ndarray]:
    """The coordinates of all voxels for each axis; sparse: along that axis only, for broadcasting."""
    return list(np.meshgrid(*(np.arange(n, dtype=dtype) for n in shape), indexing="ij", sparse=sparse))
