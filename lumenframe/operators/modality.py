"""Artefacts of MR, CT, X-ray and tomosynthesis."""

from __future__ import annotations

import numpy as np

from lumenframe.functions import kernels
from lumenframe.operators.spatial import ORDER3, displaced, like
from lumenframe.plans.node import Plain, Span, Tuple, number, one_of, operator
from lumenframe.plans.sample import axis_of

IN_PLANE = one_of("x", "y")


@operator(ghost_intensity=Span(least=0), ghost_shift=Span(whole=True), phase_encode_axis=IN_PLANE, num_ghosts=number(1))
def GhostingArtifact(v, d, ghost_intensity=(0.05, 0.15), ghost_shift=(8, 32), phase_encode_axis="y", num_ghosts=1):
    """Adds rolled copies of the image along the phase axis."""
    values, axis = v.values, axis_of(phase_encode_axis, v.ndim)
    if np.abs(values).max() < 1e-8:
        return v
    out = values.copy()
    for k in range(num_ghosts):
        share, shift = d.uniform(f"intensity{k}", ghost_intensity), d.integer(f"shift{k}", ghost_shift)
        if shift:
            out += share * np.roll(values, shift if d.unit(f"sign{k}") < 0.5 else -shift, axis)
    return v.having(image=like(out, v.image))


@operator(dropout_fraction=Span(least=0, most=1), phase_encode_axis=IN_PLANE)
def KSpaceDropout(v, d, dropout_fraction=(0.01, 0.05), phase_encode_axis="y"):
    """Zeroes lines of each plane's spectrum, at least one, drawn for each plane; the result is the magnitude."""
    share = d.uniform("fraction", dropout_fraction)
    if share == 0:
        return v
    planes, axis = v.values.reshape(-1, *v.shape[-2:]), 0 if phase_encode_axis == "y" else 1
    n = planes.shape[1 + axis]
    k, out = max(1, round(share * n)), np.empty(planes.shape)
    for z, plane in enumerate(planes):  # the other axis' transform cancels
        spectrum = np.fft.fft(plane, axis=axis)
        np.moveaxis(spectrum, axis, 0)[d.choose(f"lines{z}", n, k)] = 0
        out[z] = np.abs(np.fft.ifft(spectrum, axis=axis))
    return v.having(image=like(out.reshape(v.shape), v.image))


@operator(degrees=Span(signed=True), translation=Span(signed=True), num_movements=Span(least=1, whole=True))
def MRIMotion(v, d, degrees=(1.0, 5.0), translation=(1.0, 4.0), num_movements=(1, 3)):
    """The mean of the image and copies turned and shifted in the plane."""
    n, total = d.integer("movements", num_movements), v.values.copy()
    h, w = v.shape[-2:]
    planes = v.values.reshape(-1, h, w)
    for k in range(n):
        angle = np.deg2rad(d.uniform(f"angle{k}", degrees))
        dy, dx = d.uniform(f"dy{k}", translation), d.uniform(f"dx{k}", translation)
        y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
        turned = [np.cos(angle) * y + np.sin(angle) * x + (h - 1) / 2, -np.sin(angle) * y + np.cos(angle) * x + (w - 1) / 2]
        moved = kernels.sample_planes(planes, turned, "reflect")
        total += kernels.along(kernels.along(moved, 1, np.arange(h) - dy, 1, "reflect"), 2, np.arange(w) - dx, 1, "reflect").reshape(v.shape)
    return v.having(image=like(total / (n + 1), v.image))


@operator(alpha=Span(least=0), power=number(0, above=True))
def BeamHardening(v, d, alpha=(0.02, 0.08), power=2.0):
    """Takes away a bowl over the plane, deepest in the middle, in shares of the value range."""
    values, share = v.values, d.uniform("alpha", alpha)
    span = values.max() - values.min()
    if span < 1e-8:
        return v
    h, w = v.shape[-2:]
    y, x = ((np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 1.0) for n in (h, w))
    r = np.sqrt(y[:, None] ** 2 + x**2).clip(0, 1)
    return v.having(image=like(values - share * span * (1 - r**power), v.image))


@operator(intensity=Span(least=0), num_streaks=Span(least=1, whole=True), num_sources=Span(least=1, whole=True), falloff=number(0, above=True))
def MetalStreak(v, d, intensity=(0.1, 0.3), num_streaks=(6, 12), num_sources=1, falloff=0.5):
    """Adds rays around sources in the middle half of the plane that fade with the distance, in shares of the value range."""
    values = v.values
    span = values.max() - values.min()
    if span < 1e-8 or (share := d.uniform("intensity", intensity)) == 0:
        return v
    h, w = v.shape[-2:]
    field = np.zeros((h, w))
    for k in range(d.integer("sources", num_sources)):
        y = np.arange(h)[:, None] - d.uniform(f"y{k}", (0.25 * h, 0.75 * h))
        x = np.arange(w) - d.uniform(f"x{k}", (0.25 * w, 0.75 * w))
        n, phase = d.integer(f"streaks{k}", num_streaks), d.uniform(f"phase{k}", (0.0, 2 * np.pi))
        field += np.cos(n * np.arctan2(y, x) + phase) * np.exp(-np.hypot(y, x) / (falloff * np.hypot(h, w) + 1e-8))
    return v.having(image=like(values + share * span * field, v.image))


@operator(fraction=Span(least=0), sigma=Span(least=0, above=True))
def ScatterSimulation(v, d, fraction=(0.1, 0.4), sigma=(15.0, 40.0)):
    """Adds a share of the widely blurred image."""
    share, s = d.uniform("fraction", fraction), d.uniform("sigma", sigma)
    return v.having(image=like(v.values + share * kernels.gaussian(v.values, s), v.image))


@operator(amplitude=Span(least=0), frequency=Span(least=0, above=True), axis=IN_PLANE)
def GridArtifact(v, d, amplitude=(0.03, 0.1), frequency=(0.2, 0.45), axis="x"):
    """Times a wave along an axis of the plane; the frequency is in cycles a voxel."""
    a, f, phase = d.uniform("amplitude", amplitude), d.uniform("frequency", frequency), d.uniform("phase", (0.0, 2 * np.pi))
    at = axis_of(axis, v.ndim)
    wave = 1 + a * np.sin(2 * np.pi * f * np.arange(v.shape[at]) + phase)
    return v.having(image=like(v.values * wave.reshape([-1 if i == at else 1 for i in range(v.ndim)]), v.image))


@operator(max_shift=Span(signed=True, whole=True), only_3d=True)
def SlabShift(v, d, max_shift=2, cval=0.0):
    """Moved along z by whole slices; points stay."""
    s = d.integer("shift", max_shift)
    if s == 0:
        return v

    def move(a, fill):
        out = np.full_like(a, fill)
        if abs(s) < len(a):
            out[max(s, 0) : len(a) + min(s, 0)] = a[max(-s, 0) : len(a) - max(s, 0)]
        return out

    return v.having(image=move(v.image, cval), mask=None if v.mask is None else move(v.mask, 0))


@operator(arc_degrees=Span(least=0, above=True), base_sigma=number(0), reference_arc_deg=number(0, above=True), only_3d=True)
def LimitedAngleBlur(v, d, arc_degrees=(15.0, 25.0), base_sigma=1.0, reference_arc_deg=20.0):
    """Blurred along z, the more the smaller the arc."""
    s = base_sigma * reference_arc_deg / d.uniform("arc", arc_degrees)
    return v if s == 0 else v.having(image=like(kernels.filtered(v.values, kernels.gaussian_weights(s), 0), v.image))


@operator(num_slices=Span(least=0, whole=True), only_3d=True)
def SliceDropout(v, d, num_slices=1, cval=0.0, affect_mask=False):
    """Sets different slices to a value."""
    n = min(d.integer("slices", num_slices), v.shape[0])
    if not n:
        return v
    at = d.choose("which", v.shape[0], n)
    image, mask = v.image.copy(), v.mask.copy() if v.mask is not None and affect_mask else v.mask
    image[at] = cval
    if mask is not None and affect_mask:
        mask[at] = 0
    return v.having(image=image, mask=mask)


@operator(alpha=Tuple(size=3), sigma=Tuple(size=3), order=ORDER3, only_3d=True)
def AnisotropicElastic(v, d, alpha=(100.0, 100.0, 8.0), sigma=(8.0, 8.0, 2.0), order=1):
    """ElasticDeform with a value for each array axis (z, y, x)."""
    return displaced(v, d, alpha, sigma, order, "reflect", 0.0)


@operator(scale=Span(least=0, above=True), axis=one_of("x", "y", "z"), order=ORDER3, only_3d=True)
def CompressionVariation(v, d, scale=(0.85, 1.15), axis="y", order=1):
    """Scaled along one axis about its centre; points stay."""
    s, at = d.uniform("scale", scale), axis_of(axis, v.ndim)
    if abs(s - 1) < 1e-8:
        return v
    n = v.shape[at]
    coords = (np.arange(n) - (n - 1) / 2) / s + (n - 1) / 2
    mask = None if v.mask is None else kernels.along(v.mask, at, coords, 0, "constant")
    return v.having(image=like(kernels.along(v.values, at, coords, order, "nearest" if order else "constant"), v.image), mask=mask)


@operator(amplitude=Span(least=0), num_planes=Span(least=1, whole=True), decay=Plain(lambda x: 0 < x <= 1, "above 0 and at most 1"), axis=IN_PLANE, only_3d=True)
def ReconStreak(v, d, amplitude=(0.05, 0.2), num_planes=(1, 3), displacement=1.5, decay=0.6, axis="x"):
    """Adds fading copies moved by whole slices along z and by multiples of the displacement in the plane, both ways."""
    a = d.uniform("amplitude", amplitude)
    if a == 0:
        return v
    values, at = v.values, axis_of(axis, 3)
    out, n = values.copy(), v.shape[at]
    for k in range(1, d.integer("planes", num_planes) + 1):
        for way in (1, -1):
            copy = kernels.along(values, at, np.arange(n) - way * k * displacement, 1, "constant")
            copy = kernels.along(copy, 0, np.arange(len(values), dtype=float) - way * k, 1, "constant")
            out += a * decay ** (k - 1) * copy
    return v.having(image=like(out, v.image))
