"""One volume as NumPy arrays, as the kernels of operators see it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np


@dataclass(frozen=True)
class Sample:
    """Image and mask of one shape, spacing, metadata, points (n x ndim) and boxes (n x ndim lows and highs) with labels."""

    image: np.ndarray
    mask: np.ndarray | None = None
    spacing: tuple[float, ...] = ()
    metadata: dict = field(default_factory=dict)
    points: np.ndarray | None = None
    point_labels: tuple = ()
    lows: np.ndarray | None = None
    highs: np.ndarray | None = None
    box_labels: tuple = ()

    @property
    def shape(self) -> tuple[int, ...]:
        return self.image.shape

    @property
    def ndim(self) -> int:
        return self.image.ndim

    @property
    def values(self) -> np.ndarray:
        """The image for arithmetic: single-precision images stay so, all others are in double precision."""
        return self.image if self.image.dtype == np.float32 else np.asarray(self.image, np.float64)

    def having(self, **fields) -> Sample:
        return replace(self, **fields)

    def moved(self, move, **fields) -> Sample:
        """With points and boxes moved by a function of (n x ndim) coordinates; a box becomes the box of its corners."""
        if self.points is not None and len(self.points):
            fields["points"] = move(self.points)
        if self.lows is not None and len(self.lows):
            ends = np.stack([self.lows, self.highs])
            corners = np.stack([move(ends[list(pick), :, range(self.ndim)].T) for pick in product((0, 1), repeat=self.ndim)])
            fields |= {"lows": corners.min(0), "highs": corners.max(0)}
        return replace(self, **fields)

    def visible(self, least: float = 0.0) -> Sample:
        """Without points outside the frame; boxes cut to it, and dropped if less than the share least of them is left."""
        if not 0 <= least <= 1:
            raise ValueError("min_visibility must be from 0 to 1")
        fields, size = {}, np.array(self.shape)
        if self.points is not None and len(self.points):
            keep = ((self.points >= 0) & (self.points < size)).all(1)
            fields |= {"points": self.points[keep], "point_labels": tuple(x for x, k in zip(self.point_labels, keep) if k)}
        if self.lows is not None and len(self.lows):
            lows, highs = np.clip(self.lows, 0, size - 1), np.clip(self.highs, 0, size - 1)
            left, whole = np.prod(highs - lows, 1), np.prod(self.highs - self.lows, 1)
            keep = (left > 0) & (left >= least * whole)
            fields |= {"lows": lows[keep], "highs": highs[keep], "box_labels": tuple(x for x, k in zip(self.box_labels, keep) if k)}
        return replace(self, **fields)


def axis_of(axis, ndim: int) -> int:
    """The array axis of x, y or z, or of a number."""
    if isinstance(axis, str):
        name = axis.lower()
        at = {"x": ndim - 1, "y": ndim - 2, "z": ndim - 3}.get(name, -1)
        if at < 0:
            raise ValueError(f"no axis {axis!r} in {ndim} dimensions")
        return at
    if not -ndim <= axis < ndim:
        raise ValueError(f"no axis {axis} in {ndim} dimensions")
    return axis % ndim
