"""Counter-based random draws: each depends on its key only, never on row order, partitions or retries."""

from __future__ import annotations

import hashlib

import numpy as np

# Constants of the 32-bit finaliser.
STEP, FIRST, SECOND = 2654435769, 2246822507, 3266489909


class Draws:
    """Draws of one node for one volume. The key is seed|epoch|path|volume; each draw adds its own name to it."""

    def __init__(self, seed: int, path: str, volume_id, epoch: int = 0):
        self.seed, self.path, self.volume_id, self.epoch = seed, path, volume_id, epoch

    def child(self, step: str | int) -> Draws:
        return Draws(self.seed, f"{self.path}.{step}", self.volume_id, self.epoch)

    def word(self, name: str) -> int:
        return int(hashlib.md5(f"{self.seed}|{self.epoch}|{self.path}|{self.volume_id}|{name}".encode()).hexdigest()[:8], 16)

    def unit(self, name: str) -> float:
        return (self.word(name) + 0.5) / 4294967296.0

    def uniform(self, name: str, span: tuple[float, float]) -> float:
        return span[0] + (span[1] - span[0]) * self.unit(name)

    def integer(self, name: str, span: tuple[int, int]) -> int:
        """Both ends included."""
        return span[0] + int(self.unit(name) * (span[1] - span[0] + 1))

    def field(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        """Units for each element, by its row-major position."""
        x = np.arange(int(np.prod(shape)), dtype=np.uint32)
        x *= np.uint32(STEP)
        x += np.uint32(self.word(name))
        for shift, factor in ((16, FIRST), (13, SECOND)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(16)
        out = x.astype(np.float64)
        out += 0.5
        out /= 4294967296.0
        return out.reshape(shape)

    def normal(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        """Standard normals by the Box-Muller transform."""
        radius = self.field(f"{name}.r", shape)
        np.log(radius, out=radius)
        radius *= -2
        np.sqrt(radius, out=radius)
        angle = self.field(f"{name}.a", shape)
        angle *= 2 * np.pi
        radius *= np.cos(angle, out=angle)
        return radius

    def choose(self, name: str, n: int, k: int) -> list[int]:
        """k distinct numbers below n, ascending."""
        return sorted(np.argsort(self.field(name, (n,)), kind="stable")[:k].tolist())
