"""A seeded random rotation: signs, fast Walsh-Hadamard transform, signs; padded to a power of two."""

from __future__ import annotations

import functools

import numpy as np


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


@functools.lru_cache(maxsize=64)
def signs(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two vectors of +-1; generator version 1 is PCG64."""
    rng = np.random.Generator(np.random.PCG64(seed))
    both = rng.integers(0, 2, (2, size)) * 2.0 - 1.0
    return both[0], both[1]


def fwht(x: np.ndarray) -> np.ndarray:
    """Unnormalised transform of each row."""
    n, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(n, size // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, size)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows padded with zeros and rotated."""
    size = next_pow2(x.shape[1])
    first, second = signs(seed, size)
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    return fwht(padded * first) * (second / np.sqrt(size))


def unrotate(y: np.ndarray, seed: int, dim: int) -> np.ndarray:
    """The inverse, cut back to ``dim``."""
    first, second = signs(seed, y.shape[1])
    return (fwht(y * second) * (first / np.sqrt(y.shape[1])))[:, :dim]
