"""Scalar codebooks: Lloyd-Max centroids for one coordinate of a random unit vector, solved on the driver.

The density is that of a coordinate on the unit sphere, (1 - x^2)^((d - 3) / 2), for d below 256, and its normal
limit N(0, 1 / d) on six deviations from there on.
"""

from __future__ import annotations

import functools

import numpy as np

from vectorloom.errors import InvalidArgument

GRID = 20_001


def _table(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid on the positive half, with running mass and running first moment."""
    high = 1.0 if dim < 256 else 6 / np.sqrt(dim)
    x = np.linspace(0.0, high, GRID)
    if dim < 256:
        inside = np.clip(1 - x * x, 0, None)
        density = inside ** ((dim - 3) / 2) if dim >= 3 else 1 / np.sqrt(np.maximum(inside, 1e-6))
    else:
        density = np.exp(-0.5 * dim * x * x)
    step = x[1] - x[0]
    mass = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2 * step)))
    xd = x * density
    moment = np.concatenate(([0.0], np.cumsum((xd[1:] + xd[:-1]) / 2 * step)))
    return x, mass / mass[-1], moment / mass[-1]


@functools.lru_cache(maxsize=None)
def codebook(dim: int, bits: int, tolerance: float = 1e-7, rounds: int = 5_000) -> np.ndarray:
    """The 2**bits sorted centroids; symmetric, so only the positive half is solved."""
    if dim < 2:
        raise InvalidArgument("a codebook needs at least two dimensions")
    if not 1 <= bits <= 8:
        raise InvalidArgument("bit width from 1 to 8")
    x, mass, moment = _table(dim)
    half = 1 << (bits - 1)
    c = np.interp((np.arange(half) + 0.5) / half, mass, x)
    for _ in range(rounds):
        edges = np.concatenate(([0.0], (c[1:] + c[:-1]) / 2, [x[-1]]))
        m, s = np.interp(edges, x, mass), np.interp(edges, x, moment)
        new = np.diff(s) / np.maximum(np.diff(m), 1e-300)
        moved = np.abs(new - c).max() / x[-1]
        c = np.clip(c + 1.5 * (new - c), 0, x[-1]) if moved > 1e-3 else new
        c.sort()
        if moved < tolerance:
            break
    return np.concatenate((-c[::-1], c))


def nearest(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid; a tie takes the lower one."""
    return np.searchsorted((centroids[1:] + centroids[:-1]) / 2, values, side="left")
