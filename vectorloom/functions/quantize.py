"""Quantisers over float64 rows: centroid codes of the rotated direction (MSE), and with a 1-bit residual sketch (PROD)."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from vectorloom.errors import InvalidArgument
from vectorloom.functions import packing
from vectorloom.functions.codebook import codebook, nearest
from vectorloom.functions.rotation import next_pow2, rotate, unrotate

TINY = 1e-30


@dataclass(frozen=True)
class Quantizer:
    """Settings of the MSE quantiser. ``codebook_dim``: the padded dimension unless set."""

    dim: int
    bits: int = 4
    seed: int = 42
    codebook_dim: int | None = None

    def __post_init__(self):
        if not 1 <= self.dim <= 8192:
            raise InvalidArgument("dim from 1 to 8192")
        if not 1 <= self.bits <= 8:
            raise InvalidArgument("bit width from 1 to 8")

    @property
    def out_dim(self) -> int:
        return next_pow2(self.dim)

    @property
    def centroids(self) -> np.ndarray:
        return codebook(max(2, self.codebook_dim or self.out_dim), self.bits)

    def indices(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms); a row of zeros has norm 0."""
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / np.where(norm < TINY, 1.0, norm)[:, None]
        codes = nearest(rotate(unit, self.seed), self.centroids)
        codes[norm < TINY] = 0
        return codes, np.where(norm < TINY, 0.0, norm).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, norm = self.indices(x)
        return packing.pack(codes, self.bits), norm

    def rotated(self, packed: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Reconstructions in the rotated space."""
        return self.centroids[packing.unpack(packed, self.bits, self.out_dim)] * norm.astype(np.float64)[:, None]

    def decode(self, packed: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return unrotate(self.rotated(packed, norm), self.seed, self.dim)

    def scores(self, queries: np.ndarray, packed: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Inner products of reconstructions (rows) with queries (columns), without rotating rows back."""
        return self.rotated(packed, norm) @ rotate(queries, self.seed).T


@functools.lru_cache(maxsize=4)
def gaussian(seed: int, rows: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((rows, dim))


@dataclass(frozen=True)
class ProdQuantizer:
    """MSE codes of ``bits - 1`` and the signs of a Gaussian projection of the residual."""

    dim: int
    bits: int = 4
    seed: int = 42
    proj_dim: int | None = None

    def __post_init__(self):
        if self.bits < 2:
            raise InvalidArgument("the product quantiser needs two bits or more")

    @property
    def mse(self) -> Quantizer:
        return Quantizer(self.dim, self.bits - 1, self.seed)

    @property
    def rows(self) -> int:
        return self.proj_dim or self.dim

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        packed, norm = self.mse.encode(x)
        rest = x - self.mse.decode(packed, norm)
        signs = rest @ gaussian(self.seed + 1, self.rows, self.dim).T >= 0
        return packed, norm, np.packbits(signs, axis=1, bitorder="little"), np.sqrt((rest * rest).sum(axis=1)).astype(np.float32)

    def asked(self, queries: np.ndarray, estimator: str = "unbiased") -> np.ndarray:
        """Numbers of queries for ``numbers`` of rows; ``sign_agreement`` compares signs on both sides and is biased."""
        projected = queries @ gaussian(self.seed + 1, self.rows, self.dim).T
        if estimator == "unbiased":
            extra = np.sqrt(np.pi / 2) / self.rows * projected
        elif estimator == "sign_agreement":
            extra = np.where(projected >= 0, 1.0, -1.0) / self.rows * np.sqrt((queries * queries).sum(axis=1))[:, None]
        else:
            raise InvalidArgument(f"no estimator {estimator}")
        return np.concatenate((rotate(queries, self.seed), extra), axis=1)

    def numbers(self, packed, norm, signs, rest_norm) -> np.ndarray:
        """Numbers of rows whose inner products with ``asked`` are the estimates."""
        s = np.unpackbits(signs, axis=1, count=self.rows, bitorder="little") * 2.0 - 1.0
        return np.concatenate((self.mse.rotated(packed, norm), s * np.where(rest_norm < TINY, 0, rest_norm).astype(np.float64)[:, None]), axis=1)

    def estimate(self, queries: np.ndarray, packed, norm, signs, rest_norm, estimator: str = "unbiased") -> np.ndarray:
        """Inner products, a row a vector, a column a query."""
        return self.numbers(packed, norm, signs, rest_norm) @ self.asked(queries, estimator).T
