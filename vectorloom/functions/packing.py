"""Codes of 1 to 8 bits packed least significant bit first."""

from __future__ import annotations

import numpy as np

from vectorloom.errors import InvalidArgument


def packed_size(n: int, bits: int) -> int:
    """Bytes of n codes and their float norm."""
    return (n * bits + 7) // 8 + 4


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """(rows, n) codes to (rows, bytes)."""
    if not 1 <= bits <= 8:
        raise InvalidArgument("bit width from 1 to 8")
    codes = np.asarray(codes)
    if codes.size and (codes.min() < 0 or codes.max() >= 1 << bits):
        raise InvalidArgument("code out of range")
    each = np.unpackbits(codes.astype(np.uint8)[:, :, None], axis=2, bitorder="little")[:, :, :bits]
    return np.packbits(each.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, bits: int, n: int) -> np.ndarray:
    """(rows, bytes) to (rows, n) codes."""
    each = np.unpackbits(packed, axis=1, count=bits * n, bitorder="little").reshape(len(packed), n, bits)
    return (each.astype(np.int64) << np.arange(bits)).sum(axis=2)
