"""Compressed bitmaps over dense integer codes.

Codes are split at 2**16: a container of few codes is a sorted array of 16-bit
numbers, one of many a packed bit field of 8 KiB, as in roaring bitmaps.
"""

from __future__ import annotations

import numpy as np

ARRAY_LIMIT = 4096


class Bitmap:
    """An immutable set of non-negative integers below 2**32."""

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray]):
        self.parts = parts

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(np.asarray(codes, dtype=np.uint32))
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = {}
        for chunk in np.split(codes, cuts):
            if len(chunk):
                parts[int(chunk[0] >> 16)] = _pack((chunk & 0xFFFF).astype(np.uint16))
        return cls(parts)

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for high, mine in self.parts.items():
            theirs = other.parts.get(high)
            left = mine if theirs is None else _and_not(mine, theirs)
            if left is not None:
                out[high] = left
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        """The members in ascending order."""
        parts = [(np.uint32(high) << np.uint32(16)) | _low(part).astype(np.uint32) for high, part in sorted(self.parts.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def nbytes(self) -> int:
        return sum(part.nbytes for part in self.parts.values())


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) <= ARRAY_LIMIT:
        return low
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _low(part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(part)).astype(np.uint16) if part.dtype == np.uint8 else part


def _and_not(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray | None:
    if mine.dtype == np.uint8 and theirs.dtype == np.uint8:
        left = _low(mine & ~theirs)
    elif theirs.dtype == np.uint8:
        left = mine[(theirs[mine >> 3] >> (7 - (mine & 7))) & 1 == 0]
    else:
        left = np.setdiff1d(_low(mine), theirs, assume_unique=True)
    return _pack(left.astype(np.uint16)) if len(left) else None
