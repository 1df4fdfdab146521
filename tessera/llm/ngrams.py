"""Hashed byte n-grams over Arrow text buffers, without a loop over characters."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, with every ASCII byte but letters a space.
_LETTERS = np.where((np.arange(256) >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)), _LOWER, 32).astype(np.uint8)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def letters_only(data: np.ndarray) -> np.ndarray:
    """Lower-case bytes; digits, signs and controls become spaces; U+00C0 to U+00DE fold too."""
    out = _LETTERS[data]
    if len(out) > 1:
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        upper = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
        out[upper] += 0x20
    return out


def gram_hashes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each start, the bucket (of 2**bits) of the n bytes from there, n at most 4; the last
    n - 1 starts, and those in the last n - 1 bytes of a row, hold no gram of the row."""
    size = len(data)
    value = np.zeros(size, np.uint32)
    for j in range(min(n, size)):
        value[: size - j] <<= np.uint32(8)
        value[: size - j] |= data[j:]
    value *= _FACTORS[n]
    value ^= value >> np.uint32(15)
    value *= _FACTORS[0]
    return value >> np.uint32(32 - bits)


def gram_counts(lengths: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(lengths - (n - 1), 0)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; the same whatever rows stand beside it."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some])
    return out


def drop_tails(hashes: np.ndarray, offsets: np.ndarray, n: int, to: int) -> None:
    """Point the starts that run over a row's end at bucket ``to``."""
    for j in range(1, n):
        at = offsets[1:] - j
        hashes[at[at >= 0]] = to
