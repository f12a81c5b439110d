"""Patched frame-of-reference blocks for arrays of unsigned 32-bit ids.

A block subtracts its minimum, packs the low bits of every value at the width that some percentile of the
block needs and stores the high bits of the others as exceptions (position, high part). Of the candidate
percentiles the one with the fewest bytes is chosen. Values lie in 32 rows of equal length; row r starts
at bit 32-aligned word r*w//32, so packing and unpacking are a few whole-array operations.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 8192
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
_HEAD = struct.Struct("<IIHBx")  # values, minimum, exceptions, width


def encode_block(values: np.ndarray) -> bytes:
    """One block of 1 to BLOCK values."""
    n, low = len(values), int(values.min())
    rest = values - np.uint32(low)
    ranked = np.sort(rest)
    best = None
    for p in PERCENTILES:
        width = int(ranked[min(n - 1, int(p * n))]).bit_length()
        outliers = n - int(np.searchsorted(ranked, 1 << width))
        cost = n * width + 48 * outliers
        if best is None or cost < best[0]:
            best = (cost, width)
    width = best[1]
    lanes = -(-n // 32)
    rows = np.zeros(32 * lanes, np.uint32)
    rows[:n] = rest if width >= 32 else rest & np.uint32((1 << width) - 1)
    rows = rows.reshape(32, lanes)
    words = np.zeros((width, lanes), np.uint32)
    for r in range(32 if width else 0):
        at, shift = divmod(r * width, 32)
        words[at] |= rows[r] << np.uint32(shift)
        if shift + width > 32:
            words[at + 1] |= rows[r] >> np.uint32(32 - shift)
    where = np.flatnonzero(rest >= np.uint64(1 << width)) if width < 32 else np.empty(0, np.int64)
    return b"".join([_HEAD.pack(n, low, len(where), width), words.astype("<u4").tobytes(), where.astype("<u2").tobytes(), (rest[where] >> np.uint32(width)).astype("<u4").tobytes()])


def decode_block(data: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The values of the block that starts at a byte, and the byte after it."""
    n, low, outliers, width = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    lanes = -(-n // 32)
    words = np.frombuffer(data, "<u4", width * lanes, at).reshape(width, lanes)
    at += 4 * width * lanes
    rows = np.zeros((32, lanes), np.uint32)
    mask = np.uint32((1 << width) - 1) if width < 32 else np.uint32(0xFFFFFFFF)
    for r in range(32 if width else 0):
        word, shift = divmod(r * width, 32)
        got = words[word] >> np.uint32(shift)
        if shift + width > 32:
            got = got | (words[word + 1] << np.uint32(32 - shift))
        rows[r] = got & mask
    out = rows.reshape(-1)[:n]
    if outliers:
        where = np.frombuffer(data, "<u2", outliers, at)
        high = np.frombuffer(data, "<u4", outliers, at + 2 * outliers)
        out[where] |= high << np.uint32(width)
    return out + np.uint32(low), at + 6 * outliers
