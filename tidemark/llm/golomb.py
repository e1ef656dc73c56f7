"""Golomb coding of sorted integers, with a power of two as the parameter.

A sorted list of 64-bit values is kept as its gaps. Each gap is split at ``k`` bits: the upper
part is written in unary, the lower part as ``k`` plain bits. Both parts are bit arrays of their
own, so numpy codes and decodes them without a loop over values.
"""

from __future__ import annotations

import struct

import numpy as np


def encode(values: np.ndarray) -> bytes:
    """Code sorted uint64 values. Layout: count, k, length of the unary part, unary bits, low bits."""
    n = len(values)
    if n == 0:
        return struct.pack("<QBQ", 0, 0, 0)
    gaps = values.astype(np.uint64).copy()
    gaps[1:] -= values[:-1].astype(np.uint64)
    mean = int(gaps.astype(np.float64).mean() * 0.69) or 1
    k = min(63, max(0, mean.bit_length() - 1))
    upper = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(upper + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    unary = np.packbits(unary)
    low = np.empty((n, k), np.uint8)
    for bit in range(k):
        low[:, bit] = (gaps >> np.uint64(k - 1 - bit)).astype(np.uint8) & 1
    return struct.pack("<QBQ", n, k, len(unary)) + unary.tobytes() + np.packbits(low).tobytes()


def decode(code: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<QBQ", code)
    if n == 0:
        return np.zeros(0, np.uint64)
    at = struct.calcsize("<QBQ")
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, at)))[:n]
    upper = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(code, np.uint8, -1, at + size))[: n * k].reshape(n, k)
    low = np.zeros(n, np.uint64)
    for bit in range(k):
        low = (low << np.uint64(1)) | bits[:, bit].astype(np.uint64)
    return np.cumsum((upper.astype(np.uint64) << np.uint64(k)) | low, dtype=np.uint64)
