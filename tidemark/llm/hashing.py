"""Hashes of words and word sequences, computed for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A value for each byte, and the odd base of the polynomial hash with its inverse mod 2^64.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same for code points; those beyond 0xFFFF share the last.
POINT_VALUES = _rng.integers(1, 2**63, 0x10001, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PIECE = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        size = max(PIECE + 4096, n)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 1 << 23:  # longer ones are for a single long word and not kept
            _powers[str(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that each bit depends on all (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_VALUES
) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, whose values ``table`` maps to 64 bits.

    The starts are in order, and so are the ends.

    The spans are hashed in pieces of about a megabyte, so memory does not grow with the text.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        n = last - first
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[first:last]] * powers(BASE, n), out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        back = powers(INVERSE, n + 1)
        out[at:to] = (sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of words per text."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII capitals as small letters; all other bytes unchanged."""
    return _LOWER[data]


def shingle_hashes(
    data: np.ndarray, offsets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word sequences of each text, and where each text's begin.

    A text with fewer words has its whole sequence as the only one; a text without words
    has none. Repeats within a text are kept.
    """
    data = lower(data)
    starts, ends, counts = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    per_text = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    begin = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], per_text)
    stop = np.repeat(first[1:], per_text)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = at + k < stop
        step = mix(out * np.uint64(3) + words[np.minimum(at + k, max(0, len(words) - 1))] + np.uint64(k)) if len(words) else out
        out = np.where(there, step, out)
    return out, begin


def distinct_per_text(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and where each text's begin."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
