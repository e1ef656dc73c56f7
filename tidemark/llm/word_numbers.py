"""Words of a batch of texts as numbers, equal exactly where their bytes are equal."""

from __future__ import annotations

import numpy as np

from tidemark.llm.hashing import span_hashes


def character_class(ranges: list[tuple[int, int]], outside: bool = False) -> np.ndarray:
    """A table of bytes: true for those in one of the ranges, or for all others."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if outside else table


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of ``inside``, and how many each text has.

    ``offsets`` are the bounds of the texts; a stretch never crosses one.
    """
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, offsets))


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the stretches, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def same_bytes(
    data: np.ndarray,
    starts: np.ndarray,
    ends: np.ndarray,
    others: np.ndarray,
    other_starts: np.ndarray,
    other_ends: np.ndarray,
    piece: int = 1 << 20,
) -> np.ndarray:
    """Whether each span of ``data`` equals its span of ``others``; compared a megabyte at a time."""
    lengths = ends - starts
    equal = lengths == other_ends - other_starts
    rows = np.flatnonzero(equal & (lengths > 0))
    total = np.cumsum(lengths[rows])
    at = 0
    while at < len(rows):
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + piece, side="right")))
        part, size = rows[at:to], lengths[rows[at:to]]
        one = data[stretches(starts[part], size)]
        two = others[stretches(other_starts[part], size)]
        differ = np.add.reduceat((one != two).astype(np.int64), np.cumsum(size) - size)
        equal[part[differ > 0]] = False
        at = to
    return equal


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each span, from 0, the same for equal bytes only; and how many there are.

    Spans are grouped by a hash and every one is compared with the first of its group. Should
    two different ones share a hash, all spans are numbered by their bytes.
    """
    if len(starts) == 0:
        return np.zeros(0, np.int64), 0
    hashes = span_hashes(data, starts, ends)
    values, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    of = first[number]
    if same_bytes(data, starts, ends, data, starts[of], ends[of]).all():
        return number.astype(np.int64), len(values)
    whole, seen = data.tobytes(), {}
    spans = zip(starts.tolist(), ends.tolist())
    number = np.array([seen.setdefault(whole[a:b], len(seen)) for a, b in spans], np.int64)
    return number, len(seen)
