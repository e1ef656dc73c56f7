"""Suffix order of a batch of sequences, and wavelet trees that answer many queries at once.

All functions take and return whole arrays: a query is an element, and all queries walk down the
levels of a tree together.
"""

from __future__ import annotations

import numpy as np


def suffix_classes(symbols: np.ndarray, ends: np.ndarray, deepest: int | None = None):
    """Suffixes in order, and for each depth 1, 2, 4, ... the class of each position.

    ``ends[i]`` is where the sequence that holds position ``i`` ends; comparison stops there, and
    the shorter suffix is the smaller one. Equal symbols must lie in one sequence unless
    sequences may be compared with each other. A class at depth ``d`` is the place in the order
    of the first suffix that begins with the same ``d`` symbols; suffixes that are shorter than
    ``d`` differ from all others. Returns the order and the list of classes by depth; it ends when all
    suffixes differ, or at ``deepest``.

    Only classes that still have several members are sorted on.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    ordered = symbols[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.flatnonzero(fresh)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(place, np.diff(np.append(place, n)))
    classes = [rank]
    slots = _several(fresh)
    depth = 1
    while len(slots) and (deepest is None or depth < deepest):
        rank = rank.copy()
        who = order[slots]
        after = who + depth
        inside = after < ends[who]
        # Beyond the end: smaller than all, and the shorter suffix (the later start) first.
        tail = np.where(inside, classes[-1][np.minimum(after, n - 1)] + np.int64(n + 1), n - who)
        key = classes[-1][who] * np.int64(2 * n + 2) + tail
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[slots] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = key[1:] != key[:-1]
        place = np.flatnonzero(fresh)
        rank[who] = np.repeat(slots[place], np.diff(np.append(place, len(who))))
        classes.append(rank)
        slots = slots[_several(fresh)]
        depth *= 2
    return order, classes


def _several(fresh: np.ndarray) -> np.ndarray:
    """Places in runs of more than one; ``fresh`` marks where a run starts."""
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return np.flatnonzero(~alone)


class WaveletTree:
    """Numbers below ``1 << bits`` by their bits, from the highest: one level of ranks per bit.

    At each level the numbers with a 0 go before those with a 1, otherwise in the order of the level
    above; ``ones[k][i]`` counts the 1s among the first ``i``.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.ones, self.zeros = [], []
        values = values.astype(np.uint32)
        for level in range(bits):
            bit = (values >> np.uint32(bits - 1 - level)) & np.uint32(1)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            high = bit.astype(bool)
            values = np.concatenate([values[~high], values[high]])

    def _down(self, level: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        ones = self.ones[level][at]
        return np.where(one, self.zeros[level] + ones, at - ones)

    def _bit(self, level: int, values: np.ndarray) -> np.ndarray:
        return (values >> (self.bits - 1 - level)) & 1 == 1

    def first(self, symbols: np.ndarray) -> np.ndarray:
        """Where the leaf of each symbol begins; what ``before`` counts from."""
        at = np.zeros(len(symbols), np.int64)
        for level in range(self.bits):
            at = self._down(level, at, self._bit(level, symbols))
        return at

    def before(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before a place, plus where its leaf begins."""
        for level in range(self.bits):
            at = self._down(level, at, self._bit(level, symbols))
        return at

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers at places ``low`` to ``high`` are less than ``bound``."""
        count = np.zeros(len(low), np.int64)
        everything = bound >= 1 << self.bits
        total = high - low
        bound = np.where(everything, 0, bound)
        for level in range(self.bits):
            one = self._bit(level, bound)
            a, b = self.ones[level][low], self.ones[level][high]
            count += np.where(one, (high - low) - (b - a), 0)
            low = np.where(one, self.zeros[level] + a, low - a)
            high = np.where(one, self.zeros[level] + b, high - b)
        return np.where(everything, total, count)

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number at place ``k`` (from 0) of those at ``low`` to ``high`` in ascending order."""
        out = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b = self.ones[level][low], self.ones[level][high]
            zeros = (high - low) - (b - a)
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            low = np.where(one, self.zeros[level] + a, low - a)
            high = np.where(one, self.zeros[level] + b, high - b)
            out = out << 1 | one
        return out
