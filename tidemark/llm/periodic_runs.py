"""Finding all periodic runs of words, and dropping their repetitions.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are the same)
of at least ``max(shortest, 3 * q)`` words that no neighbouring word extends with that period.

Internal pattern matching, for all texts of a batch side by side:

1. Words are numbered by their bytes. Suffixes are ordered by doubling, within each text, which
   also gives the class of every block of 1, 2, 4, ... words.
2. A run of period ``q`` has a dyadic block in its first ``length - q`` words: ``b`` words beginning at
   a multiple of ``b`` in the text, where ``b`` is the power of two with ``b <= q < 2 * b``, or 8
   for ``q < 16``. The block occurs again ``q`` words on.
3. The suffixes that begin with a block are a range of the suffix array. Range successor queries
   on a wavelet tree over that range give where the block occurs in the neighbouring window,
   ``b`` to ``2 * b - 1`` words on (for the smallest block also 1 to 7). These places are an
   arithmetic progression, so the first, the second, the last and their number say all.
4. Up to two places are candidate periods themselves. With more, the block has the progression's
   difference ``p`` as a period, and a run of period ``q >= b`` holds a word that breaks period
   ``p`` near both places, on the same side. Candidates are the distances of these breaks, left and right.
5. Each candidate is extended to both sides over the classes of blocks, from large to small. Of
   the stretches found with several periods, the smallest counts; the others are its multiples.

Only suffixes whose first eight words occur elsewhere in the text enter the tree. A text is worked
on as a whole by one task, in memory in proportion to its length; no step grows with the square of it.

Null text counts as empty, and has no runs. Rows are worked on one by one, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import string_buffer, text_pieces, with_columns_of
from tidemark.llm.wavelet import WaveletTree, suffix_classes
from tidemark.llm.word_numbers import character_class, numbered, spans_of, stretches

INSIDE = character_class([(0x20, 0x20), (0x09, 0x0D)], outside=True)
BLOCK = 8
SHORTEST = 3 * BLOCK  # so that the first length - q words of any run hold a whole block


def collapse_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """All columns of ``docs`` with ``runs`` and ``collapsed``.

    ``runs`` lists start, length and period (in words, from 0) by start, then period. ``collapsed`` are
    the words joined by single spaces, without those that some run contains after its first
    ``period`` words. Columns of ``docs`` with one of these names or ``_text`` are left out.
    ``shortest`` is at least 24.
    """
    if shortest < SHORTEST:
        raise ValueError(f"runs of fewer than {SHORTEST} words are not searched for")
    columns = [c for c in docs.columns if c not in ("runs", "collapsed", "_text")]
    texts = docs.select(*(docs[c] for c in columns), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    added = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return texts.mapInArrow(_collapsed(columns, shortest), with_columns_of(docs.select(*columns), added))


def _collapsed(columns: list[str], shortest: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, "_text"):
                offsets, data = string_buffer(piece.column("_text"))
                starts, ends, counts = spans_of(INSIDE[data], offsets)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                number, most = numbered(data, starts, ends)
                text, start, length, period = find_runs(number, most, bounds, shortest)
                runs = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))]).astype(np.int32),
                    pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind.value_type)),
                )
                change = np.zeros(bounds[-1] + 1, np.int64)
                first = bounds[text] + start
                np.add.at(change, first + period, 1)
                np.add.at(change, first + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                texts = joined(data, starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[bounds])
                rows = [piece.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*rows, runs, texts], [*columns, "runs", "collapsed"])

    return task


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words of each text with single spaces between them."""
    lengths = ends - starts + 1
    before = np.concatenate([[0], np.cumsum(lengths)])
    # Every word takes the byte behind it along, which becomes a space; the last one's is cut off.
    source = stretches(starts, lengths)
    out = data[np.minimum(source, max(0, len(data) - 1))] if len(source) else np.zeros(0, np.uint8)
    out[before[1:] - 1] = 0x20
    has = np.diff(bounds) > 0
    keep = np.ones(len(out), bool)
    keep[before[bounds[1:][has]] - 1] = False
    offsets = before[bounds] - np.concatenate([[0], np.cumsum(has)])
    return pa.StringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out[keep].tobytes())
    )


def find_runs(
    number: np.ndarray, most: int, bounds: np.ndarray, shortest: int = SHORTEST
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (in the text), length and period of every run, in this order.

    ``number`` are the words of all texts as numbers below ``most``; text ``i`` has those from
    ``bounds[i]`` to ``bounds[i + 1]``.
    """
    counts = np.diff(bounds)
    long = np.flatnonzero(counts >= shortest)  # shorter texts have no run
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none
    at = stretches(bounds[long], counts[long])
    begin = np.cumsum(counts[long]) - counts[long]
    text = np.repeat(np.arange(len(long)), counts[long])
    first, end = begin[text], (begin + counts[long])[text]
    words = number[at]
    order, classes = suffix_classes(text * most + words, end)
    reach = Reach(classes, first, end)

    found = []
    levels = [k for k in range(3, len(classes)) if 1 << k < int(counts.max())]
    if levels:
        slots = np.flatnonzero(np.bincount(classes[3], minlength=len(order))[classes[3][order]] > 1)
        tree = WaveletTree(order[slots], max(1, int(len(words)).bit_length()))
        for k in levels:
            found.append(_candidates(reach, k, slots, tree))
    if not found:
        return none, none, none, none
    place, q = (np.concatenate(parts) for parts in zip(*found))
    left, right = place - reach.left(place, place + q), place + q + reach.right(place, place + q)
    ok = right - left >= np.maximum(shortest, 3 * q)
    left, right, q = left[ok], right[ok], q[ok]
    # Equal stretches together, the smallest period first.
    by = np.lexsort((q, right, left))
    left, right, q = left[by], right[by], q[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    left, right, q = left[fresh], right[fresh], q[fresh]
    by = np.lexsort((q, left))
    left, right, q = left[by], right[by], q[by]
    return long[text[left]], left - first[left], right - left, q


class Reach:
    """How far two places of a text agree, to the right and to the left, by classes of blocks."""

    def __init__(self, classes: list[np.ndarray], first: np.ndarray, end: np.ndarray):
        self.classes, self.first, self.end = classes, first, end
        self.last = len(first) - 1

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from ``a`` and ``b`` on; ``a < b``, in one text."""
        stop = self.end[np.minimum(a, self.last)]
        at, to = a.copy(), b.copy()
        for k in reversed(range(len(self.classes))):
            rank = self.classes[k]
            same = (to + (1 << k) <= stop) & (rank[at] == rank[np.minimum(to, self.last)])
            at, to = at + (same << k), to + (same << k)
        return at - a

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words before ``a`` and ``b``."""
        start = self.first[np.minimum(a, self.last)]
        at, to = a.copy(), b.copy()
        for k in reversed(range(len(self.classes))):
            rank, size = self.classes[k], 1 << k
            inside = at - size >= start
            same = inside & (rank[np.maximum(at - size, 0)] == rank[np.maximum(to - size, 0)])
            at, to = at - (same << k), to - (same << k)
        return a - at


def _candidates(reach: Reach, k: int, slots: np.ndarray, tree: WaveletTree) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of ``1 << k`` words and the periods that they may have in a run."""
    size, rank = 1 << k, reach.classes[k]
    place = np.flatnonzero((np.arange(len(rank)) - reach.first) % size == 0)
    place = place[place + size <= reach.end[place]]
    members = np.bincount(rank, minlength=len(rank) + 1)
    place = place[members[rank[place]] > 1]
    if not len(place):
        return place, place
    low = np.searchsorted(slots, rank[place])
    high = low + members[rank[place]]

    out: list[tuple[np.ndarray, np.ndarray]] = []
    windows = [(size, 2 * size)] if size > BLOCK else [(1, size), (size, 2 * size)]
    for near, far in windows:
        before = tree.less(low, high, place + near)
        after = tree.less(low, high, place + far)
        n = after - before
        some = n > 0
        s, a, b, c, n = place[some], low[some], high[some], before[some], n[some]
        if not len(s):
            continue
        one = tree.nth(a, b, c)
        out.append((s, one - s))
        if near == 1:
            continue
        several = n > 1
        s, a, b, c, n, one = (x[several] for x in (s, a, b, c, n, one))
        two = tree.nth(a, b, c + 1)
        out.append((s, two - s))
        many = n > 2
        s, one, p = s[many], one[many], (two - one)[many]
        if len(s):
            out.append((s, reach.right(one, one + p) + one - reach.right(s, s + p) - s))
            out.append((s, one - reach.left(one, one + p) - s + reach.left(s, s + p)))
    if not out:
        return place[:0], place[:0]
    s, q = (np.concatenate(parts) for parts in zip(*out))
    far = np.minimum(s + np.maximum(q, 0), reach.last)
    ok = (q > 0) & (q < 2 * size) & (s + q + size <= reach.end[s])
    ok &= rank[s] == rank[far]
    return s[ok], q[ok]
