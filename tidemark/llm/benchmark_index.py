"""Finding benchmark passages in documents with an FM-index per shard of documents.

A word of a document is hit if it lies in an occurrence of a window: ``window`` consecutive words of a
benchmark item, or the whole of a shorter one. Words are maximal runs of ASCII letters and digits and of
characters beyond ASCII; capitals A-Z count as small letters.

1. The items' words are cut into pieces that overlap by a window, and the pieces are dealt into blocks
   of bounded size (``BLOCK_BYTES`` of text). One block at a time goes to the workers: its dictionary, its distinct
   windows as word numbers, and which items have each.
2. A worker takes a shard of documents (``SHARD_BYTES`` of text) and keeps the stretches of words that all are in
   the dictionary and that are long enough for the shortest window; every other word ends a
   stretch. Their suffixes are ordered, and the words before them, in that order, make a wavelet tree.
3. All windows are searched backwards at once, from their last word to their first: two ranks in the
   tree for each word. Most drop out after a few words.
4. What is left are ranges of suffixes. Their places come from the tree again: each steps backwards
   through the text until it meets a sampled suffix (every eighth word of a stretch, and its first).
5. The words found are compared byte by byte with the window's. Then they are merged into spans.

The index holds only the current block's words, so it is built anew for each block, from the same shard;
with several blocks the hits so far are written and read in between. A document is never cut apart.
Null text has no words. Items without an id mark words but are not listed. Rows are worked on one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, string_buffer, text_pieces, with_columns_of
from tidemark.llm.hashing import lower, span_hashes
from tidemark.llm.wavelet import WaveletTree, suffix_classes
from tidemark.llm.word_numbers import character_class, same_bytes, spans_of, stretches

INSIDE = character_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], outside=True)
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 4 << 20
PIECE_WORDS = 4096
SAMPLE = 8
ADDED = ("n_words", "spans", "items")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    item_col: str = "item_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``spans`` and ``items``.

    ``spans`` lists start and end (in words, from 0) of the maximal stretches of hit words, ``items``
    the distinct ids, as strings in ascending order, of the items with a window in the document.
    Columns of ``docs`` with one of these names or ``_text`` are left out.
    """
    columns = [c for c in docs.columns if c not in (*ADDED, "_text")]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(*(docs[c] for c in columns), text.alias("_text"))
    pieces = saved(
        items.select(items[item_col].cast("string").alias("item"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("text"))
        .mapInArrow(_pieces(window), "item string, words binary, bytes bigint"),
        "benchmark",
    )
    size = pieces.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = with_columns_of(docs.select(*columns), "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")
    wide = with_columns_of(rows, "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")
    spark = docs.sparkSession
    for k in range(blocks):
        mine = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).select("item", "words").collect()
        block = spark.sparkContext.broadcast(Block.of([(r["item"], bytes(r["words"])) for r in mine], window))
        last = k == blocks - 1
        names = [*columns, *([] if last else ["_text"])]
        rows = rows.mapInArrow(_search(names, block), schema if last else wide)
        if not last:
            rows = saved(rows, "hits")
    return rows


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in small letters, starts and ends of the words, and their number per text."""
    data = lower(data)
    return data, *spans_of(INSIDE[data], offsets)


def _pieces(window: int):
    """Items cut into pieces of words joined by single spaces, overlapping by a window less a word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in text_pieces(batch):
                offsets, data = string_buffer(one.column("text"))
                data, starts, ends, counts = words_of(data, offsets)
                whole, at = data.tobytes(), 0
                found = {"item": [], "words": [], "bytes": []}
                for item, n in zip(one.column("item").to_pylist(), counts.tolist()):
                    words = [whole[a:b] for a, b in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist())]
                    at += n
                    for first in range(0, max(0, n - window) + 1 if n else 0, PIECE_WORDS):
                        joined = b" ".join(words[first : first + PIECE_WORDS + window - 1])
                        found["item"].append(item)
                        found["words"].append(joined)
                        found["bytes"].append(len(joined))
                if found["item"]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found["item"], pa.string()), pa.array(found["words"], pa.binary()), pa.array(found["bytes"], pa.int64())],
                        ["item", "words", "bytes"],
                    )

    return task


@dataclass
class Block:
    """A dictionary, and the distinct windows of some pieces of items.

    Word numbers begin at 1. ``windows`` has one row per window, its words at the right, 0 before
    them. ``named`` lists, from ``begin[w]`` to ``begin[w + 1]``, the places in ``ids`` of the items of window ``w``.
    """

    hashes: np.ndarray  # ascending; words[i] has the number i + 1
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    begin: np.ndarray
    named: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, pieces: list[tuple[str | None, bytes]], window: int) -> Block:
        split = [(item, words.split(b" ")) for item, words in pieces]
        known = sorted({w for _, words in split for w in words})
        lengths = np.array([len(w) for w in known], np.int64)
        text = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        hashes = span_hashes(text, starts, ends) if known else np.zeros(0, np.uint64)
        by = np.argsort(hashes, kind="stable")
        hashes, starts, ends = hashes[by], starts[by], ends[by]
        number = {known[i]: k + 1 for k, i in enumerate(by.tolist())}
        ids = sorted({item for item, _ in split if item is not None})
        place = {item: k for k, item in enumerate(ids)}

        rows, owner = [], []
        for item, words in split:
            line = np.array([number[w] for w in words], np.int32)
            n = min(window, len(line))
            cut = np.lib.stride_tricks.sliding_window_view(line, n)
            rows.append(np.pad(cut, ((0, 0), (window - n, 0))))
            owner.append(np.full(len(cut), place.get(item, -1), np.int64))
        if not rows:
            empty = np.zeros(0, np.int64)
            return cls(hashes, text, starts, ends, np.zeros((0, window), np.int32), empty, np.zeros(1, np.int64), empty, ids)
        windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        owner, which = np.concatenate(owner), which.reshape(-1)
        pairs = np.unique(which[owner >= 0] * (len(ids) + 1) + owner[owner >= 0])
        begin = np.searchsorted(pairs // (len(ids) + 1), np.arange(len(windows) + 1))
        return cls(
            hashes, text, starts, ends, windows, (windows > 0).sum(axis=1), begin, pairs % (len(ids) + 1), ids
        )

    def searched(self) -> np.ndarray:
        """The windows with the first of equal hashes in place of each word, as texts have them."""
        first = np.concatenate([[0], np.searchsorted(self.hashes, self.hashes) + 1])
        return first[self.windows]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the first word of the dictionary with each hash, 0 where there is none."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


class FmIndex:
    """Word numbers (0 ends a stretch) as ranges of suffixes, without the text itself."""

    def __init__(self, text: np.ndarray, most: int):
        n = len(text)
        # The ends of stretches are all different, so no comparison goes beyond one.
        order, _ = suffix_classes(np.where(text == 0, np.arange(n), n + text), np.full(n, n))
        before = np.where(order > 0, text[order - 1], 0)
        self.before = before
        self.tree = WaveletTree(before, max(1, int(most).bit_length()))
        symbols = np.arange(most + 1)
        self.leaf = self.tree.first(symbols)
        self.less = np.searchsorted(np.sort(text), symbols)
        first = np.flatnonzero(np.concatenate([[True], text[:-1] == 0])) if n else np.zeros(0, np.int64)
        start = np.zeros(n, np.int64)
        start[first] = first
        within = np.arange(n) - np.maximum.accumulate(start) if n else start
        marked = (within % SAMPLE == 0)[order]
        self.marked = marked
        self.rank = np.cumsum(marked) - 1
        self.sampled = order[marked]

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place among the suffixes that begin with the symbol, before those from ``at`` on."""
        return self.less[symbols] + self.tree.before(symbols, at) - self.leaf[symbols]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur (rows, their words at the right), and their ranges of suffixes."""
        rows = np.arange(len(windows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.before), np.int64)
        done = []
        for k in reversed(range(windows.shape[1])):
            word = windows[rows, k]
            over = word == 0
            done.append((rows[over], low[over], high[over]))
            rows, low, high, word = rows[~over], low[~over], high[~over], word[~over]
            both = self.step(np.concatenate([word, word]), np.concatenate([low, high]))
            low, high = both[: len(word)], both[len(word) :]
            some = high > low
            rows, low, high = rows[some], low[some], high[some]
        done.append((rows, low, high))
        return tuple(np.concatenate(parts) for parts in zip(*done))

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes at these places begin."""
        out = np.zeros(len(at), np.int64)
        open_, walked = np.arange(len(at)), 0
        while len(open_):
            known = self.marked[at]
            out[open_[known]] = self.sampled[self.rank[at[known]]] + walked
            open_, at = open_[~known], at[~known]
            at = self.step(self.before[at].astype(np.int64), at)
            walked += 1
        return out


def _search(names: list[str], broadcast):
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        for batch in batches:
            for shard in text_pieces(batch, "_text", SHARD_BYTES):
                offsets, data = string_buffer(shard.column("_text"))
                data, starts, ends, counts = words_of(data, offsets)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                hit, pairs = hits(block, data, starts, ends, bounds)
                items: list[list[str]] = [[] for _ in range(len(counts))]
                for row, item in zip(*(x.tolist() for x in pairs)):
                    items[row].append(block.ids[item])
                if "spans" in shard.schema.names:  # what earlier blocks have found
                    _add_spans(hit, shard.column("spans"), bounds)
                    items = [sorted({*new, *old}) for new, old in zip(items, shard.column("items").to_pylist())]
                first, last, found = spans_of(hit, bounds)
                row = np.repeat(np.arange(len(counts)), found)
                spans = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(found)]).astype(np.int32),
                    pa.StructArray.from_arrays([pa.array(first - bounds[row]), pa.array(last - bounds[row])], fields=list(kind)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*(shard.column(c) for c in names), pa.array(counts, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))],
                    [*names, *ADDED],
                )

    return task


def _add_spans(hit: np.ndarray, spans: pa.ListArray, bounds: np.ndarray) -> None:
    flat = spans.flatten()
    sizes = np.diff(np.asarray(spans.offsets))
    base = np.repeat(bounds[:-1], sizes)
    first, last = (np.asarray(flat.field(k)) for k in (0, 1))
    hit[stretches(base + first, last - first)] = True


def hits(
    block: Block, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Which words are hit, and the distinct pairs of text and item, by text, then item."""
    hit = np.zeros(len(starts), bool)
    nothing = hit, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(starts) or not len(block.windows):
        return nothing
    number = block.numbers(span_hashes(data, starts, ends))
    first, last, _ = spans_of(number > 0, bounds)
    enough = last - first >= block.lengths.min()
    first, size = first[enough], (last - first)[enough]
    if not len(first):
        return nothing
    # Each stretch is followed by a 0; word[i] is where text[i] stands.
    word = stretches(first, size + 1)
    text = number[np.minimum(word, len(number) - 1)]
    text[np.cumsum(size + 1) - 1] = 0
    index = FmIndex(text, len(block.hashes))
    window, low, high = index.search(block.searched())
    window = np.repeat(window, high - low)
    at = word[index.locate(stretches(low, high - low))]
    # Equal hashes are not yet equal words.
    sizes = block.lengths[window]
    places, numbers = stretches(at, sizes), block.windows[window]
    numbers = numbers[numbers > 0].astype(np.int64) - 1
    pair, back = np.unique(places * len(block.hashes) + numbers, return_inverse=True)
    place, known = pair // len(block.hashes), pair % len(block.hashes)
    right = same_bytes(data, starts[place], ends[place], block.text, block.starts[known], block.ends[known])
    if not right.all():
        wrong = np.add.reduceat(~right[back], np.cumsum(sizes) - sizes) > 0
        at, window, sizes = at[~wrong], window[~wrong], sizes[~wrong]
    change = np.zeros(len(hit) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + sizes, -1)
    hit = np.cumsum(change[:-1]) > 0
    row = np.searchsorted(bounds, at, side="right") - 1
    seen = np.unique(row * len(block.windows) + window)
    row, window = seen // len(block.windows), seen % len(block.windows)
    many = block.begin[window + 1] - block.begin[window]
    item = block.named[stretches(block.begin[window], many)]
    pairs = np.unique(np.repeat(row, many) * (len(block.ids) + 1) + item)
    return hit, (pairs // (len(block.ids) + 1), pairs % (len(block.ids) + 1))
