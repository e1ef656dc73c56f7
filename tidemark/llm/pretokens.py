"""Splitting text into pre-tokens, and a table of the ids of those already seen.

The two vocabularies split text by a regular expression before any merge. Here the same split
is computed for a whole batch with numpy from the class of each character: letter, number,
white space, other. The regular expressions, as fixed by the vocabularies:

    byte-level   's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    word-level   's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+  (rest dropped)

Versions of Unicode differ in newer characters, so only characters that were assigned in
Unicode 3.2 and kept their class are taken this way. A text with any other character, or with
``<|`` (which may begin a special token), is left to the library as a whole.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from tidemark.llm.hashing import span_hashes

LETTER, NUMBER, SPACE, OTHER, UNSAFE = range(5)
#: The characters of \\s, and the endings that follow an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

CAN_COMBINE = 3  # a canonical combining class or a composition: normalisation may change the text


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point up to 0xFFFF; the rest is unsafe."""
    old = unicodedata.ucd_3_2_0
    out = np.full(0x10001, UNSAFE, np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000 or c == 0x180E:
            continue
        now, then = unicodedata.category(chr(c)), old.category(chr(c))
        if c in WHITE_SPACE:
            out[c] = SPACE
        elif now[0] == then[0] and then != "Cn":
            out[c] = LETTER if now[0] == "L" else NUMBER if now[0] == "N" else OTHER
    return out


@functools.cache
def small_letters() -> np.ndarray:
    """Each code point's small letter; 0xFFFF + 1 where normalising may do more than that."""
    out = np.full(0x10001, 0x10000, np.uint32)
    for c in range(0x10000):
        if classes()[c] == UNSAFE:
            continue
        one = chr(c)
        low = one.lower()
        simple = (
            unicodedata.normalize("NFC", one) == one
            and unicodedata.combining(one) == 0
            and len(low) == 1
            and ord(low) < 0x10000
            and classes()[ord(low)] != UNSAFE
            and unicodedata.ucd_3_2_0.normalize("NFC", one) == one
            and not 0x1100 <= c < 0x1200
            and unicodedata.category(one) not in ("Mn", "Mc", "Me")
        )
        if simple:
            out[c] = ord(low)
    return out


class Text:
    """The characters of a batch of texts: code points, byte places, and classes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.data, self.offsets = data, offsets
        lead = (data & 0xC0) != 0x80
        if lead.all():
            self.points = data.astype(np.uint32)
            self.place = np.arange(len(data) + 1)
            self.first = offsets
        else:
            raw = data.tobytes().decode("utf-8", errors="replace").encode("utf-32-le")
            self.points = np.frombuffer(raw, np.uint32)
            self.place = np.append(np.flatnonzero(lead), len(data))
            self.first = np.searchsorted(self.place, offsets)
        self.kind = classes()[np.minimum(self.points, 0x10000)]

    def unsafe_rows(self, bad: np.ndarray) -> np.ndarray:
        """The texts with a character marked ``bad``."""
        marker = np.flatnonzero((self.points[:-1] == ord("<")) & (self.points[1:] == ord("|"))) if len(self.points) else []
        at = np.concatenate([np.flatnonzero(bad), marker]).astype(np.int64)
        return np.unique(np.searchsorted(self.first, at, side="right") - 1)


def _starts_of_runs(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(kind)
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    run = text_start[:n].copy()
    if n:
        run[0] = True
        run[1:] |= kind[1:] != kind[:-1]
    return run, text_start


def _contractions(points: np.ndarray, kind: np.ndarray, at: np.ndarray, text_start: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Apostrophes among ``at`` that an ending follows, with the length of both; each at most once."""
    found, n = [], len(points)
    for ending in ENDINGS:
        size = len(ending)
        here = at[at + size < n]
        ok = np.ones(len(here), bool)
        for k, letter in enumerate(ending, 1):
            ok &= (points[here + k] == ord(letter)) & ~text_start[here + k]
        found.append((here[ok], size + 1))
    return found


def byte_level(text: Text) -> np.ndarray:
    """Starts of the pre-tokens, as places in the code points; they cover everything."""
    points, kind = text.points, text.kind
    n = len(points)
    run, text_start = _starts_of_runs(kind, text.first)
    blank = np.zeros(n + 1, bool)
    blank[1:] = points == 0x20
    after_blank = blank[:n] & ~text_start[:n]  # the blank before belongs to this run
    start = run & ((kind == SPACE) | ~after_blank)
    # The last white space before something else stands alone or goes with what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n]) if n else []
    start[last] = True
    quote = np.flatnonzero((points == 0x27) & run & ~after_blank)
    for at, size in _contractions(points, kind, quote, text_start):
        start[at + 1] = False
        end = at + size
        end = end[(end < n)]
        start[end] = True
    return np.flatnonzero(start)


def word_level(text: Text, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens, as places in the code points (already in small letters)."""
    kind = text.kind
    n = len(points)
    run, text_start = _starts_of_runs(kind, text.first)
    start = run | (kind == NUMBER)
    quote = np.flatnonzero((points == 0x27) & run)
    for at, size in _contractions(points, kind, quote, text_start):
        start[at + 1] = False
        end = at + size
        start[end[end < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


class SeenWords:
    """Ids of the words seen by this worker: an open-addressing table from hash to id list.

    It holds at most ``most`` words and starts anew when full, which bounds its memory and
    changes no result.
    """

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.size = 1 << (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros(self.size, np.uint64)
        self.number = np.zeros(self.size, np.int32)
        self.n = 0
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it was not seen."""
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        slot = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        while len(open_):
            there = self.table[slot]
            hit = there == hashes[open_]
            out[open_[hit]] = self.number[slot[hit]]
            go = ~hit & (there != 0)
            open_, slot = open_[go], (slot[go] + 1) & (self.size - 1)
        return out

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New distinct words with their id lists."""
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        number = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.n += len(hashes)
        open_ = np.arange(len(hashes))
        slot = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        while len(open_):
            free = self.table[slot] == 0
            self.table[slot[free]] = hashes[open_[free]]
            won = free & (self.table[slot] == hashes[open_])
            self.number[slot[won]] = number[open_[won]]
            open_, slot = open_[~won], (slot[~won] + 1) & (self.size - 1)


def word_ids(
    seen: SeenWords, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in ``seen`` and of the ids in each; new words go through ``encode``.

    ``encode`` takes a list of byte strings and returns how many ids each has, and all ids.
    """
    hashes = span_hashes(data, starts, ends)
    hashes[hashes == 0] = 1
    number = seen.find(hashes)
    missing = np.flatnonzero(number < 0)
    if len(missing):
        new, at = np.unique(hashes[missing], return_index=True)
        if seen.n and seen.n + len(new) > seen.most:
            seen.clear()
            missing = np.arange(len(hashes))
            new, at = np.unique(hashes, return_index=True)
        at = missing[at]
        whole = data.tobytes()
        lengths, ids = encode([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        if len(new) > seen.most:  # a batch with more distinct words than the table may keep
            seen = SeenWords(len(new))
        seen.add(new, lengths, ids)
        return seen, seen.find(hashes)
    return seen, number


def gather(seen: SeenWords, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of words, and how many each word has."""
    begin = seen.start[number]
    lengths = seen.start[number + 1] - begin
    shift = begin - (np.cumsum(lengths) - lengths)
    return seen.ids[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)], lengths



