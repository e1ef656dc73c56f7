"""Encoding and decoding with a word-level BPE vocabulary and a lexicon of frequent words.

The frequent words of a corpus and their ids are compiled into a minimal acyclic transducer: an
automaton in which words share their beginnings and, because states with the same future are one,
also their endings. Its arcs carry how many words lie before them; their sum along a word is the
word's number, and the number points to its ids. The compiled arrays are one file in the shared
folder, which Spark hands to every executor and the workers map into memory.

Words that are not in the lexicon, long ones among them, are merged exactly: the adjacent pair of
lowest rank first, the leftmost of equals. Both results, per distinct word, are remembered by the worker. Texts with
characters that may need normalising, or that may hold special tokens, go through the library.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_tokens import tokenizer
from tidemark.llm.common import saved, string_buffer, text_pieces, with_columns_of
from tidemark.llm.hashing import POINT_VALUES, span_hashes
from tidemark.llm.pretokens import SeenWords, Text, gather, small_letters, word_level
from tidemark.session import working_folder

LEXICON_WORDS = 100_000
WORD_BYTES = 64
HELD_WORDS = 200_000
END = "</w>"


class Merger:
    """Exact merges of the vocabulary, on words as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        letter = byte_letters()
        self.inner = [vocabulary[letter[b]] for b in range(256)]
        self.final = [vocabulary[letter[b] + END] for b in range(256)]
        self.rank, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[a] << 32 | vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        self.names = {i: t.encode() for t, i in vocabulary.items()}

    def ids(self, word: bytes) -> list[int]:
        """The ids of a word: always the adjacent pair of lowest rank, the leftmost of equals, becomes one.

        Pairs wait in a heap by rank and place; the ids are linked to their neighbours. A pair that is gone
        when its turn comes is passed over, so the time grows with n log n in the length of the word.
        """
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.final[word[-1]])
        n, rank, merged = len(ids), self.rank.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [r * n + i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << 32 | b)) is not None]
        heapify(waiting)
        while waiting:
            r, i = divmod(heappop(waiting), n)
            j = after[i]
            if ids[i] < 0 or j == n or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << 32 | ids[k])) is not None:
                    heappush(waiting, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 32 | ids[i])) is not None:
                heappush(waiting, r * n + h)
        return [x for x in ids if x >= 0]


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for the letters from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


class Transducer:
    """The compiled lexicon, as arrays over one block of memory."""

    PARTS = ("arc", "to", "before", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """From distinct words and their ids; words are put in order here."""
        order = sorted(range(len(words)), key=words.__getitem__)
        # A state is a tuple of its arcs and whether a word ends there; equal states are one.
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        count: list[int] = []

        def finished(arcs: list[tuple[int, int]], final: bool) -> int:
            key = (final, *arcs)
            if key not in known:
                known[key] = len(states)
                states.append(key)
                count.append(int(final) + sum(count[t] for _, t in arcs))
            return known[key]

        path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]
        previous = b""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                arcs, final = path.pop()
                path[-1][0].append((previous[len(path) - 1], finished(arcs, final)))

        for i in order:
            word = words[i]
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            close(common)
            path.extend(([], False) for _ in range(len(word) - common))
            path[-1] = (path[-1][0], True)
            previous = word
        close(0)
        root = finished(*path[0])
        # The root becomes state 0, so that a search starts there.
        number = [s + 1 if s != root else 0 for s in range(len(states))]
        arc, to, before = [], [], []
        final = np.zeros(len(states) + 1, np.uint8)
        for s, (ends, *arcs) in enumerate(states):
            final[number[s]] = ends
            passed = int(ends)
            for byte, target in arcs:
                arc.append(number[s] << 8 | byte)
                to.append(number[target])
                before.append(passed)
                passed += count[target]
        by_arc = np.argsort(np.array(arc, np.int64), kind="stable")
        flat = [x for i in order for x in ids[i]]
        return cls(
            {
                "arc": np.array(arc, np.int64)[by_arc],
                "to": np.array(to, np.int32)[by_arc],
                "before": np.array(before, np.int32)[by_arc],
                "final": final,
                "start": np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])]).astype(np.int64),
                "ids": np.array(flat, np.uint32),
            }
        )

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, p)) for p in self.PARTS]
        head = json.dumps([[p.dtype.str, len(p)] for p in parts]).encode()
        out = len(head).to_bytes(8, "little") + head
        for p in parts:
            out += b"\0" * (-len(out) % 8) + p.tobytes()
        return out

    @classmethod
    def from_buffer(cls, block: np.ndarray) -> Transducer:
        size = int(block[:8].view("<u8")[0])
        at, arrays = 8 + size, {}
        for name, (kind, n) in zip(cls.PARTS, json.loads(block[8:at].tobytes())):
            at += -at % 8
            end = at + np.dtype(kind).itemsize * n
            arrays[name] = block[at:end].view(kind)
            at = end
        return cls(arrays)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in the lexicon, or -1; all words take each step together."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.arc):
            return out
        active, state, place, number = (
            np.arange(len(starts)), np.zeros(len(starts), np.int64), starts.copy(), np.zeros(len(starts), np.int64),
        )
        while len(active):
            done = place == ends[active]
            hit = done & (self.final[state] == 1)
            out[active[hit]] = number[hit]
            active, state, place, number = active[~done], state[~done], place[~done], number[~done]
            if not len(active):
                break
            key = (state << 8) | data[place]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            there = self.arc[at] == key
            active, at = active[there], at[there]
            state, place, number = self.to[at].astype(np.int64), place[there] + 1, number[there] + self.before[at]
        return out


def _words(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Small letters, starts and ends of the words, and the texts that are left to the library."""
    low = small_letters()[np.minimum(text.points, 0x10000)]
    rest = text.unsafe_rows(low == 0x10000)
    starts, ends = word_level(text, low)
    return low, starts, ends, rest


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    low = np.where(low == 0x10000, 0xFFFD, low)
    raw = low.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b].decode("utf-32-le").encode() for a, b in zip(starts.tolist(), ends.tolist())]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, ``most`` of them or a few less.

    Words of more than ``WORD_BYTES`` are not among them: every letter of a word is a step of the lexicon.
    How many words there are of each frequency says from which on they are ``most`` at most; only
    those come to the driver. Frequencies are told apart to within five per cent for that.
    """
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counts = saved(
        texts.mapInArrow(_counted, "word binary, n bigint")
        .filter(F.octet_length("word") <= WORD_BYTES)
        .groupBy("word")
        .agg(F.floor(16 * F.log2(F.sum("n"))).alias("level")),
        "word-counts",
    )
    left, lowest = most, None
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        left -= row["count"]
        if left < 0:
            break
        lowest = row["level"]
    if lowest is None:
        return []
    return counts.filter(F.col("level") >= lowest).select("word").toArrow().column("word").to_pylist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for whole in batches:
        for batch in text_pieces(whole):
            low, starts, ends, _ = _words(Text(*string_buffer(batch.column("text"))))
            found, at, n = np.unique(span_hashes(low, starts, ends, POINT_VALUES), return_index=True, return_counts=True)
            place = np.searchsorted(hashes, found)
            old = place < len(hashes)
            old[old] = hashes[place[old]] == found[old]
            counts[place[old]] += n[old]
            new = ~old
            spelled = _spelled(low, starts[at[new]], ends[at[new]])
            order = np.argsort(np.concatenate([hashes, found[new]]), kind="stable")
            words = [*words, *spelled]
            words = [words[i] for i in order.tolist()]
            hashes = np.concatenate([hashes, found[new]])[order]
            counts = np.concatenate([counts, n[new]])[order]
            if len(hashes) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], ["word", "n"])
                hashes, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], ["word", "n"])


def publish(spark: SparkSession, lexicon: Transducer) -> str:
    """Write the compiled lexicon to the shared folder and hand it to all executors; its file name."""
    name = f"lexicon-{uuid.uuid4().hex}"
    where = f"{working_folder(spark, 'lexicon')}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(where)
    out = target.getFileSystem(conf).create(target)
    try:
        out.write(bytearray(lexicon.to_bytes()))
    finally:
        out.close()
    spark.sparkContext.addFile(target.getFileSystem(conf).makeQualified(target).toString())
    return name


@functools.lru_cache(2)
def mapped(name: str) -> Transducer:
    return Transducer.from_buffer(np.memmap(SparkFiles.get(name), np.uint8, "r"))


class Coder:
    """What a worker keeps for one lexicon and vocabulary."""

    def __init__(self, name: str, path: str):
        self.lexicon, self.merger, self.library = mapped(name), merger(path), tokenizer(path)
        self.seen, self.decoded = SeenWords(), []

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word among those seen; new ones are looked up or merged."""
        hashes = span_hashes(low, starts, ends, POINT_VALUES)
        hashes[hashes == 0] = 1
        number = self.seen.find(hashes)
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        new, at = np.unique(hashes[missing], return_index=True)
        if self.seen.n + len(new) > self.seen.most:
            new, at = np.unique(hashes, return_index=True)
            missing = np.arange(len(hashes))
            self.seen, self.decoded = SeenWords(max(len(new), SeenWords().most)), []
        at = missing[at]
        words = _spelled(low, starts[at], ends[at])
        flat = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        known = self.lexicon.find(flat, np.concatenate([[0], end[:-1]]), end)
        ids, lengths = [], np.empty(len(words), np.int64)
        begin = self.lexicon.start
        for i, (word, k) in enumerate(zip(words, known.tolist())):
            one = self.lexicon.ids[begin[k] : begin[k + 1]].tolist() if k >= 0 else self.merger.ids(word)
            ids += one
            lengths[i] = len(one)
            self.decoded.append(b" ".join([self.merger.names[t] for t in one]))
        self.seen.add(new, lengths, np.array(ids, np.uint32))
        return self.seen.find(hashes)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids and the decoded text (UTF-8) of each text of a column without nulls."""
        offsets, data = string_buffer(texts)
        text = Text(offsets, data)
        low, starts, ends, rest = _words(text)
        number = self.numbers(low, starts, ends)
        ids, lengths = gather(self.seen, number)
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.searchsorted(starts, text.first)
        rest = set(rest.tolist())
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if row in rest:
                whole = self.library.encode(texts[row].as_py(), add_special_tokens=False).ids
                yield np.array(whole, np.uint32), self.library.decode(whole, skip_special_tokens=False).encode()
            else:
                decoded = self.decoded
                yield ids[total[a] : total[b]], b" ".join([decoded[n] for n in number[a:b].tolist()])


_coders: dict[tuple[str, str], Coder] = {}


def encode_and_decode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``ids`` (little-endian 32-bit) and ``decoded`` text.

    The lexicon is compiled from the frequent words of the same texts. Null text counts as empty
    and has no ids; every row gets a result; extra columns stay.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("ids", "decoded", "_text")]
    words = frequent_words(docs, text_col)
    exact = merger(vocabulary)
    name = publish(spark, Transducer.compile(words, [exact.ids(w) for w in words]))
    texts = docs.withColumn("_text", F.coalesce(docs[text_col].cast("string"), F.lit("")))
    texts = texts.select(*(docs[c] for c in kept), "_text")
    schema = with_columns_of(texts.drop("_text"), "ids binary, decoded string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (name, vocabulary)
        if key not in _coders:
            _coders.clear()
            _coders[key] = Coder(name, vocabulary)
        for whole in batches:
            for batch in text_pieces(whole, "_text"):
                rows = list(_coders[key].encode(batch.column("_text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in kept),
                        pa.array([i.astype("<u4").tobytes() for i, _ in rows], pa.binary()),
                        pa.array([d for _, d in rows], pa.binary()).cast(pa.string()),
                    ],
                    [*kept, "ids", "decoded"],
                )

    return texts.mapInArrow(task, schema)
