from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from tests.llm.data import awkward, documents, empty
from tidemark.llm import byte_tokens, packing, simple8b, word_lexicon
from tidemark.llm.common import saved
from tidemark.llm.packing import cutting_stock, pack, pieces_of
from tidemark.llm.pretokens import SeenWords
from tidemark.llm.queries import vocabulary
from tidemark.llm.simple8b import read_token_files, write_token_files
from tidemark.llm.word_lexicon import Coder, Merger, Transducer, encode_and_decode

BYTE = vocabulary("byte_bpe_50k.json")
WORD = vocabulary("word_bpe_49k.json")
PARTS = [
    "a", "b", "'s", "'ll", "'", "re", "ve", " ", "  ", "\n", "\t", "\xa0", "\x85", "é", "ñ", "1", "23", "½", ".", "!", "-",
    "中", "ß", "A", "'S", "d", "m", "t", "😀", "é", "ẞ", "<|", "<|endoftext|>", "<|startoftext|>", "ᴀ", "᠎",
    "\x1c", "\x00", "٣", "É", "İ", "Σ", "Ⱥ", "…", "ﬁ", "Å", "가", "가", "the", "ing",
]


def strings(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["", " ", "  ", " a", "a ", "\n's", " 's"] + [
        "".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)
    ]


def encoder():
    return partial(byte_tokens.encode, path=BYTE)


def test_byte_level_ids_are_the_librarys():
    texts = strings(4000, 1)
    ids, counts = byte_tokens.encode(pa.array(texts), BYTE)
    library = byte_tokens.tokenizer(BYTE)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_level_ids_and_texts_are_the_librarys(monkeypatch):
    texts = strings(4000, 2)
    library, merger = word_lexicon.tokenizer(WORD), Merger(WORD)
    known = ["the", "a", "b", "ing", "aing", "thethe", "é", "'s", "'", "!", "中"]
    lexicon = Transducer.compile([w.encode() for w in known], [merger.ids(w.encode()) for w in known])
    monkeypatch.setattr(word_lexicon, "mapped", lambda name: lexicon)
    coder = Coder("none", WORD)
    for text, (ids, decoded) in zip(texts, coder.encode(pa.array(texts))):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, text
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False), text


def test_merges_are_the_librarys_on_words_of_few_letters():
    """Repeats and ties: the leftmost of equal pairs goes first."""
    library, merger = word_lexicon.tokenizer(WORD), Merger(WORD)
    r = random.Random(12)
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for letters in ("a", "ab", "the", "nation", "éß") for _ in range(150)]
    for word in words:
        assert merger.ids(word.encode()) == library.encode(word, add_special_tokens=False).ids, word


def test_a_megabyte_without_a_blank(spark):
    r = random.Random(13)
    long = "".join(r.choice(["an", "er", "the", "tion", "x", "qu", "é"]) for _ in range(450_000))
    assert len(long.encode()) > 1_000_000
    merger = Merger(WORD)
    start = time.perf_counter()
    ids = merger.ids(long.encode())
    assert time.perf_counter() - start < 20  # two seconds or so on an idle machine
    library = word_lexicon.tokenizer(WORD)
    assert ids == library.encode(long, add_special_tokens=False).ids
    rows = [(1, long, "aa"), (2, "short", "aa"), (3, "a" * 1_000_000, "aa")]
    docs = documents(spark, rows)
    coded = {x["doc_id"]: bytes(x["ids"]) for x in encode_and_decode(docs, WORD).collect()}
    for i, text, _ in rows:
        assert np.frombuffer(coded[i], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    by_bytes = byte_tokens.tokenizer(BYTE)
    flat, counts = byte_tokens.encode(pa.array([t for _, t, _ in rows]), BYTE)
    assert flat.tolist() == [x for _, t, _ in rows for x in by_bytes.encode(t, add_special_tokens=False).ids]
    packed = pack(saved(pieces_of(docs, encoder(), 2048, end_id=1), "long-pieces"), 2048)
    assert packed.agg({"length": "sum"}).first()[0] == int(counts.sum()) + len(rows)


@pytest.mark.parametrize("most", [3, 50])
def test_seen_words_may_start_anew(monkeypatch, most):
    monkeypatch.setitem(byte_tokens._seen, BYTE, SeenWords(most))
    texts = ["one two three four five six", "seven eight two one", "nine " * 5, "ten one"]
    library = byte_tokens.tokenizer(BYTE)
    for _ in range(3):
        for text in texts:
            ids, _ = byte_tokens.encode(pa.array([text]), BYTE)
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_transducer_is_minimal_and_exact():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))).encode() for _ in range(300)})
    lexicon = Transducer.compile(words, [[i, i + 1] for i in range(len(words))])
    futures = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    reached = {int(s) for s in lexicon.to} | {0}
    assert len(reached) == len(futures)
    lexicon = Transducer.from_buffer(np.frombuffer(lexicon.to_bytes(), np.uint8))
    asked = [*words, b"x", b"abcabcabc", *(w + b"a" for w in words), *(w[:-1] for w in words if len(w) > 1)]
    ends = np.cumsum([len(w) for w in asked])
    found = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], ends)
    place = {w: i for i, w in enumerate(words)}
    for w, k in zip(asked, found.tolist()):
        assert (k >= 0) == (w in place)
        if k >= 0:
            assert lexicon.ids[lexicon.start[k] : lexicon.start[k + 1]].tolist() == [place[w], place[w] + 1]


def test_word_lexicon_query(spark, data):
    library = word_lexicon.tokenizer(WORD)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = __spark_entry__.queries()["op10_word_lexicon"](spark, data).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_lexicon_on_awkward_rows(spark):
    rows = awkward()
    library = word_lexicon.tokenizer(WORD)
    found = encode_and_decode(documents(spark, rows), WORD)
    assert set(found.columns) >= {"doc_id", "ids", "decoded", "kept", "block"} and "_text" not in found.columns
    got = sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"]) for r in found.collect())
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i or -1, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for trial in range(150):
        n = int(r.integers(0, 4000))
        bits = r.integers(0, 65, n) if trial % 2 else np.full(n, int(r.integers(0, 65)))
        values = r.integers(0, 2**64, n, dtype=np.uint64, endpoint=False) >> np.minimum(64 - bits, 63).astype(np.uint64)
        words, firsts, escaped = simple8b.encode(values)
        assert (simple8b.decode(words, firsts, n, escaped) == values).all()
        assert (escaped >= np.uint64(1 << 60)).all()
    small = r.integers(0, 2, 60 * 1024).astype(np.uint64)
    assert len(simple8b.encode(small)[0]) == 60 * 18  # 17 words of 60 bits and one of 4 in each block


def test_blocks_can_be_decoded_alone():
    values = np.random.default_rng(2).integers(0, 50_000, 5000).astype(np.uint64)
    words, firsts, escaped = simple8b.encode(values)
    part = words[firsts[2] : firsts[3]]
    assert (simple8b.decode(part, np.zeros(1, np.int64), 1024, escaped) == values[2048:3072]).all()


def brute_ids(rows, end: int) -> list[tuple[int, list[int]]]:
    library = byte_tokens.tokenizer(BYTE)
    named = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [(i, [*library.encode(t, add_special_tokens=False).ids, end]) for i, t in named]


@pytest.mark.parametrize("chunk", [50, 1 << 19])
def test_token_files(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(simple8b, "CHUNK_IDS", chunk)
    rows = awkward()
    folder = str(tmp_path / "tokens")
    write_token_files(documents(spark, rows), folder, encoder(), end_id=0)
    found = read_token_files(spark, folder).orderBy("start").collect()
    expected = brute_ids(rows, 0)
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found] == expected
    assert [r["start"] for r in found] == np.cumsum([0] + [len(ids) for _, ids in expected])[:-1].tolist()
    assert all(r["n_tokens"] == len(ids) for r, (_, ids) in zip(found, expected))


def test_token_files_of_nothing(spark, tmp_path):
    write_token_files(empty(spark), str(tmp_path / "tokens"), encoder(), end_id=0)
    assert read_token_files(spark, str(tmp_path / "tokens")).count() == 0


def test_simple8b_query(spark, data):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in __spark_entry__.queries()["op7_simple8b"](spark, data).collect()}
    start = 0
    for i, ids in brute_ids(rows, 0):
        r = found.pop(i)
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not found


def check_packed(rows, found, capacity: int) -> int:
    """Pieces cover every document once, sequences have no gaps; how many sequences there are."""
    library = byte_tokens.tokenizer(BYTE)
    expected, pieces, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t, _ in rows:
        expected[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    cut = defaultdict(list)
    for r in found:
        assert (r["row"] is None) == (r["doc_id"] is not None)
        if r["row"] is not None:
            cut[r["row"]].append((r["start"], r["length"], r["doc_tokens"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(expected)
    for parts in cut.values():  # of one row without an id
        assert sum(length for _, length, _ in parts) == parts[0][2]
    assert len(cut) == len(expected[None] if None in expected else [])
    for i, texts in expected.items():
        want = [
            (k, len(ids[k : k + capacity]), len(ids), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes()))
            for ids in texts for k in range(0, len(ids), capacity)
        ]
        assert sorted(pieces[i]) == sorted(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_awkward_rows(spark, capacity):
    from pyspark.sql import functions as F

    from tidemark.llm.common import saved

    rows = awkward()
    pieces = pieces_of(documents(spark, rows), encoder(), capacity, end_id=1)
    pieces = saved(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    found = pack(pieces, capacity).collect()
    tokens = sum(r["length"] for r in found)
    assert check_packed(rows, found, capacity) <= 1.05 * tokens / capacity + 2


def test_packing_query(spark, data):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = __spark_entry__.queries()["op3_packing"](spark, data).collect()
    n = check_packed(rows, found, 2048)
    assert n <= 1.02 * sum(r["length"] for r in found) / 2048 + 1
    assert {r["sequence_id"] for r in found} == set(range(n))


def test_packing_nothing(spark):
    pieces = pieces_of(empty(spark), encoder(), 128, end_id=1)
    assert pack(pieces, 128).count() == 0


def test_cutting_stock_covers_the_demand():
    r = np.random.default_rng(0)
    for trial in range(12):
        capacity = int(r.integers(5, 120))
        demand = np.zeros(capacity + 1, np.int64)
        sizes = r.integers(1, capacity + 1, int(r.integers(0, 40)))
        demand[sizes] = r.integers(1, 10 ** int(r.integers(1, 6)), len(sizes))
        patterns = cutting_stock(demand)
        places = np.zeros_like(demand)
        for p in patterns:
            assert p.sequences > 0 and sum(size * n for size, n in p.pieces) <= capacity
            for size, n in p.pieces:
                places[size] += n * p.sequences
        assert (places >= demand).all()
        bound = max(-(-int((demand * np.arange(capacity + 1)).sum()) // capacity), int(demand[capacity // 2 + 1 :].sum()))
        n = sum(p.sequences for p in patterns)
        assert n >= bound
        half = int(demand[: capacity // 2 + 1].sum())
        assert n <= 1.25 * bound + len(patterns) + (half > 0)


def test_column_generation_that_ends_early_says_so(monkeypatch, caplog):
    demand = np.zeros(257, np.int64)
    demand[[256, 140, 100, 70, 33, 20, 7]] = [5, 40, 60, 80, 300, 90, 1000]
    whole = cutting_stock(demand)
    assert not caplog.records
    monkeypatch.setattr(packing, "ROUNDS", 0)
    early = cutting_stock(demand)
    assert "column generation ended" in caplog.text
    for patterns in (whole, early):
        held = np.zeros(257, np.int64)
        for pattern in patterns:
            assert sum(size * n for size, n in pattern.pieces) <= 256
            for size, n in pattern.pieces:
                held[size] += n * pattern.sequences
        assert (held >= demand).all()
    least = -(-int((demand * np.arange(257)).sum()) // 256)
    assert sum(p.sequences for p in whole) <= least + 2


def test_knapsack_finds_the_best_pattern():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes, price = np.sort(r.choice(np.arange(2, 12), 4, replace=False)), r.random(4)
        worth, column = packing._knapsack(sizes, price, 20)
        best = 0.0
        for a in np.ndindex(*(20 // s + 1 for s in sizes.tolist())):
            if (np.array(a) * sizes).sum() <= 20:
                best = max(best, float((np.array(a) * price).sum()))
        assert abs(worth - best) < 1e-9 and abs(float((column * price).sum()) - best) < 1e-9
