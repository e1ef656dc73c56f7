from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import awkward, documents, empty
from tidemark.llm import benchmark_index, queries, word_numbers
from tidemark.llm.benchmark_index import Block, FmIndex, contamination
from tidemark.llm.filter_audit import audit, document_filters, removals, shapley, with_labels
from tidemark.llm.periodic_runs import collapse_runs, find_runs
from tidemark.llm.wavelet import WaveletTree, suffix_classes
from tidemark.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- suffix order and wavelet trees


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 4))
def test_suffix_order(symbols, cut):
    text = np.array(symbols)
    n = len(text)
    bounds = [*range(0, n, -(-n // cut)), n]
    end = np.repeat(bounds[1:], np.diff(bounds))
    order, classes = suffix_classes(text, end)
    # The shorter of two suffixes that agree is the smaller, the later one of equal suffixes.
    key = lambda i: (tuple(text[i : end[i]].tolist()), -i)
    assert order.tolist() == sorted(range(n), key=key)
    for k, rank in enumerate(classes):
        for a in range(n):
            for b in range(a):
                whole = a + (1 << k) <= end[a] and b + (1 << k) <= end[b]
                same = whole and (text[a : a + (1 << k)] == text[b : b + (1 << k)]).all()
                assert (rank[a] == rank[b]) == same


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=50), st.data())
def test_wavelet_tree(values, data):
    numbers = np.array(values, np.int64)
    tree = WaveletTree(numbers, 4)
    low = data.draw(st.integers(0, len(values)))
    high = data.draw(st.integers(low, len(values)))
    bound = data.draw(st.integers(0, 20))
    one = lambda x: np.array([x], np.int64)
    part = sorted(values[low:high])
    assert tree.less(one(low), one(high), one(bound))[0] == sum(v < bound for v in part)
    for k, expected in enumerate(part):
        assert tree.nth(one(low), one(high), one(k))[0] == expected
    for symbol in range(13):
        counted = tree.before(one(symbol), one(high)) - tree.first(one(symbol))
        assert counted[0] == values[:high].count(symbol)


def test_equal_hashes_are_not_equal_words(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc bb", np.uint8)
    starts = np.array([0, 3, 6, 9, 12])
    same = lambda d, s, e, *_: np.zeros(len(s), np.uint64)
    monkeypatch.setattr(word_numbers, "span_hashes", same)
    number, most = word_numbers.numbered(data, starts, starts + 2)
    assert number.tolist() == [0, 1, 0, 2, 1] and most == 3


# ---- op11


def failures_of(text: str | None) -> str:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = "A" if len(words) < 200 else ""
    fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return fails + ("D" if re.search(r"[#$%&*|]", text) else "")


def all_failures(rows: list[tuple]) -> list[str]:
    return [
        failures_of(t) + ("E" if any(j is not None and i is not None and j < i and (u or "") == (t or "") for j, u, *_ in rows) else "")
        for i, t, *_ in rows
    ]


def audited(rows: list[tuple], labels: list[tuple]) -> Counter:
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for (i, _, lang), fails in zip(rows, all_failures(rows)):
        parts[lang or ""].append((i, fails))
    expected = Counter()
    for part, docs in parts.items():
        lines, totals = [], Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in docs)
                totals[f] += len(gone)
                lines.append((
                    part, "".join(order), step, len(left), len(gone), failing - len(gone),
                    sum(d[1] == f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ))
        expected.update((*line, totals[line[1][line[2] - 1]]) for line in lines)
    return expected


def audit_rows(seed: int = 3) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    rows = [*awkward(seed, 80), (500, "AB CD #", "aa"), (501, "AB CD #", "bb"), (502, "AB CD #", None), (503, "AB CD #", "")]
    for i in range(600, 660):
        few = r.random() < 0.5
        words = [r.choice("abcdefghij" if few else "klmnopqrstuvwxyz") * r.randint(1, 3 if few else 40) for _ in range(r.randint(150, 260))]
        rows.append((i, " ".join(words) + r.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]), r.choice(["aa", "bb", None])))
    rows += [(700 + i, "the same", "aa") for i in range(90)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i, *_ in rows if i is not None and r.random() < 0.6]
    return rows, [*labels, (500, 1, 0), (500, 0, 1), (None, 1, 1)]


def test_filter_audit(spark):
    rows, labels = audit_rows()
    marked = document_filters(documents(spark, rows), part=F.col("lang"))
    found = Counter((r["doc_id"], r["part"], "".join(f for f in "ABCDE" if r[f])) for r in marked.collect())
    assert found == Counter((i, lang or "", f) for (i, _, lang), f in zip(rows, all_failures(rows)))
    label = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    flagged = with_labels(marked, label, {"good": F.col("quality") == 1, "bad": F.col("toxic") == 1})
    result = audit(flagged, "ABCDE", {"good_lost": "good", "toxic_lost": "bad"})
    assert Counter(tuple(r) for r in result.collect()) == audited(rows, labels)
    assert audit(flagged.limit(0), "ABCDE", {}).count() == 0
    two = audit(flagged, "AC", {"good_lost": "good"})
    assert two.count() == 4 * flagged.select("part").distinct().count()


def test_filter_audit_query(spark, tmp_path):
    rows, labels = audit_rows(5)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    result = queries.op11_filter_audit(spark, str(tmp_path))
    assert result.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    assert Counter(tuple(r) for r in result.collect()) == audited(rows, labels)
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert queries.op11_filter_audit(spark, f"{tmp_path}/none").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.integers(0, 50), min_size=1 << n, max_size=1 << n)))
def test_shapley_values(fails):
    n = len(fails).bit_length() - 1
    removed = removals(fails)
    assert removed == [sum(c for m, c in enumerate(fails) if m & s) for s in range(1 << n)]
    mean = [Fraction(0)] * n
    orders = list(permutations(range(n)))
    for order in orders:
        before = 0
        for f in order:
            mean[f] += Fraction(removed[before | 1 << f] - removed[before], len(orders))
            before |= 1 << f
    assert shapley(removed) == mean


# ---- op12


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Start, length and period, by comparing all words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def collapsed_of(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(r: random.Random, letters: int) -> list[int]:
    words: list[int] = []
    for _ in range(r.randint(0, 6)):
        part = [r.randrange(letters) for _ in range(r.randint(1, 40))]
        if r.random() < 0.4:
            part = part * r.randint(2, 9) + [r.randrange(letters) for _ in range(r.randint(1, 5))]
        words += (part * 7)[: int(len(part) * r.uniform(1, 6))]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    r = random.Random(seed)
    for _ in range(80):
        texts = [repetitive(r, r.choice([1, 2, 3, 20])) for _ in range(r.randint(1, 4))]
        bounds = np.cumsum([0, *map(len, texts)])
        found = find_runs(np.array([w for t in texts for w in t], np.int64), 20, bounds)
        expected = [(i, *run) for i, text in enumerate(texts) for run in runs_of(text)]
        assert list(zip(*(x.tolist() for x in found))) == expected


def test_runs_of_strings_with_many_repeats():
    fibonacci, thue = ["a", "ab"], [0]
    while len(fibonacci[-1]) < 1000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 1000:
        thue += [1 - x for x in thue]
    for text in (list(fibonacci[-1]), thue, [0] * 999, [0, 1] * 400 + [0], ([0] * 30 + [1]) * 20, ([0, 1] * 20 + [2]) * 9):
        number = np.array([ord(x) if isinstance(x, str) else x for x in text])
        found = find_runs(number, 200, np.array([0, len(text)]))
        assert [x[1:] for x in zip(*(x.tolist() for x in found))] == runs_of(text)


def test_collapse_runs(spark):
    r = random.Random(9)
    rows = awkward()
    names = ["é", "the", "THE", "ß-1", "x" * 50]
    rows += [(900 + i, r.choice([" ", "\n", " \t "]).join(names[w] for w in repetitive(r, 5)), "aa") for i in range(150)]
    rows += [(2000, "a " * 50_000, "aa"), (2001, " ".join(f"w{i % 7919}" for i in range(30_000)), "aa")]
    found = collapse_runs(documents(spark, rows))
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "kept", "score", "block", "runs", "collapsed"}
    expected = Counter()
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i == 2000:
            runs = [(0, 50_000, 1)]
        elif i == 2001:
            runs = [(0, 30_000, 7919)]
        else:
            runs = runs_of(words)
        expected[(i, t, tuple(runs), collapsed_of(words, runs))] += 1
    assert Counter((x["doc_id"], x["text"], tuple(tuple(y) for y in x["runs"]), x["collapsed"]) for x in found.collect()) == expected
    assert collapse_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        collapse_runs(found, shortest=10)


def test_periodic_runs_query(spark):
    docs = read_table(spark, SMALL, "documents").collect()
    expected = Counter()
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_of(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        expected[(
            d["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed_of(words, runs)),
        )] += 1
    result = queries.op12_periodic_runs(spark, SMALL)
    assert result.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = Counter(tuple(r) for r in result.collect())
    assert found == expected
    assert sum(r[1] > 0 for r in found) > 10


# ---- op13


def item_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text: str | None, items: list[tuple], window: int) -> tuple:
    words = item_words(text)
    hit, seen = [False] * len(words), set()
    for item, body in items:
        inner = item_words(body)
        size = min(window, len(inner))
        windows = {tuple(inner[k : k + size]) for k in range(len(inner) - size + 1)} if inner else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit[k : k + size] = [True] * size
                seen.add(item)
    spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if h else "." for h in hit))]
    return len(words), tuple(spans), tuple(sorted(str(x) for x in seen if x is not None))


def leaky(seed: int = 4) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    rows = awkward(seed, 90)
    texts = [t for _, t, _ in rows if t and len(t.split()) > 30]
    items: list[tuple] = [(1, None), (2, ""), (3, "--- !"), (4, "onan"), (None, " ".join(r.choice(texts).split()[5:20])), (5, "ß é-ñ")]
    for k in range(10, 40):
        words = r.choice(texts).split()
        at = r.randrange(len(words) - 15)
        items.append((k, "; ".join(words[at : at + r.randint(3, 25)])))
        body = r.choice(texts).split()
        body[7:7] = words[at : at + r.randint(8, 30)]
        rows.append((1000 + k, " ".join(body).upper(), "aa"))
    items += [(10, items[-1][1]), items[-2], (50, " ".join(r.choice(texts).split() * 40))]
    return rows, items


@pytest.mark.parametrize("window, block_bytes", [(10, 1 << 20), (3, 1 << 20), (10, 3000)])
def test_contamination(spark, window, block_bytes):
    rows, items = leaky()
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    found = contamination(documents(spark, rows), table, window=window, block_bytes=block_bytes)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "kept", "score", "block", "n_words", "spans", "items"}
    expected = Counter((i, t, *contaminated(t, items, window)) for i, t, _ in rows)
    got = Counter(
        (x["doc_id"], x["text"], x["n_words"], tuple(tuple(s) for s in x["spans"]), tuple(x["items"])) for x in found.collect()
    )
    assert got == expected
    assert sum(bool(x[3]) for x in expected) > 20


def test_contamination_of_empty_tables(spark):
    rows, items = leaky()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert contamination(empty(spark), table).count() == 0
    clean = contamination(documents(spark, rows), table.limit(0)).collect()
    assert len(clean) == len(rows) and not any(x["spans"] or x["items"] for x in clean)


def test_contamination_by_words_of_equal_hash(monkeypatch):
    """With a hash that only sees lengths, every find has to be told apart by bytes."""
    def by_length(data, starts, ends, *_):
        return (ends - starts).astype(np.uint64)

    monkeypatch.setattr(benchmark_index, "span_hashes", by_length)
    block = Block.of([("1", b"ab cd ef"), ("2", b"cd ab ef gh"), ("3", b"x")], 3)
    text = np.frombuffer(b"ab cd ef zz cd ab ef y cd cd cd", np.uint8)
    starts, ends, counts = word_numbers.spans_of(benchmark_index.INSIDE[text], np.array([0, len(text)]))
    hit, (row, item) = benchmark_index.hits(block, text, starts, ends, np.array([0, *counts]))
    assert hit.astype(int).tolist() == [1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0]
    assert [block.ids[k] for k in item] == ["1", "2"] and row.tolist() == [0, 0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_finds_every_place(stretches, word):
    text = np.array([x for s in stretches for x in (*s, 0)])
    index = FmIndex(text, 3)
    rows, low, high = index.search(np.array([word]))
    places = index.locate(np.arange(low[0], high[0])) if len(rows) else np.zeros(0, np.int64)
    expected = [k for k in range(len(text)) if text[k : k + len(word)].tolist() == word]
    assert sorted(places.tolist()) == expected


def test_benchmark_index_query(spark):
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SMALL, "benchmark").collect()]
    expected = Counter()
    for d in read_table(spark, SMALL, "documents").collect():
        n, spans, found = contaminated(d["text"], items, 10)
        hit = sum(b - a for a, b in spans)
        expected[(d["doc_id"], n, hit, len(found), sha(",".join(found)), hit > 0)] += 1
    result = queries.op13_benchmark_index(spark, SMALL)
    assert result.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r) for r in result.collect()) == expected
