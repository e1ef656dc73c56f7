from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import smallest_reachable, words
from tidemark.llm import common, golomb, hashing
from tidemark.llm.common import components, join_uneven, local_roots, string_buffer, text_pieces


@given(st.lists(st.integers(0, 2**64 - 1)))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    # A gap many times the mean makes a long unary part; keep it within memory.
    values = values if len(values) < 3 else values >> np.uint64(20)
    assert (golomb.decode(golomb.encode(values)) == values).all()


def test_golomb_is_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 2**40, 100_000).astype(np.uint64))
    assert len(golomb.encode(values)) < 100_000 * 3.4  # 40 bits less the 16.6 of the order, and 1.5


@given(st.lists(st.text(alphabet="aB é\t\n 中", max_size=12)))
@settings(max_examples=100, deadline=None)
def test_shingles_are_those_of_plain_python(texts):
    offsets, data = string_buffer(pa.array(texts, pa.string()))
    hashes, begin = hashing.shingle_hashes(data, offsets, 3)
    known: dict = {}
    for i, text in enumerate(texts):
        w = words(text)
        expected = [tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        found = hashes[begin[i] : begin[i + 1]].tolist()
        assert len(found) == len(expected)
        assert all(known.setdefault(e, f) == f for e, f in zip(expected, found))
    assert len(set(known.values())) == len(known)


def test_hash_pieces_do_not_change_hashes(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    starts = np.arange(0, 5000, 50)
    whole = hashing.span_hashes(data, starts, starts + 50)
    monkeypatch.setattr(hashing, "PIECE", 120)
    assert (hashing.span_hashes(data, starts, starts + 50) == whole).all()


def test_text_pieces_are_bounded_and_complete():
    batch = pa.record_batch([pa.array(["a" * 10, "", "b" * 500, "c", "d" * 30])], ["text"])
    pieces = list(text_pieces(batch, most=32))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [p.num_rows for p in pieces] == [2, 1, 2]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 300)] + [(400, 401)],
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(150)],
        "none": [],
    }[shape]
    r.shuffle(links)
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    found = {row["id"]: row["root"] for row in components(edges).collect()}
    ids = sorted({i for a, b in links if a != b for i in (a, b)})
    assert found == {i: c for i, c in smallest_reachable(ids, links).items()}


@pytest.mark.parametrize("most", [7, 1 << 19])
def test_components_of_few_edges_take_one_step(spark, monkeypatch, most):
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (3, 2), (2, 3)]
    random.Random(3).shuffle(links)
    written = []
    real = common.saved

    def look(frame, purpose, *rows):
        written.append(purpose)
        return real(frame, purpose, *rows)

    monkeypatch.setattr(common, "saved", look)
    monkeypatch.setattr(common, "TASK_EDGES", most)
    edges = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    found = {row["id"]: row["root"] for row in components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}
    assert (len(written) <= 2) == (most > len(links)), written


def test_local_roots():
    r = random.Random(1)
    for _ in range(30):
        links = [(r.randrange(40), r.randrange(40)) for _ in range(r.randrange(40))]
        left, right = (np.array([link[k] for link in links], np.int64) for k in (0, 1))
        assert dict(enumerate(local_roots(40, left, right).tolist())) == smallest_reachable(list(range(40)), links)


def test_join_uneven_keeps_every_row(spark):
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(3000)], "id int, key string"
    )
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key is not null and key <> 'k1'")
    joined = join_uneven(rows, "key", groups, "n", 3000).collect()
    assert sorted(r["id"] for r in joined) == list(range(3000))
    sizes = {r["key"]: r["n"] for r in groups.collect()}
    assert all(r["n"] == sizes.get(r["key"]) for r in joined)
    assert join_uneven(rows, "key", groups, "n", 3_000_000).count() == 3000  # all of them broadcast
