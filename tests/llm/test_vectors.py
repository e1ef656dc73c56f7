from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tests.llm.data import smallest_reachable
from tidemark.llm import lattice_dedup
from tidemark.llm.lattice_dedup import NEIGHBOURS, near_vectors, nearest_e8


def brute(rows) -> Counter:
    """Every row is a vector of its own, also where rows share an id."""
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64) / max(abs(y) for y in v)
            unit[k] = x / np.linalg.norm(x)
    links = [
        (a, b) for a in unit for b in unit
        if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    ]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = smallest_reachable(list(range(len(rows))), links)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    return Counter((i, n[k], least[root[k]], least[root[k]] == i) for k, (i, _) in enumerate(rows))


def clustered(n: int, spread: float, seed: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 64))
    return [(i, (centres[i % 12] + spread * r.normal(size=64)).tolist()) for i in range(n)]


def check(spark, rows):
    table = spark.createDataFrame(
        [(i, v, None, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, kept string"
    ).repartition(4)
    assert Counter(tuple(r) for r in near_vectors(table).collect()) == brute(rows)


def test_awkward_vectors(spark):
    rows = clustered(120, 0.15, 1)
    same = rows[0][1]
    rows += [
        (1000, None), (1001, []), (1002, [0.0] * 64), (1003, [None] + same[1:]), (1004, [math.nan] + same[1:]),
        (1005, [math.inf] + same[1:]), (1006, same), (1007, [2 * x for x in same]), (1008, same[:32]),
        (1009, [1.0]), (1010, [3.0]), (1011, [-1.0]), (1012, [1e300] * 64), (1013, [1e-300] * 64),
    ]
    check(spark, rows)


@pytest.mark.parametrize("order", [*permutations(range(4))][::5])
def test_links_of_an_id_with_different_vectors(spark, order):
    """Vectors 2 and 3 have a link each, to different rows of vector 1."""
    r = np.random.default_rng(11)
    a, b = r.normal(size=(2, 64))
    near = [(x + 0.05 * r.normal(size=64)).tolist() for x in (a, b)]
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near[0]), (3, near[1])]
    table = spark.createDataFrame([rows[k] for k in order], "vec_id bigint, embedding array<double>").coalesce(1)
    found = Counter(tuple(x) for x in near_vectors(table).collect())
    assert found == Counter({(1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 1, 1, False): 1}) == brute(rows)


def test_repeated_ids(spark):
    rows = clustered(100, 0.15, 3)
    check(spark, [(i % 37, v) for i, v in rows] + [(500, rows[5][1]), (5, rows[5][1]), (5, rows[6][1])])


@pytest.mark.parametrize("block", [16, 4096])
def test_hot_family_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_dedup, "KEY_BLOCK", block)
    monkeypatch.setattr(lattice_dedup, "FAMILY_BLOCK", block)
    monkeypatch.setattr(lattice_dedup, "AT_ONCE", block // 2)
    r = np.random.default_rng(4)
    centre = r.normal(size=64)
    rows = [(i, (centre + 0.2 * r.normal(size=64)).tolist()) for i in range(90)]
    rows += [(100 + i, centre.tolist()) for i in range(40)]
    check(spark, rows)


def test_recall_near_the_threshold(spark):
    """Pairs with a cosine just above 0.9, each pair alone: at least nine in ten are found."""
    r = np.random.default_rng(7)
    rows = []
    for i in range(300):
        x, z = r.normal(size=64), r.normal(size=64)
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        c = 0.9 + 0.01 * r.random() + 1e-9
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * z).tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = near_vectors(table).collect()
    expected = {i: n for i, n, _, _ in brute(rows)}
    assert all(r["n_links"] <= expected[r["vec_id"]] for r in found)
    assert sum(r["n_links"] for r in found) >= 0.9 * sum(expected.values())


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_nearest_lattice_point():
    r = np.random.default_rng(0)
    points = 3 * r.normal(size=(200, 8))
    near = nearest_e8(points)
    twice = np.rint(2 * near)
    assert (np.abs(2 * near - twice) == 0).all()
    assert all(len({x % 2 for x in row}) == 1 for row in twice.tolist())
    assert (near.sum(axis=1) % 2 == 0).all()
    own = ((points - near) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius
    for v in NEIGHBOURS:
        assert (((points - near - v) ** 2).sum(axis=1) >= own - 1e-9).all()
    assert len(NEIGHBOURS) == 240 and {round(float(v @ v), 6) for v in NEIGHBOURS} == {2.0}
