"""The SQL of operators 9, 12 and 13 on awkward rows, where the given tables hold none."""

from __future__ import annotations

import random

import pytest

from tests.compare import assert_same
from tests.llm.data import awkward, documents
from tidemark.llm import queries

NAMES = ["op9_suffix_dedup", "op12_periodic_runs", "op13_benchmark_index"]


def periodic(n: int) -> list[tuple]:
    r = random.Random(5)
    rows = []
    for i in range(n):
        period = [r.choice("abcd") for _ in range(r.randint(1, 25))]
        body = [r.choice("abcd") for _ in range(r.randint(0, 30))] + period * r.randint(1, 9) + period[: r.randint(0, 9)]
        rows.append((10_000 + i, " ".join(body + body[::-1][: r.randint(0, 40)]), "aa"))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("awkward")
    rows = [row for row in awkward() if row[0] is not None] + periodic(60)
    documents(spark, rows).coalesce(1).toPandas().to_parquet(f"{base}/documents.parquet")
    texts = [t for _, t, _ in rows if t]
    items = [(i, " ".join(texts[7 * i].split()[2 : 2 + k])) for i, k in enumerate([1, 3, 9, 10, 11, 14, 25])]
    items += [(40, None), (41, ""), (42, "!!!"), (43, "not there at all"), (1, items[3][1])]
    spark.createDataFrame(items, "item_id bigint, text string").toPandas().to_parquet(f"{base}/benchmark.parquet")
    return str(base)


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, folder, name):
    assert assert_same(queries.QUERIES[name](spark, folder), queries.ORACLE_SQL[name], folder) > 150


def test_the_rows_hold_what_they_should(spark, folder):
    found = queries.op12_periodic_runs(spark, folder)
    assert found.filter("n_runs > 0").count() > 20
    assert queries.op9_suffix_dedup(spark, folder).filter("n_removed > 0").count() > 20
    assert queries.op13_benchmark_index(spark, folder).filter("contaminated").count() > 5
