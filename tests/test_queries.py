"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.compare import assert_same
from tidemark.plans import all_queries

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


NAMES = [query.name for query in all_queries()]


def test_every_query_has_sql():
    assert set(NAMES) <= set(__spark_entry__.queries())
    assert set(NAMES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name, folder):
    result = __spark_entry__.queries()[name](spark, folder)
    assert assert_same(result, __spark_entry__.oracle_sql()[name], folder) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
