"""Joins in which neither side repeats the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by_key(rows: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """One row per ``key``, to be joined to a table that has the key once.

    Adding up before the join, partly before the shuffle, leaves a key with very many
    rows as one row. The join on the same key then needs no further shuffle of this side.
    """
    return rows.groupBy(key).agg(*(total.alias(name) for name, total in sums.items()))


def with_match(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """The rows whose key occurs in ``others``, where it may occur any number of times.

    ``rows`` are shuffled by the key as they are, so it should be their primary key.
    """
    return _by_match(rows, key, others, other_key, "left_semi")


def without_match(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """The rows whose key does not occur in ``others``; a null key never occurs.

    As with ``with_match``, the key should be the primary key of ``rows``.
    """
    return _by_match(rows, key, others, other_key, "left_anti")


def _by_match(rows: DataFrame, key: str, others: DataFrame, other_key: str, how: str) -> DataFrame:
    # Distinct keys are found partly before the shuffle, whose partitioning the join reuses.
    keys = others.select(F.col(other_key).alias("_key")).distinct()
    return rows.join(keys, F.col(key) == F.col("_key"), how)
