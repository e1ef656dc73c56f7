"""Subtotals over several grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _totals(sums: dict[str, Column]) -> list[Column]:
    return [total.alias(name) for name, total in sums.items()]


def _finest(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row per combination of ``by``.

    The grouping sets are built from these rows, so that not every input row has to be
    copied once per grouping set.
    """
    return rows.groupBy(*by).agg(*_totals(sums))


def _again(sums: dict[str, Column]) -> list[Column]:
    return [
        F.grouping_id().cast("bigint").alias("level"),
        *(F.sum(name).alias(name) for name in sums),
    ]


def rollup_totals(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals per ``by`` and per each shorter prefix of it, down to the grand total.

    ``sums`` must be counts and sums. ``level`` tells a subtotal from a null in the data:
    it has one bit per column of ``by``, first column highest, set where it was left out.
    """
    return _finest(rows, by, sums).rollup(*by).agg(*_again(sums))


def cube_totals(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Like ``rollup_totals`` for every subset of ``by``."""
    return _finest(rows, by, sums).cube(*by).agg(*_again(sums))


def grouping_set_totals(
    rows: DataFrame, sets: list[list[str]], by: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Like ``rollup_totals`` for the given subsets of ``by``."""
    return _finest(rows, by, sums).groupingSets(sets, *by).agg(*_again(sums))
