"""Sketches of groups that are stored and merged: different values by HLL, quantiles by KLL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 400
#: Errors that a sketch practically never exceeds: five standard errors, and three times KLL's 99 % bound.
USERS_ERROR = 5 * 1.04 / math.sqrt(2**LG_K)
RANK_ERROR = 3 * 2.3 / KLL_K**0.9


def sketched(rows: DataFrame, by: list[str], different: str, number: str) -> DataFrame:
    """One row per ``by``: ``n`` rows, ``different`` values as ``_hll`` and the bigint ``number`` as ``_kll``.

    Nulls count in ``n`` alone; null keys are a group. Each task sketches what it has, so a shuffle moves one
    sketch per task and group, of some ten kilobytes at most, however many rows the group has.
    """
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(different, F.lit(LG_K)).alias("_hll"),
        F.kll_sketch_agg_bigint(number, F.lit(KLL_K)).alias("_kll"),
    )


def merged(table: DataFrame, by: list[Column | str]) -> DataFrame:
    """Rows of ``sketched`` put together into coarser groups, which can be merged again."""
    return table.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("_hll").alias("_hll"),
        F.kll_merge_agg_bigint("_kll").alias("_kll"),
    )


def n_different() -> Column:
    return F.hll_sketch_estimate("_hll")


def quantile(share: float) -> Column:
    """A value whose rank is about ``share``; null where there is no value."""
    some = F.kll_sketch_get_n_bigint("_kll") > 0
    return F.when(some, F.kll_sketch_get_quantile_bigint("_kll", F.lit(share)))
