"""Set operations that keep repeated rows, as SQL's INTERSECT ALL and EXCEPT ALL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES_AT_ONCE = 100_000


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as it is in both; columns are matched by name, nulls are equal."""
    return _copied(left, right, F.least("_l", "_r"))


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` as many times more than it is in ``right``."""
    return _copied(left, right, F.col("_l") - F.col("_r"))


def _copied(left: DataFrame, right: DataFrame, copies: Column) -> DataFrame:
    """Rows are counted, partly before the one shuffle, and written out again by their counts.

    A row with very many copies leaves the count as pieces of ``COPIES_AT_ONCE``, which are dealt out
    anew, so that no task writes all of them.
    """
    row = F.struct(*(F.col(c) for c in left.columns)).alias("_row")
    sides = left.select(row, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(
        right.select(row, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = sides.groupBy("_row").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    kept = counted.select("_row", copies.alias("_n")).filter("_n > 0")
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES_AT_ONCE)))
    in_piece = F.least(F.lit(COPIES_AT_ONCE), F.col("_n") - F.col("_piece") * COPIES_AT_ONCE)
    dealt = kept.withColumn("_piece", pieces).select("_row", in_piece.cast("int").alias("_n")).hint("rebalance")
    return dealt.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
