"""Exact numbers of different values per group, and per group of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_rollup(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n_distinct`` values per ``by`` and per each shorter prefix of it; ``level`` as in ``rollup_totals``.

    ``value`` is an integer; nulls do not count. A group's values become distinct first, partly before the
    shuffle, and then bitmaps of 32,768 numbers each. Coarser groups take the union of the bitmaps, so
    nothing is counted again, and a group with very many values is spread over its bitmaps
    until only their counts are added up.
    """
    number = F.col(value).cast("bigint")
    bitmaps = (
        rows.select(*by, number.alias("_value"))
        .distinct()
        .groupBy(*by, F.bitmap_bucket_number("_value").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_value")).alias("_bits"))
    )
    sets = [[*by[:n], "_bucket"] for n in range(len(by) + 1)]
    united = bitmaps.groupingSets(sets, *by, "_bucket").agg(
        F.shiftright(F.grouping_id(), 1).cast("bigint").alias("level"),  # without the bit of the bitmap's number
        F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_n"),
    )
    return united.groupBy(*by, "level").agg(F.sum("_n").cast("bigint").alias("n_distinct"))
