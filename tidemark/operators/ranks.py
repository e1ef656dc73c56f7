"""Places of all rows of a table in one order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_totals
from tidemark.operators.slices import ROWS_PER_TASK


def global_ranks(
    rows: DataFrame, order: list[str], tiles: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``place``, from 1, in ascending ``order``, and ``tile``, from 1 to ``tiles``.

    ``order`` must be unique; its columns are numbers, booleans or timestamps without a zone, rows without a
    value come first. Tiles are as even as can be, the larger ones first, as with SQL's ``ntile``.

    The table is cut like one large key: by place between the first and the last value, and again where
    that is uneven. Places within a slice are counted there and the sizes of the slices before are added.
    """
    one = F.pmod(F.xxhash64(order[0]), F.lit(1))  # always 0, and not known to be: the table is one key
    placed = running_totals(rows.withColumn("_all", one), "_all", order, "_all", rows_per_task)
    placed = placed.withColumnRenamed("running_n", "place").drop("_all", "running_sum", "running_max")
    total = rows.groupBy(F.lit(0).alias("_all")).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    small = F.floor(total / tiles)  # rows of the smaller tiles
    larger = total % tiles  # how many tiles have one more
    in_larger = F.col("place") <= larger * (small + 1)
    of_larger = F.ceil(F.col("place") / (small + 1))
    of_smaller = larger + F.ceil((F.col("place") - larger * (small + 1)) / F.greatest(small, F.lit(1)))
    return placed.withColumn("tile", F.when(in_larger, of_larger).otherwise(of_smaller).cast("bigint"))
