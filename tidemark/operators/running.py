"""Running totals per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.slices import ROWS_PER_TASK, add_carry, in_order, slice_hot_groups


def running_totals(
    rows: DataFrame,
    key: str,
    order: list[str],
    value: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``running_n``, ``running_sum`` and ``running_max`` of ``value`` up to each row.

    ``order`` must be unique per key; rows without a value in it come first. Rows without a key
    are a group of their own. ``value`` should be an integer or a decimal; sums of doubles would
    depend on where a large key was cut. Nulls in it count in ``running_n`` and nowhere else.
    """
    sliced = slice_hot_groups(rows, key, order, rows_per_task)
    so_far = (
        Window.partitionBy(*sliced.by)
        .orderBy(*in_order(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.rows.withColumns(
        {
            "running_n": F.count(F.lit(1)).over(so_far),
            "running_sum": F.sum(value).over(so_far),
            "running_max": F.max(value).over(so_far),
        }
    )
    names = ("running_n", "running_sum", "running_max")
    if sliced.hot is None:  # no key was cut: there is nothing before a slice
        return local.select(*rows.columns, *names)
    earlier = (
        Window.partitionBy(key).orderBy(*sliced.slices).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        sliced.hot.groupBy(*sliced.by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("total"),
            F.max(value).alias("largest"),
        )
        .select(
            *sliced.by,
            F.sum("n").over(earlier).alias("_n"),
            F.sum("total").over(earlier).alias("_sum"),
            F.max("largest").over(earlier).alias("_max"),
        )
    )
    total_type = local.schema["running_sum"].dataType
    return add_carry(local, sliced.by, carry).select(
        *rows.columns,
        (F.col("running_n") + F.coalesce("_n", F.lit(0))).alias("running_n"),
        # Null as long as no value was seen, in earlier slices or in this one.
        F.when(F.col("_sum").isNull(), F.col("running_sum"))
        .when(F.col("running_sum").isNull(), F.col("_sum"))
        .otherwise(F.col("running_sum") + F.col("_sum"))
        .cast(total_type)
        .alias("running_sum"),
        F.greatest("running_max", "_max").alias("running_max"),
    )
