"""The first rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with their ``rank`` from 1.

    ``order`` must be unique per group for the result to be the same every time. The
    filter on the rank lets Spark keep only ``k`` rows per group and input task before
    the shuffle, so a large group does not arrive in one task as a whole. Spark does so
    up to the ``k`` of ``spark.sql.optimizer.windowGroupLimitThreshold``. Beyond it, or where
    that is switched off, a group's rows are dealt into parts by a hash and the first ``k``
    of each part ranked before the group is, which then has ``k`` rows per part.
    """
    spark = rows.sparkSession
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if k > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in rows.columns)), F.lit(parts))
        in_part = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
        rows = (
            rows.withColumn("_part", part)
            .withColumn("_rank", in_part)
            .filter(F.col("_rank") <= k)
            .drop("_part", "_rank")
        )
    return rows.withColumn("rank", ranked).filter(F.col("rank") <= k)
