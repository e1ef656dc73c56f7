"""Parquet tables of one data folder, as batch input and as stream input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table stored in ``<folder>/<name>.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def follow_table(
    spark: SparkSession,
    folder: str,
    name: str,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same table as a stream that picks up its part files as they appear.

    The schema comes from the files already there. ``files_per_trigger`` bounds how
    many new files one micro-batch reads; left out, a batch takes all there are.
    """
    reader = spark.readStream.schema(read_table(spark, folder, name).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # Written as a glob because a stream refuses a plain path that is a single file.
    return reader.parquet(f"{folder}/{{{name}}}.parquet")
