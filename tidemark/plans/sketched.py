"""Daily sketches of the events, kept as a table and merged into weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exact import hundredths
from tidemark.operators.sketches import RANK_ERROR, USERS_ERROR, merged, n_different, quantile, sketched
from tidemark.plans.query import Query
from tidemark.session import working_folder
from tidemark.sources.tables import read_table


def _start_of(unit: str, ts: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def daily_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Per event type and day: events, and sketches of their users and values."""
    events = read_table(spark, folder, "events").select(
        "event_type", _start_of("day", "ts").alias("day"), "user_id", hundredths("value").alias("amount")
    )
    return sketched(events, ["event_type", "day"], "user_id", "amount")


def weekly_users_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Per event type and week: events and users, and whether the merged sketches come close to the exact figures.

    The sketches are a written table of a row per type and day; the weeks come from it alone. The exact
    figures, which the estimates are held against, are counted by value before they meet an estimate.
    """
    stored = working_folder(spark, "daily_sketches")
    daily_sketches(spark, folder).write.parquet(stored)
    week = _start_of("week", "day").alias("week")
    weeks = merged(spark.read.parquet(stored), ["event_type", week]).select(
        F.col("event_type").alias("_type"),
        F.col("week").alias("_week"),
        F.col("n").alias("n_events"),
        n_different().alias("_users"),
        quantile(0.5).alias("_median"),
    )
    events = read_table(spark, folder, "events").select(
        "event_type", _start_of("week", "ts").alias("week"), "user_id", hundredths("value").alias("amount")
    )
    same = F.col("event_type").eqNullSafe(F.col("_type")) & F.col("week").eqNullSafe(F.col("_week"))
    by = ["event_type", "week"]

    users = events.select(*by, "user_id").distinct().groupBy(*by).agg(F.count("user_id").alias("n_users"))
    places = (
        events.groupBy(*by, "amount")
        .agg(F.count("amount").alias("_n"))
        .join(weeks.select("_type", "_week", "_median"), same)
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("_all"),
            F.sum(F.when(F.col("amount") < F.col("_median"), F.col("_n")).otherwise(0)).alias("_below"),
            F.sum(F.when(F.col("amount") <= F.col("_median"), F.col("_n")).otherwise(0)).alias("_until"),
        )
    )
    close = F.abs(F.col("_users") - F.col("n_users")) <= USERS_ERROR * F.col("n_users")
    middle = (F.col("_below") <= (0.5 + RANK_ERROR) * F.col("_all")) & (
        F.col("_until") >= (0.5 - RANK_ERROR) * F.col("_all")
    )
    exact = users.join(places.withColumnsRenamed({"event_type": "_t", "week": "_w"}),
                       F.col("event_type").eqNullSafe(F.col("_t")) & F.col("week").eqNullSafe(F.col("_w")))
    return exact.join(weeks.drop("_median"), same).select(
        *by,
        "n_events",
        "n_users",
        close.alias("users_close"),
        F.when(F.col("_all") > 0, middle).alias("median_close"),
    )


WEEKLY_USERS_SKETCHED_SQL = """
SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
       TRUE AS users_close, CASE WHEN count(value) > 0 THEN TRUE END AS median_close
FROM events GROUP BY ALL
"""


QUERIES = [Query("weekly_users_sketched", weekly_users_sketched, WEEKLY_USERS_SKETCHED_SQL)]
