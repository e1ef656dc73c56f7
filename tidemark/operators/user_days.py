"""The days on which users did something, as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.event_time import slot_start

DAY = 24 * 3600


def user_days(
    events: DataFrame,
    event_types: list[str],
    key: str = "user_id",
    ts: str = "ts",
    event_type: str = "event_type",
) -> DataFrame:
    """Each ``key`` and day with an event of these types, with one ``has_<type>`` flag each.

    The rows are the union of the types' sets of user-days, and filters on the flags give
    intersection and difference. Spark's own set operators would read the events once per
    type and shuffle each set twice, the second time for a comparison that lets nulls be
    equal; here the events are read and shuffled once, and nulls are equal as well. An event
    without a time is on no day.
    """
    return (
        events.filter(F.col(event_type).isin(*event_types) & F.col(ts).isNotNull())
        .groupBy(key, slot_start(ts, DAY).alias("day"))
        .agg(*(F.bool_or(F.col(event_type) == t).alias(f"has_{t}") for t in event_types))
    )
