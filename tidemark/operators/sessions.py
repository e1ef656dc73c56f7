"""Sessions: runs of a key's events with no long pause between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.event_time import seconds, slot_start


def sessions(
    events: DataFrame,
    key: str,
    ts: str,
    gap: int,
    sums: dict[str, Column],
) -> DataFrame:
    """One row per session of ``key``: first and last event time and the given sums.

    A pause of more than ``gap`` seconds ends a session, as with Spark's
    ``session_window``. ``sums`` are aggregates that can be added up, that is counts and
    sums.

    Two events in the same slot of ``gap`` seconds are less than ``gap`` apart and so
    always share a session. Adding up each slot first, partly before the shuffle, leaves
    at most (time span / gap) rows per key for the window, however many events a key has.
    That is what bounds a task: with a gap of seconds over years a key may have hundreds of
    millions of slots, and ``gap`` should then be longer or the events taken by year.

    An event without a time is in no session. Events without a key are those of one key.
    """
    slots = events.filter(F.col(ts).isNotNull()).groupBy(key, slot_start(ts, gap).alias("_slot")).agg(
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        *(total.alias(name) for name, total in sums.items()),
    )
    in_order = Window.partitionBy(key).orderBy("_slot")
    previous = F.lag("_last").over(in_order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = previous.isNull() | (F.col("_first") > previous + seconds(gap))
    return (
        slots.withColumn("_start", F.when(starts, F.col("_first")))
        .withColumn("session_start", F.last("_start", ignorenulls=True).over(so_far))
        .groupBy(key, "session_start")
        .agg(
            F.max("_last").alias("session_end"),
            *(F.sum(name).alias(name) for name in sums),
        )
    )
