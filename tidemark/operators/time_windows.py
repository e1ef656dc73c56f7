"""Totals per tumbling and per sliding window."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling_totals(
    events: DataFrame, ts: str, width: int, by: list[str], sums: dict[str, Column]
) -> DataFrame:
    """``sums`` per window of ``width`` seconds; windows are counted from the epoch.

    An event without a time is in no window.
    """
    return (
        events.filter(F.col(ts).isNotNull())
        .groupBy(F.window(ts, f"{width} seconds").alias("window"), *by)
        .agg(*(total.alias(name) for name, total in sums.items()))
    )


def sliding_totals(
    events: DataFrame, ts: str, width: int, slide: int, by: list[str], sums: dict[str, Column]
) -> DataFrame:
    """``sums`` per window of ``width`` seconds that starts every ``slide`` seconds.

    Grouping by a sliding window copies every event into each window that holds it.
    The events are added up per pane first, the longest stretch that no window border
    cuts, and only the panes are copied. ``sums`` must be counts and sums.

    Works on a stream as well: both steps are then stateful, and the first keeps one
    row per pane where the direct form would keep one per window.
    """
    pane = gcd(width, slide)
    panes = tumbling_totals(events, ts, pane, by, sums)
    # The time of a pane lies inside it, and so in the windows that hold all of it.
    at = F.window_time("window")
    return panes.groupBy(
        F.window(at, f"{width} seconds", f"{slide} seconds").alias("window"), *by
    ).agg(*(F.sum(name).alias(name) for name in sums))
