"""Event-time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(n: int) -> Column:
    """An interval of ``n`` seconds, to add to or take from a timestamp."""
    return F.make_dt_interval(secs=F.lit(n))


def slot_start(ts: str, width: int) -> Column:
    """Start of the slot of ``width`` seconds, counted from the epoch, that holds ``ts``."""
    return F.window(ts, f"{width} seconds")["start"]


def micros_between(earlier: str, later: str) -> Column:
    """Microseconds between two timestamps without a time zone.

    Taken from their interval: the functions that return a number go through the session's
    time zone and are an hour off when the clocks change.
    """
    return _micros(F.col(later) - F.col(earlier))


def micros_since_epoch(ts: str) -> Column:
    """A timestamp without a time zone as microseconds since 1970, taken in the same way."""
    return _micros(F.col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _micros(pause: Column) -> Column:
    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), pause)

    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")
