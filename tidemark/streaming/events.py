"""Streams over the event table.

All of them append a row once the watermark says that it is final. Rows that would
still change when the input ends stay in the state for the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.time_windows import sliding_totals, tumbling_totals


def with_event_time(events: DataFrame, delay: int) -> DataFrame:
    """Set the watermark ``delay`` seconds behind the latest event.

    A watermark needs a timestamp with a time zone; the session's zone, UTC, is taken. Events
    without a time are left out: the watermark can neither wait for them nor pass them.
    """
    return events.filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark(
        "ts", f"{delay} seconds"
    )


def tumbling_stream(
    events: DataFrame, delay: int, width: int, by: list[str], sums: dict[str, Column]
) -> DataFrame:
    return tumbling_totals(with_event_time(events, delay), "ts", width, by, sums)


def sliding_stream(
    events: DataFrame, delay: int, width: int, slide: int, by: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Totals per sliding window, added up from panes.

    An event is late when the watermark has passed its pane. It is then missing from all
    windows, where grouping by the window itself would still count it in the open ones.
    """
    return sliding_totals(with_event_time(events, delay), "ts", width, slide, by, sums)


def session_stream(
    events: DataFrame, delay: int, gap: int, key: str, sums: dict[str, Column]
) -> DataFrame:
    """Sessions of ``key``; one is final when the watermark has passed its end plus ``gap``."""
    window = F.session_window("ts", f"{gap} seconds")
    found = (
        with_event_time(events, delay)
        .groupBy(window.alias("session"), key)
        .agg(F.max("ts").alias("session_end"), *(total.alias(name) for name, total in sums.items()))
    )
    return found.select(
        key,
        F.col("session.start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        *sums,
    )


def matched_stream(first: DataFrame, then: DataFrame, delay: int, key: str, within: int) -> DataFrame:
    """``first`` and ``then`` (whole rows) of every pair of one key with ``then`` at most ``within`` seconds later.

    Both have ``ts`` and the key. The two watermarks and the condition on the times bound both states: a
    row is forgotten when the other side's watermark is past all that could match it. Rows meet by key and by
    slot of ``within`` seconds, the first ones in their own slot and the next, so that a key with very
    many rows is spread over its slots. Rows without a key or a time meet nothing.
    """

    def timed(events: DataFrame, name: str, slots: list[int]) -> DataFrame:
        rows = events.filter(F.col(key).isNotNull())
        rows = with_event_time(rows.withColumn(name, F.struct(*events.columns)), delay)
        slot = F.floor(F.unix_micros("ts") / (within * 1_000_000))
        return rows.select(
            name,
            F.col(key).alias(f"{name}_key"),
            F.col("ts").alias(f"{name}_ts"),
            F.explode(F.array(*(slot + s for s in slots))).alias(f"{name}_slot"),
        )

    a, b = timed(first, "first", [0, 1]), timed(then, "then", [0])
    met = (
        (F.col("first_key") == F.col("then_key"))
        & (F.col("first_slot") == F.col("then_slot"))
        & (F.col("first_ts") <= F.col("then_ts"))
        & (F.col("first_ts") >= F.col("then_ts") - F.expr(f"INTERVAL {within} SECONDS"))
    )
    return a.join(b, met).select("first", "then")


def deduplicated_stream(events: DataFrame, delay: int, key: str) -> DataFrame:
    """Each event once, if its copies arrive within ``delay`` seconds of event time.

    The state forgets a key when the watermark has passed it. Copies are thinned out
    before the shuffle, so that a key with very many of them does not fill one task.
    """
    timed = events.filter(F.col("ts").isNotNull())
    return (
        with_event_time(timed.mapInArrow(_latest_copies(key, "ts"), events.schema), delay)
        .dropDuplicatesWithinWatermark([key])
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    )


#: Rows that a task holds back to find copies among them.
HELD_ROWS = 100_000


def _latest_copies(key: str, ts: str, held_rows: int = HELD_ROWS) -> Callable[[Iterator], Iterator]:
    """Keep one row per key of what a task holds back, over all its Arrow batches.

    It is the one with the latest time: if the watermark has passed that one, it has
    passed the others, and no event gets lost with a copy that came too late. A task hands on
    what it holds when there are ``held_rows`` different keys, so a key with very many copies
    leaves it once per that many others and not once per batch.
    """

    def latest(rows: pa.Table) -> pa.Table:
        numbered = pa.table(
            {"key": rows[key], "ts": rows[ts], "row": pa.array(np.arange(rows.num_rows))}
        )
        kept = (
            numbered.sort_by([("ts", "descending")])
            .group_by("key", use_threads=False)
            .aggregate([("row", "first")])["row_first"]
        )
        return rows.take(kept) if len(kept) < rows.num_rows else rows

    def thin_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = None, 0
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            waiting += batch.num_rows
            # Looked through again only when as much has come as is held.
            if waiting >= max(held_rows // 2, held.num_rows - waiting):
                held, waiting = latest(held), 0
                if held.num_rows >= held_rows:
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from latest(held).to_batches()

    return thin_out
