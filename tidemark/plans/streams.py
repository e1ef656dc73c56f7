"""The event table read as a stream to its end.

The results hold what was final when the input ended. Their SQL says the same with a
condition on the latest event: it must be at least the watermark's delay past the row.

A table of more than ``FILES_PER_TRIGGER`` part files is taken in steps, so that the state holds
what is open and not the whole input. The results are those of the SQL whatever the order of the part
files: it is measured first, and a table with an event that a step might drop as late is taken in
one step. If the state still dropped late rows, the run ends with a message.
Events without a time cannot be placed in that order and are left out.
"""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exact import as_amount
from tidemark.plans.event_time import (
    HOUR,
    SESSION_GAP,
    SLIDE,
    SLIDE_WIDTH,
    SLIDING_EVENT_COUNTS_SQL,
    TUMBLE,
    TUMBLING_EVENT_COUNTS_SQL,
    USER_SESSIONS_SQL,
    event_sums,
    flat_window,
)
from tidemark.plans.query import Query
from tidemark.session import working_folder
from tidemark.sources.tables import follow_table, read_table
from tidemark.streaming.asof import last_seen_stream
from tidemark.streaming.events import (
    deduplicated_stream,
    matched_stream,
    session_stream,
    sliding_stream,
    tumbling_stream,
)
from tidemark.streaming.run import read_output, run_available, stream_session
from tidemark.streaming.upserts import UpsertTable

DELAY = HOUR
FILES_PER_TRIGGER = 256
STORES_PER_CORE = 2
BUCKETS_PER_STORE = 16


def _step(spark: SparkSession, folder: str, files_per_trigger: int) -> int | None:
    """``files_per_trigger`` if no event can come late in steps of so many files, else none (one step).

    A stream takes files by their time of change, and those of one time in any order. So no event
    may be more than the delay behind one of a file changed earlier or at the same time.
    """
    table = read_table(spark, folder, "events")
    if len(table.inputFiles()) <= files_per_trigger:
        return files_per_trigger
    files = (
        table.filter(F.col("ts").isNotNull())
        .select("ts", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
        .groupBy("file", "changed")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .collect()  # one row per part file
    )
    together = Counter(f["changed"] for f in files)
    spans: dict = {}
    for f in files:
        first, last = spans.get(f["changed"], (f["first"], f["last"]))
        spans[f["changed"]] = (min(first, f["first"]), max(last, f["last"]))
    delay, latest = datetime.timedelta(seconds=DELAY), None
    for changed in sorted(spans):
        first, last = spans[changed]
        before = [t for t in (latest, last if together[changed] > 1 else None) if t is not None]
        if before and first < max(before) - delay:
            return None
        latest = last if latest is None else max(latest, last)
    return files_per_trigger


def _to_end(
    spark: SparkSession, name: str, build: Callable[[SparkSession], DataFrame]
) -> DataFrame:
    # Each state store is opened and saved in every step: two per core, not one per shuffle task.
    stores = min(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        STORES_PER_CORE * spark.sparkContext.defaultParallelism,
    )
    session = stream_session(spark, state_partitions=stores)
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1000000")  # all, for the late rows
    stream = build(session)
    location = working_folder(spark, name)
    query = run_available(stream, location)
    progress = query.recentProgress if query is not None else []
    late = sum(state.numRowsDroppedByWatermark for p in progress for state in p.stateOperators)
    if late:
        raise ValueError(f"{name}: {late} rows came after the watermark had passed them and were dropped")
    return read_output(spark, stream, location)


def stream_tumbling_counts(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    step = _step(spark, folder, files_per_trigger)

    def build(session: SparkSession) -> DataFrame:
        events = follow_table(session, folder, "events", step)
        return flat_window(tumbling_stream(events, DELAY, TUMBLE, ["event_type"], event_sums()))

    return _to_end(spark, "stream_tumbling_counts", build)


def stream_sliding_counts(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    step = _step(spark, folder, files_per_trigger)

    def build(session: SparkSession) -> DataFrame:
        events = follow_table(session, folder, "events", step)
        return flat_window(
            sliding_stream(events, DELAY, SLIDE_WIDTH, SLIDE, ["event_type"], event_sums())
        )

    return _to_end(spark, "stream_sliding_counts", build)


def stream_user_sessions(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    step = _step(spark, folder, files_per_trigger)

    def build(session: SparkSession) -> DataFrame:
        events = follow_table(session, folder, "events", step)
        found = session_stream(events, DELAY, SESSION_GAP, "user_id", event_sums())
        return found.withColumn("total_value", as_amount("total_value", 2))

    return _to_end(spark, "stream_user_sessions", build)


def stream_deduplicated_events(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """The event table delivered twice, as by a source that repeats itself, kept once."""

    step = _step(spark, folder, files_per_trigger)

    def build(session: SparkSession) -> DataFrame:
        first = follow_table(session, folder, "events", step)
        again = follow_table(session, folder, "events", step)
        return deduplicated_stream(first.unionByName(again), DELAY, "event_id")

    return _to_end(spark, "stream_deduplicated_events", build)


MATCH_WITHIN = HOUR


def stream_clicks_before_purchases(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Each purchase with every click of the same user in the hour before it."""
    step = _step(spark, folder, files_per_trigger)

    def build(session: SparkSession) -> DataFrame:
        def of_type(name: str) -> DataFrame:
            events = follow_table(session, folder, "events", step)
            return events.filter(F.col("event_type") == name).select("event_id", "user_id", "ts")

        found = matched_stream(of_type("click"), of_type("purchase"), DELAY, "user_id", MATCH_WITHIN)
        return found.select(
            F.col("then.event_id").alias("purchase_id"),
            F.col("then.user_id").alias("user_id"),
            F.col("then.ts").alias("purchase_ts"),
            F.col("first.event_id").alias("click_id"),
            F.col("first.ts").alias("click_ts"),
        )

    return _to_end(spark, "stream_clicks_before_purchases", build)


STREAM_CLICKS_BEFORE_PURCHASES_SQL = f"""
SELECT p.event_id AS purchase_id, p.user_id, p.ts AS purchase_ts, c.event_id AS click_id, c.ts AS click_ts
FROM events p JOIN events c ON p.user_id = c.user_id
 AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL {MATCH_WITHIN} SECOND
WHERE p.event_type = 'purchase' AND c.event_type = 'click'
"""


LAST_CLICK_WITHIN = 6 * HOUR


def stream_last_click_before_purchase(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Each purchase with the same user's latest click of the six hours before it; null if there is none."""
    step = _step(spark, folder, files_per_trigger)

    def build(session: SparkSession) -> DataFrame:
        events = follow_table(session, folder, "events", step)
        timeline = events.filter(F.col("event_type").isin("click", "purchase")).withColumn(
            "is_click", F.col("event_type") == "click"
        )
        buckets = BUCKETS_PER_STORE * int(session.conf.get("spark.sql.shuffle.partitions"))
        found = last_seen_stream(timeline, DELAY, "user_id", "event_id", "is_click", LAST_CLICK_WITHIN, buckets)
        names = {"id": "purchase_id", "key": "user_id", "at": "purchase_ts", "seen_id": "click_id", "seen_at": "click_ts"}
        return found.withColumnsRenamed(names)

    return _to_end(spark, "stream_last_click_before_purchase", build)


# Final when the watermark is past the millisecond after the purchase's own; it is taken over clicks and purchases.
STREAM_LAST_CLICK_BEFORE_PURCHASE_SQL = f"""
WITH clicks AS (
  SELECT user_id, ts, max(event_id) AS event_id
  FROM events WHERE event_type = 'click' AND ts IS NOT NULL GROUP BY user_id, ts
), purchases AS (
  SELECT * FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL
   AND date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND < (
     SELECT date_trunc('millisecond', max(ts)) FROM events
     WHERE event_type IN ('click', 'purchase') AND user_id IS NOT NULL) - INTERVAL {DELAY} SECOND
), found AS (
  SELECT p.event_id AS purchase_id, p.user_id, p.ts AS purchase_ts, c.event_id AS click_id, c.ts AS click_ts
  FROM purchases p ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts
)
SELECT purchase_id, user_id, purchase_ts,
       CASE WHEN click_ts >= purchase_ts - INTERVAL {LAST_CLICK_WITHIN} SECOND THEN click_id END AS click_id,
       CASE WHEN click_ts >= purchase_ts - INTERVAL {LAST_CLICK_WITHIN} SECOND THEN click_ts END AS click_ts
FROM found
"""


def stream_current_users(
    spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """The latest event of each user, kept up in a table; an error takes the user out until the next event.

    Any order of the part files gives the same table, so it is always taken in steps.
    """
    session = stream_session(spark)
    events = follow_table(session, folder, "events", files_per_trigger).filter(F.col("ts").isNotNull())
    changes = events.select(
        "user_id", "ts", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("is_error")
    )
    table = UpsertTable(working_folder(spark, "current_users"), ["user_id"], ["ts", "event_id"], "is_error")
    table.run_available(changes)
    return table.read(spark, changes.schema).drop("is_error")


STREAM_CURRENT_USERS_SQL = """
WITH placed AS (
  SELECT user_id, ts, event_id, event_type, value, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC NULLS LAST, event_type DESC NULLS LAST, value DESC NULLS LAST
  ) AS place
  FROM events WHERE ts IS NOT NULL
)
SELECT user_id, ts, event_id, event_type, value FROM placed WHERE place = 1 AND event_type IS DISTINCT FROM 'error'
"""


def _final_sql(sql: str, final_at: str) -> str:
    return f"""
SELECT * FROM ({sql}) found
WHERE {final_at} <= (SELECT date_trunc('millisecond', max(ts)) FROM events)
                    - INTERVAL {DELAY} SECOND
"""


QUERIES = [
    Query(
        "stream_tumbling_counts",
        stream_tumbling_counts,
        _final_sql(TUMBLING_EVENT_COUNTS_SQL, "window_end"),
    ),
    Query(
        "stream_sliding_counts",
        stream_sliding_counts,
        _final_sql(SLIDING_EVENT_COUNTS_SQL, "window_end"),
    ),
    Query(
        "stream_user_sessions",
        stream_user_sessions,
        _final_sql(USER_SESSIONS_SQL, f"session_end + INTERVAL {SESSION_GAP} SECOND"),
    ),
    Query("stream_deduplicated_events", stream_deduplicated_events, "SELECT * FROM events WHERE ts IS NOT NULL"),
    Query(
        "stream_clicks_before_purchases", stream_clicks_before_purchases, STREAM_CLICKS_BEFORE_PURCHASES_SQL
    ),
    Query(
        "stream_last_click_before_purchase",
        stream_last_click_before_purchase,
        STREAM_LAST_CLICK_BEFORE_PURCHASE_SQL,
    ),
    Query("stream_current_users", stream_current_users, STREAM_CURRENT_USERS_SQL),
]
