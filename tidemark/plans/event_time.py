"""Queries over the event table, read as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.event_time import micros_between
from tidemark.functions.exact import as_amount, hundredths
from tidemark.operators.asof import last_seen
from tidemark.operators.running import running_totals
from tidemark.operators.sessions import sessions
from tidemark.operators.slices import ROWS_PER_TASK
from tidemark.operators.subtotals import rollup_totals
from tidemark.operators.time_windows import sliding_totals, tumbling_totals
from tidemark.operators.user_days import user_days
from tidemark.plans.query import Query
from tidemark.sources.tables import read_table

HOUR = 3600
TUMBLE = 6 * HOUR
SLIDE_WIDTH = 24 * HOUR
SLIDE = 6 * HOUR
SESSION_GAP = 2 * HOUR


def event_sums() -> dict[str, Column]:
    # Values are small: a bigint holds their sum over 10^14 events.
    return {"n_events": F.count(F.lit(1)), "total_value": F.sum(hundredths("value"))}


EVENT_SUMS_SQL = """count(*) AS n_events,
       CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(38,2)) AS DOUBLE) AS total_value"""


def running_value_per_user(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    events = read_table(spark, folder, "events").select(
        "event_id", "user_id", "ts", hundredths("value").alias("amount")
    )
    return running_totals(
        events, "user_id", ["ts", "event_id"], "amount", rows_per_task
    ).select(
        "event_id",
        "user_id",
        "ts",
        "running_n",
        as_amount("running_sum", 2).alias("running_value"),
        as_amount("running_max", 2).alias("running_max"),
    )


RUNNING_VALUE_PER_USER_SQL = """
SELECT event_id, user_id, ts,
       count(*) OVER so_far AS running_n,
       CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) OVER so_far AS DECIMAL(38,2)) AS DOUBLE) AS running_value,
       CAST(CAST(max(CAST(value AS DECIMAL(18,6))) OVER so_far AS DECIMAL(38,2)) AS DOUBLE) AS running_max
FROM events
WINDOW so_far AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def flat_window(totals: DataFrame) -> DataFrame:
    """Window bounds and value as plain columns; the bounds without a time zone."""
    others = [c for c in totals.columns if c not in ("window", "total_value")]
    return totals.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        *others,
        as_amount("total_value", 2).alias("total_value"),
    )


def tumbling_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return flat_window(tumbling_totals(events, "ts", TUMBLE, ["event_type"], event_sums()))


def sliding_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return flat_window(
        sliding_totals(events, "ts", SLIDE_WIDTH, SLIDE, ["event_type"], event_sums())
    )


TUMBLING_EVENT_COUNTS_SQL = f"""
SELECT window_start, window_start + INTERVAL {TUMBLE} SECOND AS window_end, event_type,
       {EVENT_SUMS_SQL}
FROM (SELECT *, time_bucket(INTERVAL {TUMBLE} SECOND, ts) AS window_start FROM events
      WHERE ts IS NOT NULL)
GROUP BY window_start, event_type
"""
SLIDING_EVENT_COUNTS_SQL = f"""
SELECT window_start, window_start + INTERVAL {SLIDE_WIDTH} SECOND AS window_end, event_type,
       {EVENT_SUMS_SQL}
FROM (SELECT *, time_bucket(INTERVAL {SLIDE} SECOND, ts)
             - unnest(range({SLIDE_WIDTH // SLIDE})) * INTERVAL {SLIDE} SECOND AS window_start
      FROM events WHERE ts IS NOT NULL)
GROUP BY window_start, event_type
"""


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return sessions(events, "user_id", "ts", SESSION_GAP, event_sums()).withColumn(
        "total_value", as_amount("total_value", 2)
    )


USER_SESSIONS_SQL = f"""
WITH marked AS (
  SELECT user_id, ts, value,
         CASE WHEN ts - lag(ts) OVER w <= INTERVAL {SESSION_GAP} SECOND THEN 0 ELSE 1 END AS starts
  FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (
  -- Up to and with all events of the same time, in whatever order they were marked.
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session_no
  FROM marked
)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end,
       {EVENT_SUMS_SQL}
FROM numbered GROUP BY user_id, session_no
"""


def last_click_before_purchase(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each purchase with the user's latest click at or before it; null if there is none."""
    timeline = (
        read_table(spark, folder, "events")
        .filter(F.col("event_type").isin("click", "purchase"))
        .select(
            "user_id",
            "ts",
            "event_id",
            (F.col("event_type") == "click").alias("is_click"),
            # Orders a click before a purchase at the same time.
            (F.col("event_type") == "purchase").alias("is_purchase"),
        )
    )
    order = ["ts", "is_purchase", "event_id"]
    return (
        last_seen(timeline, "user_id", order, "is_click", ["event_id", "ts"], rows_per_task)
        .filter("is_purchase")
        .select(
            F.col("event_id").alias("purchase_id"),
            "user_id",
            F.col("ts").alias("purchase_ts"),
            F.col("seen.event_id").alias("click_id"),
            F.col("seen.ts").alias("click_ts"),
        )
        .withColumn("micros_since_click", micros_between("click_ts", "purchase_ts"))
    )


LAST_CLICK_BEFORE_PURCHASE_SQL = """
WITH clicks AS (
  SELECT user_id, ts, max(event_id) AS event_id
  FROM events WHERE event_type = 'click' AND ts IS NOT NULL GROUP BY user_id, ts
), purchases AS (
  SELECT * FROM events WHERE event_type = 'purchase'
)
SELECT p.event_id AS purchase_id, p.user_id, p.ts AS purchase_ts,
       c.event_id AS click_id, c.ts AS click_ts,
       date_diff('microsecond', c.ts, p.ts) AS micros_since_click
FROM purchases p ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts
"""


def props_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per event type and ``k`` of the JSON properties, with subtotals.

    A ``k`` that is no whole number of up to nine digits counts as none.
    """
    k = F.get_json_object("props", "$.k")
    whole = F.when(k.rlike("^-?[0-9]{1,9}$"), k).cast("int")
    events = read_table(spark, folder, "events").select("event_type", whole.alias("k"), "value")
    return rollup_totals(events, ["event_type", "k"], event_sums()).withColumn(
        "total_value", as_amount("total_value", 2)
    )


PROPS_ROLLUP_SQL = f"""
SELECT event_type, k, CAST(GROUPING(event_type, k) AS BIGINT) AS level,
       {EVENT_SUMS_SQL}
FROM (SELECT event_type, value,
             CAST(CASE WHEN regexp_full_match(props->>'$.k', '-?[0-9]{{1,9}}')
                       THEN props->>'$.k' END AS INTEGER) AS k
      FROM events)
GROUP BY ROLLUP (event_type, k)
"""


def _purchase_error_days(spark: SparkSession, folder: str) -> DataFrame:
    return user_days(read_table(spark, folder, "events"), ["purchase", "error"])


def user_days_purchase_and_error(spark: SparkSession, folder: str) -> DataFrame:
    days = _purchase_error_days(spark, folder)
    return days.filter("has_purchase AND has_error").select("user_id", "day")


def user_days_purchase_no_error(spark: SparkSession, folder: str) -> DataFrame:
    days = _purchase_error_days(spark, folder)
    return days.filter("has_purchase AND NOT has_error").select("user_id", "day")


def user_days_purchase_or_error(spark: SparkSession, folder: str) -> DataFrame:
    return _purchase_error_days(spark, folder).select("user_id", "day")


def _user_days_sql(set_operator: str) -> str:
    return f"""
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events
WHERE event_type = 'purchase' AND ts IS NOT NULL
{set_operator}
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events
WHERE event_type = 'error' AND ts IS NOT NULL
"""


QUERIES = [
    Query("running_value_per_user", running_value_per_user, RUNNING_VALUE_PER_USER_SQL),
    Query("tumbling_event_counts", tumbling_event_counts, TUMBLING_EVENT_COUNTS_SQL),
    Query("sliding_event_counts", sliding_event_counts, SLIDING_EVENT_COUNTS_SQL),
    Query("user_sessions", user_sessions, USER_SESSIONS_SQL),
    Query(
        "last_click_before_purchase", last_click_before_purchase, LAST_CLICK_BEFORE_PURCHASE_SQL
    ),
    Query("props_rollup", props_rollup, PROPS_ROLLUP_SQL),
    Query(
        "user_days_purchase_and_error", user_days_purchase_and_error, _user_days_sql("INTERSECT")
    ),
    Query("user_days_purchase_no_error", user_days_purchase_no_error, _user_days_sql("EXCEPT")),
    Query("user_days_purchase_or_error", user_days_purchase_or_error, _user_days_sql("UNION")),
]
