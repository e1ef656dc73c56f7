"""Joins by interval and band, moving totals, places, distinct counts and multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.event_time import micros_between, seconds
from tidemark.functions.exact import as_amount, hundredths
from tidemark.operators.distinct import distinct_rollup
from tidemark.operators.moving import moving_totals
from tidemark.operators.multisets import except_all, intersect_all
from tidemark.operators.overlaps import ROWS_PER_TASK, Intervals, Points, overlapping, points_in_intervals, within_band
from tidemark.operators.ranks import global_ranks
from tidemark.operators.sessions import sessions
from tidemark.plans.event_time import HOUR
from tidemark.plans.query import Query
from tidemark.sources.tables import read_table

AROUND = HOUR
LONG_PAUSE = 12 * HOUR
DAY = 24 * HOUR
PRICE_BAND = 500
TILES = 10


def _events_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return read_table(spark, folder, "events").filter(F.col("event_type") == kind)


def errors_around_purchases(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each purchase with each error of the same user within an hour before or after it."""
    purchases = _events_of(spark, folder, "purchase").select(
        "event_id", "user_id", "ts", (F.col("ts") - seconds(AROUND)).alias("start"), (F.col("ts") + seconds(AROUND)).alias("end")
    )
    errors = _events_of(spark, folder, "error").select("event_id", "user_id", "ts")
    found = points_in_intervals(
        Points(errors, "user_id", "ts"), Intervals(purchases, "user_id", "start", "end"), rows_per_task=rows_per_task
    )
    return found.select(
        F.col("interval.event_id").alias("purchase_id"),
        F.col("interval.user_id").alias("user_id"),
        F.col("interval.ts").alias("purchase_ts"),
        F.col("point.event_id").alias("error_id"),
        F.col("point.ts").alias("error_ts"),
    ).withColumn("micros_after_purchase", micros_between("purchase_ts", "error_ts"))


ERRORS_AROUND_PURCHASES_SQL = f"""
SELECT p.event_id AS purchase_id, p.user_id, p.ts AS purchase_ts, e.event_id AS error_id, e.ts AS error_ts,
       date_diff('microsecond', p.ts, e.ts) AS micros_after_purchase
FROM events p JOIN events e ON p.user_id = e.user_id
 AND e.ts BETWEEN p.ts - INTERVAL {AROUND} SECOND AND p.ts + INTERVAL {AROUND} SECOND
WHERE p.event_type = 'purchase' AND e.event_type = 'error'
"""


def overlapping_sessions(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Sessions of a user's clicks and of the same user's errors that overlap, and for how long.

    A pause of more than half a day ends a session.
    """

    def of(kind: str) -> Intervals:
        found = sessions(_events_of(spark, folder, kind), "user_id", "ts", LONG_PAUSE, {"n": F.count(F.lit(1))})
        return Intervals(found, "user_id", "session_start", "session_end")

    pairs = overlapping(of("click"), of("error"), rows_per_task)
    return pairs.select(
        F.col("left.user_id").alias("user_id"),
        F.col("left.session_start").alias("click_start"),
        F.col("left.session_end").alias("click_end"),
        F.col("left.n").alias("n_clicks"),
        F.col("right.session_start").alias("error_start"),
        F.col("right.session_end").alias("error_end"),
        F.col("right.n").alias("n_errors"),
        F.greatest("left.session_start", "right.session_start").alias("_from"),
        F.least("left.session_end", "right.session_end").alias("_to"),
    ).withColumn("overlap_micros", micros_between("_from", "_to")).drop("_from", "_to")


def _sessions_sql(kind: str) -> str:
    return f"""
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
    SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM (
      SELECT user_id, ts,
             CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {LONG_PAUSE} SECOND
                  THEN 0 ELSE 1 END AS starts
      FROM events WHERE ts IS NOT NULL AND event_type = '{kind}') marked) numbered
  GROUP BY user_id, session_no
"""


OVERLAPPING_SESSIONS_SQL = f"""
WITH c AS ({_sessions_sql("click")}), e AS ({_sessions_sql("error")})
SELECT c.user_id, c.first AS click_start, c.last AS click_end, c.n AS n_clicks,
       e.first AS error_start, e.last AS error_end, e.n AS n_errors,
       date_diff('microsecond', greatest(c.first, e.first), least(c.last, e.last)) AS overlap_micros
FROM c JOIN e ON c.user_id = e.user_id AND c.first <= e.last AND e.first <= c.last
"""


def orders_in_price_band(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Pairs of orders of one customer whose prices differ by at most 500, the smaller key first."""
    orders = read_table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", hundredths("o_totalprice").alias("price")
    )
    side = Points(orders, "o_custkey", "price")
    found = within_band(side, side, 100 * PRICE_BAND, rows_per_task)
    return found.filter("left.o_orderkey < right.o_orderkey").select(
        F.col("left.o_custkey").alias("o_custkey"),
        F.col("left.o_orderkey").alias("order_a"),
        F.col("right.o_orderkey").alias("order_b"),
        as_amount(F.col("right.price") - F.col("left.price"), 2).alias("difference"),
    )


ORDERS_IN_PRICE_BAND_SQL = f"""
WITH o AS (SELECT o_custkey, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,5)) AS DECIMAL(18,2)) AS price FROM orders)
SELECT a.o_custkey, a.o_orderkey AS order_a, b.o_orderkey AS order_b, CAST(b.price - a.price AS DOUBLE) AS difference
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND b.price BETWEEN a.price - {PRICE_BAND} AND a.price + {PRICE_BAND}
"""


def moving_day_per_user(spark: SparkSession, folder: str) -> DataFrame:
    """For each user and time of an event: events of the last 24 hours, their value and the largest one."""
    events = read_table(spark, folder, "events").select("user_id", "ts", hundredths("value").alias("amount"))
    found = moving_totals(events, "user_id", "ts", DAY, "amount")
    return found.select(
        "user_id",
        "ts",
        F.col("n").alias("n_now"),
        F.col("moving_n").alias("day_n"),
        as_amount("moving_sum", 2).alias("day_value"),
        as_amount("moving_max", 2).alias("day_max"),
    )


MOVING_DAY_PER_USER_SQL = f"""
SELECT DISTINCT user_id, ts,
       count(*) OVER (PARTITION BY user_id, ts) AS n_now,
       count(*) OVER last_day AS day_n,
       CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) OVER last_day AS DECIMAL(38,2)) AS DOUBLE) AS day_value,
       CAST(CAST(max(CAST(value AS DECIMAL(18,6))) OVER last_day AS DECIMAL(38,2)) AS DOUBLE) AS day_max
FROM events WHERE ts IS NOT NULL
WINDOW last_day AS (PARTITION BY user_id ORDER BY ts
                    RANGE BETWEEN INTERVAL {DAY} SECOND PRECEDING AND CURRENT ROW)
"""


def customers_by_balance(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The place and the tenth of each customer among all, by balance."""
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return global_ranks(customers, ["c_acctbal", "c_custkey"], TILES, rows_per_task)


CUSTOMERS_BY_BALANCE_SQL = f"""
SELECT c_custkey, c_acctbal, row_number() OVER by_balance AS place, ntile({TILES}) OVER by_balance AS tile
FROM customer
WINDOW by_balance AS (ORDER BY c_acctbal NULLS FIRST, c_custkey NULLS FIRST)
"""


def distinct_users(spark: SparkSession, folder: str) -> DataFrame:
    """Different users per event type and day, per event type, and in all."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    events = read_table(spark, folder, "events").select("event_type", day, "user_id")
    return distinct_rollup(events, ["event_type", "day"], "user_id")


DISTINCT_USERS_SQL = """
SELECT event_type, day, CAST(GROUPING(event_type, day) AS BIGINT) AS level,
       count(DISTINCT user_id) AS n_distinct
FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, user_id FROM events)
GROUP BY ROLLUP (event_type, day)
"""


def _user_days_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return _events_of(spark, folder, kind).select("user_id", day)


def purchases_matched_by_errors(spark: SparkSession, folder: str) -> DataFrame:
    """User and day of each purchase that has an error of its own on that day, as often as there are both."""
    return intersect_all(_user_days_of(spark, folder, "purchase"), _user_days_of(spark, folder, "error"))


def purchases_beyond_errors(spark: SparkSession, folder: str) -> DataFrame:
    """User and day of the purchases that are more than the errors of that day."""
    return except_all(_user_days_of(spark, folder, "purchase"), _user_days_of(spark, folder, "error"))


def _multiset_sql(set_operator: str) -> str:
    return f"""
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = 'purchase'
{set_operator} ALL
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = 'error'
"""


QUERIES = [
    Query("errors_around_purchases", errors_around_purchases, ERRORS_AROUND_PURCHASES_SQL),
    Query("overlapping_sessions", overlapping_sessions, OVERLAPPING_SESSIONS_SQL),
    Query("orders_in_price_band", orders_in_price_band, ORDERS_IN_PRICE_BAND_SQL),
    Query("moving_day_per_user", moving_day_per_user, MOVING_DAY_PER_USER_SQL),
    Query("customers_by_balance", customers_by_balance, CUSTOMERS_BY_BALANCE_SQL),
    Query("distinct_users", distinct_users, DISTINCT_USERS_SQL),
    Query("purchases_matched_by_errors", purchases_matched_by_errors, _multiset_sql("INTERSECT")),
    Query("purchases_beyond_errors", purchases_beyond_errors, _multiset_sql("EXCEPT")),
]
