"""Copies of the given tables bent into harder shapes."""

from __future__ import annotations

from pathlib import Path

import duckdb

# For each variant, the tables it changes and how.
VARIANTS = {
    # A third of all rows on one key, in every table that has keys.
    "hot": {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)"
        " FROM events",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END"
        " AS o_custkey) FROM orders",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN 11 ELSE l_orderkey END"
        " AS l_orderkey) FROM lineitem",
        "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_nationkey END"
        " AS c_nationkey) FROM customer",
    },
    # Many events at the same time, and pauses of exactly whole hours.
    "ties": {
        "events": "SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM events",
    },
    # Events in no order, with negative amounts.
    "shuffled": {
        "events": "SELECT * REPLACE (CAST(CAST(value AS DECIMAL(12,2)) - 100 AS DOUBLE) AS value)"
        " FROM events ORDER BY hash(event_id)",
    },
    # Over a change of the clocks in zones that have one.
    "march": {
        "events": "SELECT * REPLACE (ts + INTERVAL 60 DAY AS ts) FROM events",
    },
    # Events without a time, a user or a value.
    "null_ts": {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 10 > 0 THEN ts END AS ts) FROM events",
    },
    "null_user": {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 10 > 0 THEN user_id END AS user_id)"
        " FROM events",
    },
    "null_value": {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 3 > 0 THEN value END AS value)"
        " FROM events",
    },
    # Half of the events, and all of one user's, at one instant.
    "burst": {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 2 = 0 OR user_id = 7"
        " THEN TIMESTAMP '2024-01-15 12:00:00' ELSE ts END AS ts,"
        " CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events",
    },
    # One user alone.
    "single": {
        "events": "SELECT * REPLACE (3::BIGINT AS user_id) FROM events",
    },
}


def make_variant(name: str, source: str, target: Path) -> str:
    con = duckdb.connect()
    target.mkdir(parents=True)
    for file in sorted(Path(source).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    for table in ("region", "nation", "customer", "orders", "lineitem", "events"):
        sql = VARIANTS[name].get(table, f"SELECT * FROM {table}")
        con.execute(f"COPY ({sql}) TO '{target / table}.parquet' (FORMAT parquet)")
    return str(target)
