"""Streams fed file by file: late events, repeated events and runs broken off."""

from __future__ import annotations

import datetime
import time
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from tidemark.plans import streams as streams_module
from tidemark.plans.event_time import HOUR, SESSION_GAP, TUMBLE, event_sums, flat_window
from tidemark.sources.tables import follow_table
from tidemark.streaming.events import (
    _latest_copies,
    deduplicated_stream,
    matched_stream,
    session_stream,
    sliding_stream,
    tumbling_stream,
)
from tidemark.streaming.run import read_output, run_available, start_available, stream_session


class Feed:
    """A folder with an event table that grows by one part file at a time."""

    def __init__(self, base: Path, source: str):
        self.folder = str(base)
        self.parts = base / "events.parquet"
        self.parts.mkdir(parents=True)
        self.con = duckdb.connect()
        self.con.execute(f"CREATE TABLE given AS SELECT * FROM '{source}/events.parquet'")
        self.con.execute("CREATE TABLE sent AS SELECT * FROM given LIMIT 0")
        self.n = 0

    def send(self, sql: str) -> None:
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE part AS {sql}")
        self.con.execute("INSERT INTO sent SELECT * FROM part")
        self.con.execute(
            f"COPY part TO '{self.parts / f'part-{self.n:04d}.parquet'}' (FORMAT parquet)"
        )
        self.n += 1


@pytest.fixture
def feed(tmp_path, data):
    return Feed(tmp_path / "data", data)


@pytest.fixture
def streams(spark):
    return stream_session(spark)


def rows(spark, stream, location) -> Counter:
    found = read_output(spark, stream, location)
    columns = sorted(found.columns)
    return Counter(tuple(row[c] for c in columns) for row in found.collect())


def counts_by_type(spark, stream, location) -> dict:
    found = read_output(spark, stream, location).collect()
    assert len({(r.window_start, r.event_type) for r in found}) == len(found)
    return {(r.window_start, r.event_type): r.n_events for r in found}


def expected_counts(feed, table: str, before: str) -> dict:
    sql = f"""
    SELECT time_bucket(INTERVAL {TUMBLE} SECOND, ts) AS start, event_type, count(*)
    FROM {table} WHERE start + INTERVAL {TUMBLE} SECOND <= {before} GROUP BY ALL
    """
    return {(start, kind): n for start, kind, n in feed.con.sql(sql).fetchall()}


def test_stream_session_keeps_the_callers_settings(spark):
    name = "spark.sql.streaming.stateStore.minDeltasForSnapshot"
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    spark.conf.set(name, "17")
    try:
        session = stream_session(spark)
        assert session.conf.get(name) == "17"
        assert session.conf.get(merge) == "true" and spark.conf.get(merge) == "false"
        assert session.conf.get("spark.sql.shuffle.partitions") == "8"
        spark.conf.set(merge, "false")
        assert stream_session(spark).conf.get(merge) == "false"
    finally:
        spark.conf.unset(name)
        spark.conf.unset(merge)


def test_runs_continue_where_the_last_one_stopped(spark, streams, feed, tmp_path):
    location = str(tmp_path / "run")
    for day in range(1, 31, 10):
        feed.send(
            f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {day} AND {day + 9} ORDER BY ts"
        )
        events = follow_table(streams, feed.folder, "events")
        stream = flat_window(tumbling_stream(events, HOUR, TUMBLE, ["event_type"], event_sums()))
        run_available(stream, location)
        final = f"(SELECT max(ts) FROM sent) - INTERVAL {HOUR} SECOND"
        assert counts_by_type(spark, stream, location) == expected_counts(feed, "sent", final)


def test_one_file_per_batch_gives_the_same(spark, streams, feed, tmp_path):
    for day in range(1, 31, 6):
        feed.send(f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {day} AND {day + 5}")
    results = []
    for files in (1, None):
        location = str(tmp_path / f"run-{files}")
        events = follow_table(streams, feed.folder, "events", files_per_trigger=files)
        stream = flat_window(
            sliding_stream(events, HOUR, 4 * TUMBLE, TUMBLE, ["event_type"], event_sums())
        )
        run_available(stream, location)
        results.append(rows(spark, stream, location))
    assert results[0] == results[1] and results[0]


def test_a_run_broken_off_is_continued(spark, streams, feed, tmp_path):
    for day in range(1, 31, 3):
        feed.send(f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {day} AND {day + 2}")
    location = str(tmp_path / "run")
    events = follow_table(streams, feed.folder, "events", files_per_trigger=1)
    stream = flat_window(tumbling_stream(events, HOUR, TUMBLE, ["event_type"], event_sums()))
    query = start_available(stream, location)
    while query.lastProgress is None and query.isActive:
        time.sleep(0.05)
    query.stop()
    assert len(query.recentProgress) < 10
    run_available(stream, location)
    final = f"(SELECT max(ts) FROM sent) - INTERVAL {HOUR} SECOND"
    assert counts_by_type(spark, stream, location) == expected_counts(feed, "sent", final)


def test_late_events_count_until_the_watermark_passes(spark, streams, feed, tmp_path):
    """An event within the delay is counted; one behind the watermark is not."""
    location = str(tmp_path / "run")
    noon = datetime.datetime(2024, 1, 1, 12)

    feed.send("SELECT * FROM given WHERE ts < TIMESTAMP '2024-01-01 12:00:00'")
    events = follow_table(streams, feed.folder, "events")
    stream = flat_window(tumbling_stream(events, HOUR, TUMBLE, ["event_type"], event_sums()))
    # The watermark stays an hour behind 12:30, so the window that ends at noon is open.
    feed.send("SELECT * REPLACE (TIMESTAMP '2024-01-01 12:30:00' AS ts) FROM given LIMIT 1")
    run_available(stream, location)
    feed.send(
        "SELECT * REPLACE (TIMESTAMP '2024-01-01 11:59:00' AS ts, 'click' AS event_type)"
        " FROM given LIMIT 5"
    )
    run_available(stream, location)
    # Now it passes noon, and the same events again come too late.
    feed.send("SELECT * REPLACE (TIMESTAMP '2024-01-01 13:30:00' AS ts) FROM given LIMIT 1")
    run_available(stream, location)
    before = expected_counts(feed, "sent", f"TIMESTAMP '{noon}'")
    feed.send(
        "SELECT * REPLACE (TIMESTAMP '2024-01-01 11:59:00' AS ts, 'click' AS event_type)"
        " FROM given LIMIT 5"
    )
    feed.send("SELECT * REPLACE (TIMESTAMP '2024-01-01 17:00:00' AS ts) FROM given LIMIT 1")
    run_available(stream, location)

    assert counts_by_type(spark, stream, location) == before
    assert before[(datetime.datetime(2024, 1, 1, 6), "click")] >= 5


def test_a_late_event_is_in_all_its_sliding_windows_or_in_none(spark, streams, feed, tmp_path):
    location = str(tmp_path / "run")

    def at(ts: str, kind: str) -> str:
        return (
            f"SELECT * REPLACE (TIMESTAMP '2024-01-02 {ts}' AS ts, '{kind}' AS event_type)"
            " FROM given LIMIT 1"
        )

    feed.send(at("12:30:00", "first"))
    feed.send(at("11:45:00", "timely"))  # the watermark is at 11:30
    feed.send(at("13:30:00", "next"))
    # The watermark is now past noon, where the pane ends. Spark takes this batch's rows
    # by the watermark before, and only the next one's by the new one.
    feed.send(at("11:50:00", "just in time"))
    feed.send(at("11:50:00", "late"))
    feed.send("SELECT * REPLACE (TIMESTAMP '2024-01-05' AS ts) FROM given LIMIT 1")
    events = follow_table(streams, feed.folder, "events", files_per_trigger=1)
    stream = flat_window(
        sliding_stream(events, HOUR, 4 * TUMBLE, TUMBLE, ["event_type"], event_sums())
    )
    run_available(stream, location)
    found = Counter(r.event_type for r in read_output(spark, stream, location).collect())
    assert found == {"first": 4, "timely": 4, "next": 4, "just in time": 4}


def test_state_can_be_spread_over_its_own_number_of_stores(spark, feed, tmp_path):
    session = stream_session(spark, state_partitions=3)
    feed.send("SELECT * FROM given")
    stream = deduplicated_stream(follow_table(session, feed.folder, "events"), HOUR, "event_id")
    query = start_available(stream, str(tmp_path / "run"))
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numShufflePartitions == 3


def test_sessions_across_batches(spark, streams, feed, tmp_path):
    """Sessions that span files are merged, and equal those of the whole input."""
    for day in range(1, 31, 5):
        feed.send(f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {day} AND {day + 4}")
    location = str(tmp_path / "run")
    events = follow_table(streams, feed.folder, "events", files_per_trigger=1)
    stream = session_stream(events, HOUR, SESSION_GAP, "user_id", event_sums()).drop("total_value")
    run_available(stream, location)
    sql = f"""
    WITH marked AS (
      SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {SESSION_GAP} SECOND
                          THEN 0 ELSE 1 END AS starts
      FROM sent WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    ), numbered AS (
      SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM marked
    )
    SELECT count(*) AS n_events, max(ts) AS session_end, min(ts) AS session_start, user_id
    FROM numbered GROUP BY user_id, no
    HAVING max(ts) + INTERVAL {SESSION_GAP + HOUR} SECOND <= (SELECT max(ts) FROM sent)
    """
    assert rows(spark, stream, location) == Counter(feed.con.sql(sql).fetchall())


def test_repeated_events_are_kept_once(spark, streams, feed, tmp_path):
    """Repeats inside a file, between files and between runs."""
    feed.send("SELECT * FROM given WHERE dayofmonth(ts) <= 10")
    feed.send("SELECT * FROM given WHERE dayofmonth(ts) <= 10 AND event_type = 'click'")
    location = str(tmp_path / "run")
    month = 31 * 24 * HOUR
    for last in (10, 20, 30):
        feed.send(
            f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {last - 9} AND {last}"
            " UNION ALL SELECT * FROM given WHERE event_type = 'error'"
            f" AND dayofmonth(ts) <= {last}"
        )
        events = follow_table(streams, feed.folder, "events", files_per_trigger=1)
        stream = deduplicated_stream(events, month, "event_id")
        run_available(stream, location)
    ids = [row.event_id for row in read_output(spark, stream, location).collect()]
    given = [i for (i,) in feed.con.sql("SELECT event_id FROM given").fetchall()]
    assert sorted(ids) == sorted(given)


def test_very_many_copies_are_thinned_out_before_the_shuffle(spark, streams, feed, tmp_path):
    """Nearly all rows are copies of one event."""
    feed.send(
        "SELECT * FROM given UNION ALL"
        " (SELECT given.* FROM given, range(500000) WHERE event_id = 7)"
    )
    events = follow_table(streams, feed.folder, "events")
    stream = deduplicated_stream(events, HOUR, "event_id")
    location = str(tmp_path / "run")
    query = start_available(stream, location)
    query.awaitTermination()
    ids = [row.event_id for row in read_output(spark, stream, location).collect()]
    given = [i for (i,) in feed.con.sql("SELECT event_id FROM given").fetchall()]
    assert sorted(ids) == sorted(given)
    state = query.recentProgress[0].stateOperators[0]
    assert state.customMetrics["numDroppedDuplicateRows"] < 1000


def test_a_late_copy_does_not_take_the_timely_one_with_it(spark, streams, feed, tmp_path):
    feed.send("SELECT * FROM given WHERE ts < TIMESTAMP '2024-01-05'")
    feed.send(
        "SELECT * REPLACE (-1::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts)"
        " FROM given WHERE event_id = 0 UNION ALL"
        " SELECT * REPLACE (-1::BIGINT AS event_id) FROM given"
        " WHERE ts BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-01-07'"
    )
    events = follow_table(streams, feed.folder, "events", files_per_trigger=1)
    stream = deduplicated_stream(events, HOUR, "event_id")
    location = str(tmp_path / "run")
    run_available(stream, location)
    found = read_output(spark, stream, location).filter("event_id = -1").collect()
    assert len(found) == 1 and found[0].ts > datetime.datetime(2024, 1, 6)


def test_nulls_and_large_keys_are_told_apart(spark, streams, feed, tmp_path):
    """Neighbouring keys beyond what a double can hold, and null, which counts as a key."""
    feed.send(
        "SELECT * REPLACE (CASE WHEN event_id % 100 = 0 THEN NULL"
        " ELSE 9007199254740993 + event_id // 2 END AS event_id) FROM given"
    )
    events = follow_table(streams, feed.folder, "events")
    stream = deduplicated_stream(events, HOUR, "event_id")
    location = str(tmp_path / "run")
    run_available(stream, location)
    ids = [row.event_id for row in read_output(spark, stream, location).collect()]
    expected = [i for (i,) in feed.con.sql("SELECT DISTINCT event_id FROM sent").fetchall()]
    assert len(ids) == len(expected) and set(ids) == set(expected)


@pytest.mark.parametrize("name", ["tumbling_counts", "sliding_counts", "user_sessions"])
def test_registered_streams_take_a_table_in_steps(spark, feed, name, monkeypatch):
    """Several data batches, the same result as one, and state smaller than the input."""
    for day in range(1, 31, 3):
        feed.send(f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {day} AND {day + 2} ORDER BY ts")
    seen = []

    def run_and_look(stream, location):
        query = start_available(stream, location)
        query.awaitTermination()
        seen.append([p for p in query.recentProgress if p.numInputRows])

    monkeypatch.setattr(streams_module, "run_available", run_and_look)
    run = getattr(streams_module, f"stream_{name}")
    results = [
        Counter(tuple(r) for r in run(spark, feed.folder, files_per_trigger=n).collect())
        for n in (2, 256)
    ]
    assert results[0] == results[1] and results[0]
    assert len(seen[0]) == 5 and len(seen[1]) == 1
    total = len(feed.con.sql("SELECT event_id FROM sent").fetchall())
    assert max(p.stateOperators[0].numRowsTotal for p in seen[0]) < total / 2
    stores = seen[0][0].stateOperators[0].numShufflePartitions
    assert stores <= streams_module.STORES_PER_CORE * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["tumbling_counts", "sliding_counts", "user_sessions", "deduplicated_events"])
def test_part_files_in_no_order_of_time_lose_nothing(spark, feed, name):
    """Each part file holds events of the whole month, as after a shuffle by user."""
    for k in range(6):
        feed.send(f"SELECT * FROM given WHERE user_id % 6 = {k}")
    run = getattr(streams_module, f"stream_{name}")
    steps, one = (Counter(tuple(r) for r in run(spark, feed.folder, files_per_trigger=n).collect()) for n in (2, 256))
    assert steps == one and one


def test_copies_in_many_batches_leave_a_task_few_times():
    batches = [
        pa.record_batch([pa.array([7] * 99 + [100 + n]), pa.array(range(n, n + 100))], ["event_id", "ts"])
        for n in range(300)
    ]
    out = list(_latest_copies("event_id", "ts", held_rows=100)(iter(batches)))
    rows = [(i, t) for b in out for i, t in zip(b["event_id"].to_pylist(), b["ts"].to_pylist())]
    hot = [t for i, t in rows if i == 7]
    assert len(hot) <= 4 and max(hot) == 299 + 98
    assert sorted(i for i, _ in rows if i != 7) == list(range(100, 400))


def test_matches_of_two_streams_and_their_state(spark, streams, feed, tmp_path):
    """Files in order of time: all pairs come out, and the state holds no more than the open hours."""
    for day in range(1, 31, 3):
        feed.send(f"SELECT * FROM given WHERE dayofmonth(ts) BETWEEN {day} AND {day + 2} ORDER BY ts")
    within = 4 * HOUR
    events = follow_table(streams, feed.folder, "events", files_per_trigger=1)
    clicks, purchases = (events.filter(events.event_type == kind) for kind in ("click", "purchase"))
    stream = matched_stream(clicks, purchases, HOUR, "user_id", within)
    location = str(tmp_path / "run")
    query = run_available(stream, location)
    found = read_output(spark, stream, location).select("first.event_id", "then.event_id").collect()
    sql = f"""
    SELECT c.event_id, p.event_id FROM sent c JOIN sent p ON c.user_id = p.user_id
     AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL {within} SECOND
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'
    """
    assert Counter(tuple(r) for r in found) == Counter(feed.con.sql(sql).fetchall()) and found
    last = query.recentProgress[-1].stateOperators[0].numRowsTotal
    assert last < 0.2 * feed.con.sql("SELECT count(*) FROM sent WHERE event_type IN ('click', 'purchase')").fetchall()[0][0]


def test_matches_leave_out_rows_without_key_or_time(spark, streams, feed, tmp_path):
    feed.send(
        "SELECT * REPLACE (CASE WHEN event_id % 5 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 > 0 THEN ts END AS ts) FROM given"
    )
    events = follow_table(streams, feed.folder, "events")
    stream = matched_stream(events, events, HOUR, "user_id", 60)
    location = str(tmp_path / "run")
    run_available(stream, location)
    found = Counter(tuple(r) for r in read_output(spark, stream, location).select("first.event_id", "then.event_id").collect())
    sql = """
    SELECT a.event_id, b.event_id FROM sent a JOIN sent b ON a.user_id = b.user_id
     AND a.ts <= b.ts AND a.ts >= b.ts - INTERVAL 60 SECOND
    """
    assert found == Counter(feed.con.sql(sql).fetchall())
