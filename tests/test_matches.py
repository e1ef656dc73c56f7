"""Interval and band joins, moving totals, places, distinct counts and multisets against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_plans import plan_of
from tidemark.operators import multisets, overlaps
from tidemark.operators.distinct import distinct_rollup
from tidemark.operators.moving import moving_totals
from tidemark.operators.multisets import except_all, intersect_all
from tidemark.operators.overlaps import Intervals, Points, overlapping, points_in_intervals, within_band
from tidemark.operators.ranks import global_ranks
from tidemark.plans import matches

START = datetime(2024, 1, 1)
few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
keys = st.sampled_from([1, 1, 1, 2, None])
spot = st.tuples(keys, st.one_of(st.none(), st.integers(-50, 200)))
# Of very different lengths, some without any, some that end before they start.
span = st.tuples(keys, st.one_of(st.none(), st.integers(-60, 200)), st.sampled_from([0, 0, 1, 2, 7, 8, 9, 40, 300, -1, None]))


def points_of(spark, rows):
    numbered = [(i, k, x, "p") for i, (k, x) in enumerate(rows)]
    return numbered, Points(spark.createDataFrame(numbered, "id bigint, key bigint, x bigint, _level string"), "key", "x")


def intervals_of(spark, rows):
    numbered = [(i, k, a, None if a is None or n is None else a + n) for i, (k, a, n) in enumerate(rows)]
    return numbered, Intervals(spark.createDataFrame(numbered, "id bigint, key bigint, a bigint, b bigint"), "key", "a", "b")


@few
@given(st.lists(spot, max_size=40), st.lists(span, max_size=30), st.booleans(), st.sampled_from([1, 4, 1000]))
def test_points_in_intervals(spark, spots, spans, after_start, rows_per_task):
    spots, points = points_of(spark, spots)
    spans, intervals = intervals_of(spark, spans)
    expected = Counter(
        (p, i) for p, k, x, _ in spots for i, l, a, b in spans
        if None not in (k, x, l, a, b) and k == l and a <= x <= b and (x > a or not after_start)
    )
    found = points_in_intervals(points, intervals, after_start, rows_per_task).select("point.id", "interval.id").collect()
    assert Counter(tuple(r) for r in found) == expected


@few
@given(st.lists(span, max_size=30), st.lists(span, max_size=30), st.sampled_from([1, 5, 1000]))
def test_overlapping(spark, left, right, rows_per_task):
    left, a = intervals_of(spark, left)
    right, b = intervals_of(spark, right)
    expected = Counter(
        (i, j) for i, k, a0, a1 in left for j, l, b0, b1 in right
        if None not in (k, a0, a1, l, b0, b1) and k == l and a0 <= a1 and b0 <= b1 and a0 <= b1 and b0 <= a1
    )
    found = overlapping(a, b, rows_per_task).select("left.id", "right.id").collect()
    assert Counter(tuple(r) for r in found) == expected


def test_timestamps_to_the_microsecond(spark):
    day = datetime(2024, 3, 10, 1, 59, 59, 999_999)
    micro = timedelta(microseconds=1)
    spots = [(i, 1, day + i * micro) for i in range(-2, 5)]
    points = Points(spark.createDataFrame(spots, "id int, key int, t timestamp_ntz"), "key", "t")
    spans = spark.createDataFrame([(1, day, day + 2 * micro)], "key int, a timestamp_ntz, b timestamp_ntz")
    found = points_in_intervals(points, Intervals(spans, "key", "a", "b"), after_start=True)
    assert {r["id"] for r in found.select("point.id").collect()} == {1, 2}


@few
@given(st.lists(spot, max_size=40), st.lists(spot, max_size=40), st.sampled_from([0, 1, 13]), st.sampled_from([1, 1000]))
def test_within_band(spark, left, right, width, rows_per_task):
    left, a = points_of(spark, left)
    right, b = points_of(spark, right)
    expected = Counter(
        (i, j) for i, k, x, _ in left for j, l, y, _ in right
        if None not in (k, x, l, y) and k == l and abs(x - y) <= width
    )
    found = within_band(a, b, width, rows_per_task).select("left.id", "right.id").collect()
    assert Counter(tuple(r) for r in found) == expected


def test_a_hot_bin_is_cut_on_both_sides(spark, monkeypatch):
    """Hundreds of points and of intervals of one key at one place: no task gets many of them."""
    spots = [(1, 7)] * 300 + [(2, 7)] * 5
    spans = [(1, 5, 6)] * 300 + [(2, 0, 9)]
    _, points = points_of(spark, spots)
    _, intervals = intervals_of(spark, spans)
    dealt, seen = overlaps._dealt, []

    def look(rows, *rest):
        out = dealt(rows, *rest)
        seen.append(out.groupBy("_key", "_level", "_bin", "_part", "_other").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(overlaps, "_dealt", look)
    assert points_in_intervals(points, intervals, rows_per_task=20).count() == 300 * 300 + 5
    assert max(seen) <= 45 and len(seen) == 2


def test_no_bins_beyond_the_bound_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "MOST_CUT", 3)
    large, sizes = overlaps._large_bins, []

    def look(*rest):
        out = large(*rest)
        sizes.append(out.count() if out is not None else 0)
        return out

    monkeypatch.setattr(overlaps, "_large_bins", look)
    spots = [(k, 7) for k in range(20) for _ in range(10 + k)]
    _, points = points_of(spark, spots)
    _, intervals = intervals_of(spark, [(k, 0, 9) for k in range(20)])
    assert points_in_intervals(points, intervals, rows_per_task=2).count() == len(spots)
    assert sizes[0] <= 3


def test_joins_of_nothing(spark):
    _, points = points_of(spark, [])
    _, intervals = intervals_of(spark, [])
    assert points_in_intervals(points, intervals).count() == 0
    assert overlapping(intervals, intervals).count() == 0 and within_band(points, points, 1).count() == 0


event = st.tuples(keys, st.one_of(st.none(), st.integers(0, 60)), st.one_of(st.none(), st.integers(-5, 5)))


@few
@given(st.lists(event, max_size=60), st.sampled_from([(10, 1), (10, 5), (16, 16), (100, 10)]))
def test_moving_totals(spark, rows, size):
    width, grains = size
    times = [(k, None if t is None else START + timedelta(seconds=t), v) for k, t, v in rows]
    df = spark.createDataFrame(times, "user_id bigint, ts timestamp_ntz, amount bigint")
    groups = defaultdict(list)
    for k, t, v in times:
        if t is not None:
            groups[k].append((t, v))
    expected = set()
    for k, some in groups.items():
        for t in {t for t, _ in some}:
            inside = [v for u, v in some if t - timedelta(seconds=width) <= u <= t]
            values = [v for v in inside if v is not None]
            now = sum(u == t for u, _ in some)
            expected.add((k, t, now, len(inside), sum(values) if values else None, max(values, default=None)))
    found = moving_totals(df, "user_id", "ts", width, "amount", grains).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_moving_totals_keep_to_whole_microseconds(spark):
    events = spark.createDataFrame([(1, START, 1)], "user_id int, ts timestamp_ntz, amount int")
    with pytest.raises(ValueError):
        moving_totals(events, "user_id", "ts", 10, "amount", grains=7 * 11 * 13)


@few
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=50), st.integers(1, 7), st.sampled_from([3, 1000]))
def test_global_ranks(spark, values, tiles, rows_per_task):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "id bigint, v bigint")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    small, larger = divmod(len(rows), tiles)
    expected, tile = set(), 1
    for place, (i, v) in enumerate(ordered, 1):
        size = lambda t: small + (t <= larger)
        while place > sum(size(t) for t in range(1, tile + 1)):
            tile += 1
        expected.add((i, v, place, tile))
    found = global_ranks(df, ["v", "id"], tiles, rows_per_task).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(rows)


value = st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([32_767, 32_768, 32_769, 10**12, -(10**12)]))


@few
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None]), value), max_size=60))
def test_distinct_rollup(spark, rows):
    df = spark.createDataFrame(rows, "a string, b int, v bigint")
    expected = {}
    for n, level in ((2, 0), (1, 1), (0, 3)):
        groups = defaultdict(set)
        for a, b, v in rows:
            groups[((a, b)[:n] + (None,) * (2 - n))].add(v)
        expected |= {(*k, level): len(g - {None}) for k, g in groups.items()}
    found = distinct_rollup(df, ["a", "b"], "v").collect()
    assert {(r["a"], r["b"], r["level"]): r["n_distinct"] for r in found} == expected and len(found) == len(expected)


pair = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["x", None]))


@few
@given(st.lists(pair, max_size=40), st.lists(pair, max_size=40), st.sampled_from([1, 3, 100_000]))
def test_multisets(spark, left, right, at_once):
    a = spark.createDataFrame(left, "k int, _n string")
    b = spark.createDataFrame([(y, x) for x, y in right], "_n string, k int")
    kept, multisets.COPIES_AT_ONCE = multisets.COPIES_AT_ONCE, at_once
    try:
        both, rest = Counter(left) & Counter(right), Counter(left) - Counter(right)
        names = ["k", "_n"]
        assert Counter(tuple(r) for r in intersect_all(a.toDF(*names), b).collect()) == both
        assert Counter(tuple(r) for r in except_all(a.toDF(*names), b).collect()) == rest
    finally:
        multisets.COPIES_AT_ONCE = kept


def test_many_copies_of_a_row_leave_in_pieces(spark):
    left = spark.range(1_000_000).select((F.col("id") % 2).alias("k"))
    kept = except_all(left, spark.range(3).select(F.lit(1).cast("bigint").alias("k")))
    assert {r["k"]: r["count"] for r in kept.groupBy("k").count().collect()} == {0: 500_000, 1: 499_997}
    plan = plan_of(kept)
    assert plan.count("hashpartitioning") == 1 and "REBALANCE" in plan


def test_rows_are_counted_before_they_are_shuffled(spark, data):
    for query in (matches.purchases_beyond_errors, matches.purchases_matched_by_errors, matches.moving_day_per_user):
        plan = plan_of(query(spark, data))
        assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate.*partial", plan)


def test_rows_of_a_moving_window_meet_their_totals_where_they_are(spark, data):
    """Moments and grains are shuffled by key and grain once each; the join moves nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(matches.moving_day_per_user(spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(user_id") <= 5 and "SinglePartition" not in plan
