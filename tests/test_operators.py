"""Operators on generated rows against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.exact import as_amount, exact_sum, hundredths
from tidemark.operators.asof import last_seen
from tidemark.operators.joins import with_match, without_match
from tidemark.operators.running import running_totals
from tidemark.operators.sessions import sessions
from tidemark.operators.subtotals import cube_totals, grouping_set_totals, rollup_totals
from tidemark.operators.time_windows import sliding_totals
from tidemark.operators.top_k import top_k_per_group
from tidemark.operators.user_days import user_days

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, user_id bigint, ts timestamp_ntz, offers boolean, amount bigint"

# Few users and few distinct times, so that ties and exact borders are common.
row = st.tuples(
    st.sampled_from([1, 1, 1, 2, 3, None]),
    st.integers(0, 40),
    st.booleans(),
    st.one_of(st.none(), st.integers(-5, 5)),
)
row_lists = st.lists(row, min_size=1, max_size=60)
few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def at(tens: int) -> datetime:
    return START + timedelta(seconds=10 * tens)


def frame(spark, rows):
    numbered = [(i, u, at(t), o, a) for i, (u, t, o, a) in enumerate(rows)]
    return numbered, spark.createDataFrame(numbered, SCHEMA)


def by_user(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    return groups


@few
@given(row_lists, st.sampled_from([3, 10, 1000]))
def test_running_totals(spark, rows, rows_per_task):
    rows, df = frame(spark, rows)
    expected = set()
    for group in by_user(rows).values():
        for n, r in enumerate(group, 1):
            seen = [x[4] for x in group[:n] if x[4] is not None]
            expected.add((r[0], n, sum(seen) if seen else None, max(seen, default=None)))
    found = running_totals(df, "user_id", ["ts", "id"], "amount", rows_per_task)
    found = found.select("id", "running_n", "running_sum", "running_max").collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(rows)


@few
@given(row_lists, st.sampled_from([3, 10, 1000]))
def test_last_seen(spark, rows, rows_per_task):
    rows, df = frame(spark, rows)
    expected = set()
    for user, group in by_user(rows).items():
        latest = None
        for r in group:
            latest = r[0] if r[3] and user is not None else latest
            expected.add((r[0], latest))
    found = last_seen(df, "user_id", ["ts", "id"], "offers", ["id", "ts"], rows_per_task)
    found = found.select("id", "seen.id").collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(rows)


@few
@given(row_lists, st.sampled_from([10, 20, 35, 90]))
def test_sessions(spark, rows, gap):
    rows, df = frame(spark, rows)
    expected = Counter()
    for user, group in by_user(rows).items():
        start = last = group[0][2]
        n = 0
        for r in group:
            if r[2] - last > timedelta(seconds=gap):
                expected[(user, start, last, n)] += 1
                start, n = r[2], 0
            last, n = r[2], n + 1
        expected[(user, start, last, n)] += 1
    found = sessions(df, "user_id", "ts", gap, {"n": F.count(F.lit(1))})
    assert Counter(tuple(r) for r in found.collect()) == expected
    built_in = (
        df.groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("s"))
        .agg(F.max("ts"), F.count(F.lit(1)))
        .select("user_id", "s.start", "max(ts)", "count(1)")
    )
    assert Counter(tuple(r) for r in built_in.collect()) == expected


@few
@given(row_lists, st.sampled_from([(60, 20), (50, 20), (20, 20), (70, 30), (90, 10)]))
def test_sliding_totals(spark, rows, size):
    """Also where the width is no multiple of the slide."""
    width, slide = size
    rows, df = frame(spark, rows)
    expected = defaultdict(lambda: [0, 0])
    for r in rows:
        second = int((r[2] - datetime(1970, 1, 1)).total_seconds())
        start = second - second % slide
        while start + width > second:
            key = (datetime(1970, 1, 1) + timedelta(seconds=start), r[3])
            expected[key][0] += 1
            expected[key][1] += r[4] or 0
            start -= slide
    sums = {"n": F.count(F.lit(1)), "total": F.sum("amount")}
    found = sliding_totals(df, "ts", width, slide, ["offers"], sums)
    found = found.select("window.start", "offers", "n", F.coalesce("total", F.lit(0))).collect()
    assert {tuple(r) for r in found} == {(*k, *v) for k, v in expected.items()}
    assert len(found) == len(expected)


@pytest.mark.parametrize(
    ("totals", "sets"),
    [
        (rollup_totals, [("user_id", "offers"), ("user_id",), ()]),
        (cube_totals, [("user_id", "offers"), ("user_id",), ("offers",), ()]),
        (
            lambda df, by, sums: grouping_set_totals(df, [["offers"], []], by, sums),
            [("offers",), ()],
        ),
    ],
)
@few
@given(rows=row_lists)
def test_subtotals(spark, totals, sets, rows):
    """Nulls in the data stay apart from those of the subtotals."""
    rows, df = frame(spark, rows)
    expected = Counter()
    for left in sets:
        level = 2 * ("user_id" not in left) + ("offers" not in left)
        for r in rows:
            key = (r[1] if "user_id" in left else None, r[3] if "offers" in left else None)
            expected[(*key, level)] += 1
    found = totals(df, ["user_id", "offers"], {"n": F.count(F.lit(1))}).collect()
    assert {(r.user_id, r.offers, r.level): r.n for r in found} == expected
    assert len(found) == len(expected)


@few
@given(row_lists, st.integers(1, 4))
def test_top_k(spark, rows, k):
    rows, df = frame(spark, rows)
    expected = set()
    for group in by_user(rows).values():
        expected |= {(r[0], i) for i, r in enumerate(group[:k], 1)}
    found = top_k_per_group(df, ["user_id"], [F.asc("ts"), F.asc("id")], k)
    assert {tuple(r) for r in found.select("id", "rank").collect()} == expected


@pytest.mark.parametrize("threshold", ["1000", "-1"])
@pytest.mark.parametrize("k", [3, 5000])
def test_top_k_of_any_size(spark, k, threshold):
    """Also beyond what Spark limits before the shuffle, and where that is switched off."""
    rows = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 50).alias("g")
    )
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        found = top_k_per_group(rows, ["g"], [F.desc("id")], k).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    groups = defaultdict(list)
    for i in range(8999, -1, -1):
        groups[1 if i % 3 else i % 50].append(i)
    expected = {(i, n) for some in groups.values() for n, i in enumerate(some[:k], 1)}
    assert {(r.id, r["rank"]) for r in found} == expected and len(found) == len(expected)


@few
@given(row_lists, row_lists)
def test_matches(spark, rows, others):
    rows, df = frame(spark, rows)
    others, other_df = frame(spark, others)
    keys = {r[1] for r in others} - {None}
    other_df = other_df.select(F.col("user_id").alias("other"))
    found = with_match(df, "user_id", other_df, "other").select("id").collect()
    missed = without_match(df, "user_id", other_df, "other").select("id").collect()
    assert sorted(r.id for r in found) == [r[0] for r in rows if r[1] in keys]
    assert sorted(r.id for r in missed) == [r[0] for r in rows if r[1] not in keys]


@few
@given(row_lists)
def test_user_days(spark, rows):
    rows, df = frame(spark, rows)
    names = {True: "purchase", False: "error"}
    df = df.withColumns(
        {
            "event_type": F.when(F.col("offers"), "purchase").otherwise("error"),
            "ts": F.col("ts") + F.expr("INTERVAL '12' HOUR") * F.col("id"),
        }
    )
    expected = defaultdict(set)
    for r in rows:
        day = (r[2] + timedelta(hours=12 * r[0])).replace(hour=0, minute=0, second=0)
        expected[(r[1], day)].add(names[r[3]])
    found = user_days(df, ["purchase", "error"]).collect()
    assert {
        (r.user_id, r.day): {n for n in names.values() if r[f"has_{n}"]} for r in found
    } == expected


@few
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=30))
def test_exact_sum(spark, units):
    """Negative numbers, and sums beyond a bigint."""
    df = spark.createDataFrame([(u,) for u in units], "units bigint")
    assert int(df.agg(exact_sum(F.col("units"))).first()[0]) == sum(units)


def test_exact_sum_of_many_large_numbers(spark):
    n, unit = 2**22, 2**62
    total = spark.range(n).agg(exact_sum(F.lit(unit))).first()[0]
    assert int(total) == n * unit
    assert int(spark.range(n).agg(exact_sum(F.lit(-unit))).first()[0]) == -n * unit


@pytest.mark.parametrize("amount", [1.005, 0.1 + 0.2, 1 / 3, float("nan"), float("inf"), 1e16])
def test_amounts_that_are_no_hundredths_are_refused(spark, amount):
    df = spark.createDataFrame([(1.25,), (amount,)], "amount double")
    with pytest.raises(Exception, match="amount is no whole number of hundredths"):
        df.select(hundredths("amount")).collect()


@few
@given(st.lists(st.integers(-(10**11), 10**11), min_size=1, max_size=30))
def test_amounts_survive_as_hundredths(spark, cents):
    df = spark.createDataFrame([(c / 100,) for c in cents], "amount double")
    units = df.select(hundredths("amount").alias("units"))
    assert [r.units for r in units.collect()] == cents
    back = units.select(as_amount("units", 2).alias("amount")).collect()
    assert [r.amount for r in back] == [c / 100 for c in cents]
