"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from tidemark.operators.top_k import top_k_per_group
from tidemark.plans import all_queries, event_time, relational
from tidemark.sources.tables import read_table

QUERIES = {query.name: query.run for query in all_queries()}
BATCH = [name for name in QUERIES if not name.startswith("stream_")]


def plan_of(result) -> str:
    return result._jdf.queryExecution().executedPlan().toString()


def scans(plan: str) -> list[set[str]]:
    found = re.findall(r"ReadSchema: struct<(.*)>$", plan, re.MULTILINE)
    return [{column.split(":")[0] for column in scan.split(",")} for scan in found]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_no_python(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", BATCH)
def test_no_shuffle_to_a_single_task(spark, data, name):
    assert "SinglePartition" not in plan_of(QUERIES[name](spark, data))


def test_pricing_summary_reads_little(spark, data):
    plan = plan_of(relational.pricing_summary(spark, data))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate," in plan
    assert scans(plan) == [
        {
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            "l_shipdate",
        }
    ]
    assert plan.count("Exchange hashpartitioning") == 1


def test_revenue_adds_up_before_each_shuffle(spark, data):
    """With nothing small enough to broadcast, each large table is shuffled once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(relational.revenue_by_nation(spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {"l_orderkey", "l_extendedprice", "l_discount"} in scans(plan)
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(o_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(o_custkey") == 1
    assert plan.count("Exchange hashpartitioning(c_custkey") == 1


def test_matches_look_only_at_keys(spark, data):
    for query in (relational.orders_with_items, relational.orders_without_items):
        plan = plan_of(query(spark, data))
        assert {"l_orderkey"} in scans(plan)
        assert "partial" in plan or "HashAggregate(keys=[_key" in plan


def test_top_k_is_limited_before_the_shuffle(spark, data):
    plan = plan_of(relational.top_orders_per_customer(spark, data))
    assert re.search(r"Exchange hashpartitioning\(o_custkey.*\n.*WindowGroupLimit.* Partial", plan)


def test_top_k_beyond_sparks_limit_ranks_parts_first(spark, data):
    orders = read_table(spark, data, "orders")
    plan = plan_of(top_k_per_group(orders, ["o_custkey"], [orders["o_orderkey"]], 5000))
    assert len(re.findall(r"\+- Window ", plan)) == 2 and "_part" in plan


@pytest.mark.parametrize(
    "query",
    [
        relational.customers_rollup,
        relational.customers_cube,
        relational.customers_grouping_sets,
        event_time.props_rollup,
        event_time.sliding_event_counts,
    ],
)
def test_rows_are_added_up_before_they_are_copied(spark, data, query):
    """Read from the scan upwards: an aggregate comes before the Expand."""
    plan = plan_of(query(spark, data))
    assert "Expand" in plan
    assert "HashAggregate" in plan[plan.index("Expand") :]


@pytest.mark.parametrize(
    "query",
    [
        event_time.user_days_purchase_and_error,
        event_time.user_days_purchase_no_error,
        event_time.user_days_purchase_or_error,
    ],
)
def test_set_operations_read_and_shuffle_once(spark, data, query):
    plan = plan_of(query(spark, data))
    assert scans(plan) == [{"ts", "user_id", "event_type"}]
    assert plan.count("Exchange") == 1
    assert "In(event_type, [error,purchase])" in plan


ORDERED = [event_time.running_value_per_user, event_time.last_click_before_purchase]


@pytest.mark.parametrize("query", ORDERED)
@pytest.mark.parametrize("rows_per_task", [20, 500_000])
def test_ordered_queries_have_one_path(spark, data, query, rows_per_task):
    """All rows are shuffled once, by key and slice, and no summary is made by sorting rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(query(spark, data, rows_per_task=rows_per_task))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in plan and "rangepartitioning" not in plan
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    top = plan.split("ReusedExchange")[0]
    windows = [line for line in top.splitlines() if "Window [" in line]
    assert windows


@pytest.mark.parametrize("query", ORDERED)
@pytest.mark.parametrize(("rows_per_task", "most"), [(20, 2), (500_000, 1)])
def test_ordered_queries_scan_little(spark, data, query, rows_per_task, most):
    """In the first plan, before Spark reuses what is equal: all rows, and those of keys that were cut."""
    plan = plan_of(query(spark, data, rows_per_task=rows_per_task))
    assert 1 <= len(scans(plan)) <= most


@pytest.mark.parametrize("query", ORDERED)
@pytest.mark.parametrize(("rows_per_task", "most"), [(20, 20), (500_000, 4)])
def test_ordered_queries_only_count_while_built(spark, data, query, rows_per_task, most):
    """The schema, and a count per level at which something may be cut."""
    tracker = spark.sparkContext.statusTracker()
    group = f"{query.__name__}-{rows_per_task}"
    spark.sparkContext.setJobGroup(group, "")
    query(spark, data, rows_per_task=rows_per_task)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= most


def test_as_of_filter_reaches_all_scans(spark, data):
    plan = plan_of(event_time.last_click_before_purchase(spark, data))
    assert plan.count("In(event_type, [click,purchase])") == len(scans(plan))
