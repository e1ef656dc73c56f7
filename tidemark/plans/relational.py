"""Queries over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exact import as_amount, exact_sum, hundredths
from tidemark.operators.joins import totals_by_key, with_match, without_match
from tidemark.operators.subtotals import cube_totals, grouping_set_totals, rollup_totals
from tidemark.operators.top_k import top_k_per_group
from tidemark.plans.query import Query
from tidemark.sources.tables import read_table

LAST_SHIP_DATE = "1998-09-02"
TOP_K = 3


def net_price() -> Column:
    """Price of a line item after its discount, in units of 0.0001."""
    return hundredths("l_extendedprice") * (100 - hundredths("l_discount"))


def gross_price() -> Column:
    """Price of a line item after its discount and with its tax, in units of 0.000001."""
    return net_price() * (100 + hundredths("l_tax"))


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    shipped = F.col("l_shipdate") <= F.lit(LAST_SHIP_DATE).cast("timestamp_ntz")
    totals = (
        read_table(spark, folder, "lineitem")
        .filter(shipped)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(hundredths("l_quantity")).alias("qty"),
            exact_sum(hundredths("l_extendedprice")).alias("price"),
            exact_sum(net_price()).alias("net"),
            exact_sum(gross_price()).alias("gross"),
            F.sum(hundredths("l_discount")).alias("discount"),
            F.count(F.lit(1)).alias("n_items"),
        )
    )
    return totals.select(
        "l_returnflag",
        "l_linestatus",
        as_amount("qty", 2).alias("sum_qty"),
        as_amount("price", 2).alias("sum_base_price"),
        as_amount("net", 4).alias("sum_disc_price"),
        as_amount("gross", 6).alias("sum_charge"),
        (as_amount("qty", 2) / F.col("n_items")).alias("avg_qty"),
        (as_amount("price", 2) / F.col("n_items")).alias("avg_price"),
        (as_amount("discount", 2) / F.col("n_items")).alias("avg_disc"),
        "n_items",
    )


PRICING_SUMMARY_SQL = f"""
WITH items AS (
  SELECT l_returnflag, l_linestatus,
         CAST(l_quantity AS DECIMAL(15,5)) AS qty,
         CAST(l_extendedprice AS DECIMAL(24,5)) AS price,
         CAST(l_discount AS DECIMAL(6,5)) AS discount,
         CAST(1 - CAST(l_discount AS DECIMAL(6,5)) AS DECIMAL(7,5)) AS kept,
         CAST(1 + CAST(l_tax AS DECIMAL(6,5)) AS DECIMAL(7,5)) AS taxed
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '{LAST_SHIP_DATE} 00:00:00'
)
SELECT l_returnflag, l_linestatus,
       CAST(CAST(sum(qty) AS DECIMAL(38,2)) AS DOUBLE) AS sum_qty,
       CAST(CAST(sum(price) AS DECIMAL(38,2)) AS DOUBLE) AS sum_base_price,
       CAST(CAST(sum(price * kept) AS DECIMAL(38,4)) AS DOUBLE) AS sum_disc_price,
       CAST(CAST(sum(price * kept * taxed) AS DECIMAL(38,6)) AS DOUBLE) AS sum_charge,
       CAST(CAST(sum(qty) AS DECIMAL(38,2)) AS DOUBLE) / count(*) AS avg_qty,
       CAST(CAST(sum(price) AS DECIMAL(38,2)) AS DOUBLE) / count(*) AS avg_price,
       CAST(CAST(sum(discount) AS DECIMAL(38,2)) AS DOUBLE) / count(*) AS avg_disc,
       count(*) AS n_items
FROM items GROUP BY l_returnflag, l_linestatus
"""


def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per region and nation of the customer.

    Items are added up per order, orders per customer and customers per nation, each
    before the join that follows, so every join meets a key at most once on both sides.
    """
    per_order = totals_by_key(
        read_table(spark, folder, "lineitem"), "l_orderkey", {"revenue": exact_sum(net_price())}
    )
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    per_customer = totals_by_key(
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")),
        "o_custkey",
        {"revenue": F.sum("revenue"), "n_orders": F.count(F.lit(1))},
    )
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    per_nation = totals_by_key(
        customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey")),
        "c_nationkey",
        {"revenue": F.sum("revenue"), "n_orders": F.sum("n_orders")},
    )
    # No broadcast hints: Spark broadcasts these two after checking their size.
    return (
        per_nation.join(
            read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        .join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", "n_name", "n_orders", as_amount("revenue", 4).alias("revenue"))
    )


REVENUE_BY_NATION_SQL = """
SELECT r_name, n_name,
       count(DISTINCT o_orderkey) AS n_orders,
       CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(24,5))
                     * CAST(1 - CAST(l_discount AS DECIMAL(6,5)) AS DECIMAL(7,5)))
            AS DECIMAL(38,4)) AS DOUBLE) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name
"""


def orders_with_items(spark: SparkSession, folder: str) -> DataFrame:
    return with_match(
        read_table(spark, folder, "orders"),
        "o_orderkey",
        read_table(spark, folder, "lineitem"),
        "l_orderkey",
    )


def orders_without_items(spark: SparkSession, folder: str) -> DataFrame:
    return without_match(
        read_table(spark, folder, "orders"),
        "o_orderkey",
        read_table(spark, folder, "lineitem"),
        "l_orderkey",
    )


ORDERS_WITH_ITEMS_SQL = """
SELECT * FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""
ORDERS_WITHOUT_ITEMS_SQL = """
SELECT * FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""


def top_orders_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"
    )
    largest_first = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return top_k_per_group(orders, ["o_custkey"], largest_first, TOP_K).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


TOP_ORDERS_PER_CUSTOMER_SQL = f"""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders QUALIFY rank <= {TOP_K}
"""

PLACE = ["c_nationkey", "c_mktsegment"]


def customer_sums() -> dict[str, Column]:
    return {"n_customers": F.count(F.lit(1)), "balance": exact_sum(hundredths("c_acctbal"))}


def _customer_totals(totals: DataFrame) -> DataFrame:
    return totals.withColumn("balance", as_amount("balance", 2))


def customers_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_totals(
        rollup_totals(read_table(spark, folder, "customer"), PLACE, customer_sums())
    )


def customers_cube(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_totals(
        cube_totals(read_table(spark, folder, "customer"), PLACE, customer_sums())
    )


def customers_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Nations and segments each for themselves, without their combinations."""
    sets = [[column] for column in PLACE]
    return _customer_totals(
        grouping_set_totals(read_table(spark, folder, "customer"), sets, PLACE, customer_sums())
    )


def _customers_sql(grouping: str) -> str:
    return f"""
SELECT c_nationkey, c_mktsegment,
       CAST(GROUPING(c_nationkey, c_mktsegment) AS BIGINT) AS level,
       count(*) AS n_customers,
       CAST(CAST(sum(CAST(c_acctbal AS DECIMAL(18,6))) AS DECIMAL(38,2)) AS DOUBLE) AS balance
FROM customer GROUP BY {grouping}
"""


QUERIES = [
    Query("pricing_summary", pricing_summary, PRICING_SUMMARY_SQL),
    Query("revenue_by_nation", revenue_by_nation, REVENUE_BY_NATION_SQL),
    Query("orders_with_items", orders_with_items, ORDERS_WITH_ITEMS_SQL),
    Query("orders_without_items", orders_without_items, ORDERS_WITHOUT_ITEMS_SQL),
    Query("top_orders_per_customer", top_orders_per_customer, TOP_ORDERS_PER_CUSTOMER_SQL),
    Query(
        "customers_rollup", customers_rollup, _customers_sql("ROLLUP (c_nationkey, c_mktsegment)")
    ),
    Query("customers_cube", customers_cube, _customers_sql("CUBE (c_nationkey, c_mktsegment)")),
    Query(
        "customers_grouping_sets",
        customers_grouping_sets,
        _customers_sql("GROUPING SETS ((c_nationkey), (c_mktsegment))"),
    ),
]
