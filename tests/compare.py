"""Comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _type_family(name: str) -> str:
    name = name.lower()
    if name.startswith("decimal"):
        return "decimal"
    return {
        "bigint": "bigint",
        "int": "integer",
        "integer": "integer",
        "double": "double",
        "string": "string",
        "varchar": "string",
        "timestamp_ntz": "timestamp",
        "timestamp": "timestamp with time zone",
        "boolean": "boolean",
    }.get(name, name)


def spark_rows(result: DataFrame) -> Counter:
    columns = sorted(result.columns)
    return Counter(
        tuple(_plain(row[c]) for c in columns) for row in result.select(*columns).collect()
    )


def duck_result(sql: str, folder: str) -> tuple[list[str], dict[str, str], Counter]:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = con.sql(sql)
    types = {
        # Without a zone here; "timestamp" is with a zone in Spark.
        c: "timestamp" if str(t) == "TIMESTAMP" else _type_family(str(t))
        for c, t in zip(result.columns, result.types)
    }
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    rows = Counter(tuple(_plain(row[i]) for i in at) for row in result.fetchall())
    return columns, types, rows


def assert_same(result: DataFrame, sql: str, folder: str) -> int:
    columns, types, expected = duck_result(sql, folder)
    assert sorted(result.columns) == columns
    assert {c: _type_family(t) for c, t in result.dtypes} == types
    actual = spark_rows(result)
    missing, surplus = expected - actual, actual - expected
    assert not missing and not surplus, (
        f"{sum(missing.values())} rows missing, {sum(surplus.values())} surplus; "
        f"e.g. {list(missing)[:3]} against {list(surplus)[:3]}"
    )
    return sum(actual.values())
