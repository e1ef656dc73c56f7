"""Order columns as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def as_number(rows: DataFrame, column: str) -> str:
    """SQL for an order column as a double that rises with it, seconds for a timestamp without a zone.

    Two values may share a number if they are very close; the order never turns round.
    """
    kind = rows.schema[column].dataType.typeName()
    if kind == "timestamp_ntz":
        # Through an interval: the functions that return a number go through the session's zone.
        since = f"(`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
        day, hour, minute, second = (f"extract({u} FROM {since})" for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
        return f"double((({day} * 24L + {hour}) * 60 + {minute}) * 60) + double({second})"
    if kind == "boolean":
        return f"double(int(`{column}`))"
    return f"double(`{column}`)"
