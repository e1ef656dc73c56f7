"""Ordered per-key work on keys too large for one task.

A window over ``partitionBy(key)`` puts all rows of a key into one task. Here every row gets
slice numbers that rise with the wanted order, so that a window over the key and the slices
stays small. What a slice needs to know about the earlier ones is computed from one summary row
per slice and joined back.

The rows are counted per key first, when the query is built. Only if a key is too large are its slices
counted in turn, and then what is still too large in them. What these counts say becomes a
small table of constants in the plan: which groups are cut, and between which values. The slice numbers
are a fixed function of a row and those constants, so they are the same whenever a part of the
plan is run again. Nothing is sampled or written, and inputs of all sizes take the same steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbers import as_number

ROWS_PER_TASK = 500_000

#: Slices per ``rows_per_task`` rows: values are not spread evenly, so more are cut than needed.
FINER = 4

#: Groups cut at most at each level. Where more have over ``rows_per_task`` rows, a task gets more rows
#: instead: the average of so many groups.
MOST_CUT = 100_000

SLICES = ["_slice", "_part", "_tie"]


@dataclass(frozen=True)
class SlicedRows:
    rows: DataFrame  # all rows, with slice numbers
    by: list[str]  # the columns whose groups are small enough for one task: the key and the slices
    hot: DataFrame | None  # the rows of the keys that were cut, if there are any

    @property
    def slices(self) -> list[str]:
        return self.by[1:]


def in_order(order: list[str]) -> list[Column]:
    """The order columns, rows without a value first."""
    return [F.asc_nulls_first(c) for c in order]


def slice_hot_groups(
    rows: DataFrame, key: str, order: list[str], rows_per_task: int = ROWS_PER_TASK
) -> SlicedRows:
    """Number the rows so that groups of key and slices are small.

    ``order`` must be unique per key; its columns are numbers, booleans or timestamps without a
    zone. A key with more than ``rows_per_task`` rows is cut by the first order column in which
    its rows differ: the stretch from the first to the last value is divided evenly into
    ``FINER`` times as many slices as it would need. A slice that is still too large, a burst, is cut
    between its own first and last value, and what is too large even then once more: by the next
    column where all of its rows are at one time. Levels at which nothing is cut have no number.

    What is broadcast are the constants of the groups that are cut, at most ``MOST_CUT`` rows.
    """
    numbers = [f"{as_number(rows, column)} AS _o{i}" for i, column in enumerate(order)]
    rows = rows.selectExpr("*", *numbers)
    hot, by, how = rows, [key], "inner"
    for name in SLICES:
        constants = _cuts(hot, by, len(order), rows_per_task)
        if not constants.num_rows:
            break
        cuts = rows.sparkSession.createDataFrame(constants)
        rows = _numbered(rows, by, len(order), cuts, name, "left")
        # Only what was cut is looked at again.
        hot = _numbered(hot, by, len(order), cuts, name, how)
        by, how = [*by, name], "left"
    return SlicedRows(rows, by, hot if len(by) > 1 else None)


# SQL text takes a fraction of the calls that the same expressions take as columns.


def _cuts(rows: DataFrame, by: list[str], n_order: int, rows_per_task: int) -> pa.Table:
    """The groups with too many rows, and how to divide each."""
    ends = [F.expr("count(1) AS _n")]
    which = low = high = ""
    for i in range(n_order):
        ends += [F.expr(e) for e in (f"min(_o{i}) AS _low{i}", f"max(_o{i}) AS _high{i}", f"count(_o{i}) AS _valued{i}")]
        differs = f"WHEN _valued{i} > 0 AND (_low{i} < _high{i} OR _valued{i} < _n) THEN"
        which += f" {differs} {i}"
        low += f" {differs} _low{i}"
        high += f" {differs} _high{i}"
    groups = rows.groupBy(*by).agg(*ends)

    def larger_than(most: int) -> DataFrame:
        return groups.filter(f"_n > {most}").selectExpr(
            *(f"`{c}` AS `_of{c}`" for c in by),
            f"CASE {which} END AS _which",
            f"CASE {low} END AS _low",
            f"CASE {high} END AS _high",
            f"ceil(_n * {FINER} / {most}) AS _steps",
        ).filter("_which IS NOT NULL")

    found = larger_than(rows_per_task).limit(MOST_CUT + 1).toArrow()
    if found.num_rows <= MOST_CUT:
        return found
    # Fewer than MOST_CUT groups have more than that part of the rows of all large groups.
    total = groups.filter(f"_n > {rows_per_task}").agg(F.sum("_n")).first()[0]
    return larger_than(-(-total // MOST_CUT)).toArrow()


def _numbered(
    rows: DataFrame, by: list[str], n_order: int, cuts: DataFrame, name: str, how: str
) -> DataFrame:
    """Add the slice number; 0 in groups that are not cut and for rows without a value."""
    same = F.expr(" AND ".join(f"`{c}` <=> `_of{c}`" for c in by))
    value = "CASE _which " + " ".join(f"WHEN {i} THEN _o{i}" for i in range(n_order)) + " END"
    place = f"CASE WHEN _high > _low THEN ({value} - _low) / (_high - _low) ELSE 0D END"
    number = f"1 + least(floor({place} * _steps), _steps - 1)"
    return rows.join(F.broadcast(cuts), same, how).selectExpr(  # at most MOST_CUT rows
        *(f"`{c}`" for c in rows.columns),
        f"CASE WHEN {value} IS NULL THEN 0L ELSE {number} END AS {name}",
    )


def add_carry(local: DataFrame, by: list[str], carry: DataFrame) -> DataFrame:
    """Join to each row what ``carry`` holds for its slice; null where it holds nothing.

    ``carry`` has at most one row per slice. Both sides are partitioned by the same columns, the
    rows already for the window before, and no slice is large.
    """
    carry = carry.withColumnsRenamed({c: f"_of{c}" for c in by})
    return local.join(carry, F.expr(" AND ".join(f"`{c}` <=> `_of{c}`" for c in by)), "left")
