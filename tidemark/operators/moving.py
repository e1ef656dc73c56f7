"""Totals over the last stretch of time before each moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.event_time import micros_since_epoch

GRAINS = 1440


def moving_totals(
    rows: DataFrame, key: str, ts: str, width: int, value: str, grains: int = GRAINS
) -> DataFrame:
    """One row per key and moment with a row: ``n``, and ``moving_n``, ``moving_sum`` and ``moving_max`` of ``value``.

    They are over the rows of the key from ``width`` seconds before the moment, included, up to the moment.
    Rows without a time are left out; those without a key are those of one key. Nulls in ``value`` count
    in ``n`` and ``moving_n`` only. ``value`` should be an integer or a decimal.

    Rows of one moment become one first, partly before the shuffle. The stretch is cut into grains of
    ``width / grains`` seconds, and a moment's result has three parts: the moments of its own grain up to it; the
    whole grains before, from one total per grain; and the late moments of the grain that the
    stretch begins in. For these each moment is copied once, moved on by ``width``, into the grain where it
    drops out. So a task's window holds moments of two grains, at most twice as many as
    they have microseconds, and the window over totals has (time span / grain) rows per key.
    """
    grain = width * 1_000_000 // grains
    if grain * grains != width * 1_000_000:
        raise ValueError("grains must divide the width into whole microseconds")
    moments = (
        rows.filter(F.col(ts).isNotNull())
        .groupBy(key, ts)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("_sum"), F.max(value).alias("_max"))
        .withColumn("_at", micros_since_epoch(ts))
    )
    kind = moments.schema["_sum"].dataType
    stretch = width * 1_000_000
    own = F.struct(F.lit(False).alias("_old"), F.col("_at").alias("_t"))
    moved_on = F.struct(F.lit(True).alias("_old"), (F.col("_at") + stretch).alias("_t"))
    both = (
        moments.select(key, ts, "n", "_sum", "_max", F.explode(F.array(own, moved_on)).alias("_side"))
        .select(key, ts, "n", "_sum", "_max", "_side._old", "_side._t")
        .withColumn("_grain", _grain("_t", grain))
    )
    in_grain = Window.partitionBy(key, "_grain").orderBy("_t")
    up_to = in_grain.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = in_grain.rangeBetween(Window.currentRow, Window.unboundedFollowing)

    def part(which: bool, column: str, over: Window, total) -> Column:
        return total(F.when(F.col("_old") == which, F.col(column))).over(over)

    parts = {}
    for name, column, total in (("n", "n", F.sum), ("sum", "_sum", F.sum), ("max", "_max", F.max)):
        parts[f"_new_{name}"] = part(False, column, up_to, total)
        parts[f"_old_{name}"] = part(True, column, onwards, total)
    local = both.withColumns(parts).filter("NOT _old")
    earlier = Window.partitionBy(key).orderBy("_grain").rangeBetween(-(grains - 1), -1)
    whole = (
        moments.groupBy(key, _grain("_at", grain).alias("_grain"))
        .agg(F.sum("n").alias("_n"), F.sum("_sum").alias("_s"), F.max("_max").alias("_m"))
        .select(
            F.col(key).alias("_of"),
            F.col("_grain").alias("_of_grain"),
            F.sum("_n").over(earlier).alias("_between_n"),
            F.sum("_s").over(earlier).alias("_between_sum"),
            F.max("_m").over(earlier).alias("_between_max"),
        )
    )
    found = local.join(whole, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_grain") == F.col("_of_grain")), "left")

    # Old and new moments of one grain lie a whole width apart, so nothing is counted twice.
    def added(name: str) -> Column:
        some = [F.col(f"{p}_{name}") for p in ("_old", "_between", "_new")]
        total = sum((F.coalesce(c, F.lit(0)) for c in some[1:]), F.coalesce(some[0], F.lit(0)))
        return F.when(F.coalesce(*some).isNotNull(), total)

    return found.select(
        key,
        ts,
        "n",
        added("n").cast("bigint").alias("moving_n"),
        added("sum").cast(kind).alias("moving_sum"),
        F.greatest("_old_max", "_between_max", "_new_max").alias("moving_max"),
    )


def _grain(micros: str, grain: int) -> Column:
    """The number of the grain, in whole numbers."""
    return F.expr(f"({micros} - pmod({micros}, {grain}L)) div {grain}L")
