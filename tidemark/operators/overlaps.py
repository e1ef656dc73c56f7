"""Joins of intervals with points, with intervals, and of numbers within a band.

Intervals are dealt into bins. The width of a bin is a power of eight that is at least the
interval's length, so an interval touches two bins at most (rarely three, by rounding), however the lengths
differ. A point is looked up in one bin of each width that occurs. Points and intervals meet
where key, width and bin are equal, and the pair is compared as it stands.

Two intervals overlap when the one that starts later starts within the other, so an overlap join is
two joins of starts with intervals, and each pair comes out once.

A bin may hold very many rows of one key: it is cut into parts of its points and parts of its
intervals, and each part of the one side meets each part of the other. Which bins are cut is
counted when the join is built, partly before the shuffle, and becomes a table of constants in the plan, of
at most ``MOST_CUT`` rows. The widths that occur are looked up before that. So each side is read
three times at most; if it is the result of more work, it should be a written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbers import as_number

ROWS_PER_TASK = 500_000
MOST_CUT = 50_000
BASE = 8


@dataclass(frozen=True)
class Points:
    """Rows with a key and a place; those without either meet nothing."""

    rows: DataFrame
    key: str
    at: str


@dataclass(frozen=True)
class Intervals:
    """Rows with a key and two bounds, both included.

    Those without a key or a bound, or that end before they start, meet nothing.
    """

    rows: DataFrame
    key: str
    start: str
    end: str


def points_in_intervals(
    points: Points, intervals: Intervals, after_start: bool = False, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``point`` and ``interval`` (whole rows) of every pair of one key with the point in the interval.

    ``after_start`` leaves out points at the very start. Places and bounds have the same type: numbers or
    timestamps without a zone.
    """
    spots = points.rows.select(
        F.struct(*points.rows.columns).alias("point"),
        F.col(points.key).alias("_key"),
        F.col(points.at).alias("_at"),
        F.expr(as_number(points.rows, points.at)).alias("_place"),
    ).filter("_key IS NOT NULL AND _at IS NOT NULL")
    low, high = (as_number(intervals.rows, c) for c in (intervals.start, intervals.end))
    spans = (
        intervals.rows.filter(F.col(intervals.start) <= F.col(intervals.end))
        .select(
            F.struct(*intervals.rows.columns).alias("interval"),
            F.col(intervals.key).alias("_key"),
            F.col(intervals.start).alias("_start"),
            F.col(intervals.end).alias("_end"),
            F.expr(low).alias("_low"),
            F.expr(high).alias("_high"),
        )
        .filter("_key IS NOT NULL")
        .withColumn("_level", _level(F.col("_high") - F.col("_low")))
    )
    levels = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # some dozens at most
    if not levels:
        levels = [0]

    def bin_of(place: str) -> Column:
        return F.floor(F.col(place) / F.pow(F.lit(float(BASE)), F.col("_level"))).cast("bigint")

    spots = spots.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels)))).withColumn("_bin", bin_of("_place"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(bin_of("_low"), bin_of("_high"))))
    spots = spots.drop("_place")
    spans = spans.drop("_low", "_high")

    where = ["_key", "_level", "_bin"]
    hot = _large_bins(spots, spans, where, rows_per_task)
    parts = []
    if hot is not None:
        spots = _dealt(spots, hot, where, "_points", "_spans", "_part", "_other")
        spans = _dealt(spans, hot, where, "_spans", "_points", "_other", "_part")
        parts = ["_part", "_other"]
    inside = (F.col("_at") > F.col("_start") if after_start else F.col("_at") >= F.col("_start")) & (
        F.col("_at") <= F.col("_end")
    )
    met = spots.join(spans, [*where, *parts])
    return met.filter(inside).select("point", "interval")


def _level(length: Column) -> Column:
    """The power of eight that is at least the length; 0 for no length at all."""
    power = F.ceil(F.log(length) / F.log(F.lit(float(BASE)))).cast("int")
    return F.when(length > 0, power).otherwise(F.lit(0))


def _large_bins(spots: DataFrame, spans: DataFrame, where: list[str], rows_per_task: int) -> DataFrame | None:
    """Bins with very many points or intervals, and into how many parts each side is cut; none if there are none.

    A table of constants, ``MOST_CUT`` rows at most: where more bins are large, a part gets more rows instead,
    the average of so many bins.
    """
    sides = spots.select(*where, F.lit(1).alias("_p"), F.lit(0).alias("_s")).unionByName(
        spans.select(*where, F.lit(0).alias("_p"), F.lit(1).alias("_s"))
    )
    counts = sides.groupBy(*where).agg(F.sum("_p").alias("_p"), F.sum("_s").alias("_s"))
    rows = F.greatest("_p", "_s")

    def larger_than(most: int) -> DataFrame:
        return counts.filter(rows > most).select(
            *where, F.ceil(F.col("_p") / most).cast("int").alias("_points"), F.ceil(F.col("_s") / most).cast("int").alias("_spans")
        )

    found = larger_than(rows_per_task).limit(MOST_CUT + 1).toArrow()
    if found.num_rows > MOST_CUT:
        total = counts.filter(rows > rows_per_task).agg(F.sum(rows)).first()[0]
        found = larger_than(-(-total // MOST_CUT)).toArrow()
    return spots.sparkSession.createDataFrame(found) if found.num_rows else None


def _dealt(rows: DataFrame, hot: DataFrame, where: list[str], own: str, other: str, part: str, copy: str) -> DataFrame:
    """Give each row a part of its own side, and copy it for each part of the other."""
    marked = rows.join(F.broadcast(hot), where, "left")  # at most MOST_CUT rows
    mine = F.coalesce(F.pmod(F.xxhash64(F.struct(*rows.columns)), F.greatest(F.col(own), F.lit(1))), F.lit(0)).cast("int")
    copies = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(other), F.lit(1)), F.lit(1)) - 1)
    return marked.select(*rows.columns, mine.alias(part), F.explode(copies).alias(copy))


def overlapping(left: Intervals, right: Intervals, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``left`` and ``right`` (whole rows) of every pair of one key that share a point, each once."""
    names = {"point": "right", "interval": "left"}
    starts = Points(right.rows.filter(F.col(right.start) <= F.col(right.end)), right.key, right.start)
    first = points_in_intervals(starts, left, rows_per_task=rows_per_task).withColumnsRenamed(names)
    starts = Points(left.rows.filter(F.col(left.start) <= F.col(left.end)), left.key, left.start)
    second = points_in_intervals(starts, right, after_start=True, rows_per_task=rows_per_task)
    names = {"point": "left", "interval": "right"}
    return first.select("left", "right").union(second.withColumnsRenamed(names).select("left", "right"))


def within_band(
    left: Points, right: Points, width: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``left`` and ``right`` (whole rows) of every pair of one key whose places differ by ``width`` at most.

    Places are whole numbers, so that the bounds are exact; a place within ``width`` of the ends of a
    bigint ends the job.
    """
    place = F.col(left.at).cast("bigint")
    band = left.rows.select(
        F.struct(*left.rows.columns).alias("_row"),
        F.col(left.key).alias("_of"),
        (place - width).alias("_from"),
        (place + width).alias("_to"),
    )
    spots = Points(right.rows.withColumn(right.at, F.col(right.at).cast("bigint")), right.key, right.at)
    found = points_in_intervals(spots, Intervals(band, "_of", "_from", "_to"), rows_per_task=rows_per_task)
    return found.select(F.col("interval._row").alias("left"), F.col("point").alias("right"))
