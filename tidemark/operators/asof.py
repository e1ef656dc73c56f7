"""As-of lookup: the latest earlier row of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.slices import ROWS_PER_TASK, add_carry, in_order, slice_hot_groups


def last_seen(
    timeline: DataFrame,
    key: str,
    order: list[str],
    offers: str,
    fields: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``seen``: the ``fields`` of the latest offering row at or before each row.

    ``timeline`` holds both sides of the lookup; the boolean ``offers`` tells the rows
    that can be found from those that ask. ``order``, whose first column is the time, must be
    unique per key and decides which of two rows at the same time comes first; ``fields`` are
    some of its columns. ``seen`` is null where no row of the key has offered anything yet.
    A row without a key or without a time finds nothing and is never found.
    """
    if not set(fields) <= set(order):
        raise ValueError("fields must be columns of the order")
    sliced = slice_hot_groups(timeline, key, order, rows_per_task)
    so_far = (
        Window.partitionBy(*sliced.by)
        .orderBy(*in_order(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.col(offers) & F.col(key).isNotNull() & F.col(order[0]).isNotNull()
    local = (
        # Shuffled before the offers are copied into a column of their own, not after.
        sliced.rows.repartition(*sliced.by)
        .withColumn("_offer", F.when(found, F.struct(*fields)))
        .withColumn("seen", F.last("_offer", ignorenulls=True).over(so_far))
    )

    asks = F.col(key).isNotNull() & F.col(order[0]).isNotNull()
    if sliced.hot is None:  # no key was cut: there is nothing before a slice
        return local.select(*timeline.columns, F.when(asks, F.col("seen")).alias("seen"))

    # The last offer of each slice, one order column after the other: an aggregate of plain
    # numbers is hashed, where one of whole rows would sort them. A slice without an offer
    # keeps a row without values, for what is carried over it.
    last = sliced.hot.select(*sliced.by, *(F.when(found, F.col(c)).alias(c) for c in order))
    for at in reversed(range(len(order))):
        rest = [F.max_by(c, order[at]).alias(c) for c in order[at + 1 :]]
        last = last.groupBy(*sliced.by, *order[:at]).agg(F.max(order[at]).alias(order[at]), *rest)
    offer = F.when(F.col(order[0]).isNotNull(), F.struct(*fields)).alias("_last")
    last = last.select(*sliced.by, offer)
    earlier = (
        Window.partitionBy(key).orderBy(*sliced.slices).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = last.select(*sliced.by, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    return add_carry(local, sliced.by, carry).select(
        *timeline.columns, F.when(asks, F.coalesce("seen", "_carried")).alias("seen")
    )
