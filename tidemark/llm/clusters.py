"""Comparing the members of groups, in tasks of bounded size.

Where only connected components are wanted, a group too large for one task is not compared pair by pair.
``edges_in_large_groups`` compares all members with a few of them first. Those found
connected need no comparison among themselves; in each further round new members are taken from what
is still apart from the group's largest component. Only what stays apart to the end is compared with all
the others, in pairs of blocks. A group of near copies of each other is done after one or
two rounds, with about one row per member and round; one of m members of which u stay
apart costs 2 * u * m / ``rows`` rows more.

Where every pair counts, ``with_blocks`` and ``block_pairs`` cut a group into blocks, and each pair of blocks
becomes a task of its own: m * blocks rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, join_uneven, local_roots, numbers, saved, string_buffer

EDGES_DDL = "a bigint, b bigint"
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def with_blocks(
    members: DataFrame, group: str, id_col: str, rows: int, total: int, size: str | None = None, most_bytes: int = 0
) -> DataFrame:
    """Add ``blocks``, into how many the member's group is cut so that none has many more than ``rows``.

    With a column ``size``, none has many more than ``most_bytes`` of its sum either.
    """
    counts = [F.count(F.lit(1)).alias("members")]
    needed = F.ceil(F.col("members") / rows)
    if size is not None:
        counts.append(F.sum(size).alias("_bytes"))
        needed = F.greatest(needed, F.ceil(F.col("_bytes") / most_bytes))
    sizes = members.groupBy(group).agg(*counts)
    sized = join_uneven(members, group, sizes, "members", total)
    blocks = F.least(needed, F.col("members")).cast("int")
    return sized.withColumn("blocks", blocks).drop("_bytes").withColumn(
        "block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    )


def block_pairs(members: DataFrame, group: Column, tasks: int) -> DataFrame:
    """One row per member and pair of blocks it takes part in, with ``task`` to group by.

    A group of one block shares its task with others; a pair of blocks of a large one is alone.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.withColumn("_other", other).withColumns(
        {"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}
    )
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(tasks))).otherwise(
        F.xxhash64(group, "i", "j")
    )
    return paired.withColumn("task", task).drop("_other", "members")


def in_shared_keys(
    keys: DataFrame, payload: DataFrame, total: int, rows: int, tasks: int, alone: Callable, across: Callable
) -> DataFrame:
    """Edges ``a, b`` that connect, within each key that several ids have, what is close enough.

    ``keys`` has ``key`` and ``id``, ``total`` rows of it; ``payload`` the ``id`` once and ``payload``. ``alone`` gets
    a table of ``key, id, payload`` with whole keys and returns edges; ``across`` is what
    ``edges_in_large_groups`` takes, for keys of more than ``rows`` ids. Keys of one id go nowhere.
    """
    shared = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared-keys", total)

    def having(some: DataFrame) -> DataFrame:
        return join_uneven(keys, "key", some, "members", total).filter(F.col("members").isNotNull()).join(payload, "id")

    edges = (
        having(shared.filter(F.col("members") <= rows))
        .select(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"), "key", "id", "payload")
        .groupBy("task")
        .applyInArrow(alone, EDGES_DDL)
    )
    hot = shared.filter(F.col("members") > rows)
    if hot.isEmpty():
        return edges
    blocks = F.ceil(F.col("members") / rows).cast("int").alias("blocks")
    large = saved(having(hot).select(F.col("key").alias("group"), "id", blocks, "payload"), "large-keys")
    return edges.union(edges_in_large_groups(large, across, rows))


def edges_in_large_groups(large: DataFrame, across: Callable, rows: int, rounds: int = 2, asked: int = 4) -> DataFrame:
    """Edges ``a, b`` that connect what is close enough within each group.

    ``large`` is a written table of ``group, id, blocks, payload``, with each id once per group and the group
    to be cut into ``blocks``. ``across`` gets a table of ``group, side, id, payload`` and returns the edges from
    rows of side 0 to rows of side 1 of the same group. In each of ``rounds`` rounds up to ``asked`` members of
    a group are compared with all; then all that are still apart from its largest component.
    """
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = large.select("group", "id", "blocks", "payload", block.alias("block"))
    labelled = large.select("group", "id", "blocks", F.col("id").alias("label"))
    total = large.count()
    found: list[DataFrame] = []
    for r in range(rounds + 1):
        sizes = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        open_ = (
            sizes.groupBy("group")
            .agg(
                F.max_by("label", F.struct("n", "label")).alias("most"),
                F.count(F.lit(1)).alias("labels"),
                F.sum("n").alias("members"),
                F.max("n").alias("joined"),
            )
            .filter("labels > 1")
        )
        last = r == rounds
        apart = F.col("members") - F.col("joined")
        cuts = F.greatest(F.lit(1), F.ceil(apart / rows)) if last else F.lit(1)
        open_ = saved(open_.select("group", "most", "members", cuts.cast("int").alias("cuts")), "open-groups", total)
        if open_.isEmpty():
            break
        # A row per group of more than one block: few enough to send them everywhere, as are those asked of each.
        open_ = F.broadcast(open_.drop("members"))
        queries = labelled.join(open_, "group")
        if r:
            queries = queries.filter("label <> most")
        if last:
            cut = F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts")).cast("int")
            queries = queries.select("group", "id", "blocks", cut.alias("cut"))
        else:
            order = F.struct(F.xxhash64("id", F.lit(r)), "id", "blocks")
            queries = (
                queries.groupBy("group", F.pmod(F.xxhash64("id", F.lit(r), F.lit(1)), F.lit(asked)).alias("k"))
                .agg(F.min(order).alias("first"))
                .select("group", "first.id", "first.blocks", F.lit(0).alias("cut"))
                .hint("broadcast")
            )
        asking = (
            queries.join(large.select("group", "id", "payload"), ["group", "id"])
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("group", "block", "cut", F.lit(0).alias("side"), "id", "payload")
        )
        asked_all = (
            members.join(open_, "group")
            .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .select("group", "block", "cut", F.lit(1).alias("side"), "id", "payload")
        )
        rows_of = asking.union(asked_all).select(
            F.xxhash64("group", "block", "cut").alias("task"), "group", "side", "id", "payload"
        )
        found.append(saved(rows_of.groupBy("task").applyInArrow(across, EDGES_DDL), "edges"))
        if not last:
            joined = components(reduce(DataFrame.union, found)).withColumnRenamed("id", "_id")
            labelled = saved(
                labelled.drop("label")
                .join(joined, F.col("id") == F.col("_id"), "left")
                .select("group", "id", "blocks", F.coalesce("root", "id").alias("label")),
                "labels",
                total,
            )
    nothing = large.sparkSession.createDataFrame([], EDGES_DDL)
    return reduce(DataFrame.union, found, nothing)


def by_group(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of side 0 and of side 1 of each group in a table, where there are both."""
    side = numbers(table.column("side"), np.int8)
    order, starts = runs(numbers(table.column("group")))
    for a, b in zip(starts[:-1], starts[1:]):
        at = order[a:b]
        asking, others = at[side[at] == 0], at[side[at] == 1]
        if len(asking) and len(others):
            yield asking, others


def stars(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over links between rows, whose ids may be those of other rows too."""
    nodes, node = np.unique(ids, return_inverse=True)
    return forest(nodes, local_roots(len(nodes), node[left], node[right]))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run of equal keys starts (and the end)."""
    order = np.lexsort(keys[::-1])
    n = len(order)
    if n == 0:
        return order, np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        in_order = key[order]
        change[1:] |= in_order[1:] != in_order[:-1]
    return order, np.append(np.flatnonzero(change), n)


def forest(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to its root; ``root`` holds positions in ``ids``."""
    apart = ids != ids[root]
    return ids[apart], ids[root][apart]


def edge_table(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.table([pa.array(a), pa.array(b)], schema=EDGES)


def fixed_width(column: pa.ChunkedArray, width: int, kind=np.uint8) -> np.ndarray:
    """A binary column whose values all have the same length, as a matrix."""
    parts = [string_buffer(chunk)[1] for chunk in column.chunks]
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return data.view(kind).reshape(-1, width)

