"""Packing documents into sequences by cutting-stock column generation.

Every document's ids are cut into pieces of at most a sequence. How many pieces there are of each
length decides what a sequence is filled with:

1. The lengths are counted; there are at most as many as a sequence has places. Lengths are
   rounded up to classes of ``capacity / 256`` ids.
2. A linear program over patterns (how many pieces of each class a sequence holds) finds the
   fewest sequences that hold all pieces. It starts from patterns of one class; a knapsack over
   the dual prices proposes the pattern that saves most, until none saves anything or the bound
   of the duals says that what could be saved is below ``GAP``.
3. The numbers of sequences per pattern are rounded down; the few pieces left are packed largest
   first.
4. Pieces are ranked within their class, without bringing a class together: a range-partitioned
   table is numbered per partition, and the partitions' counts are added up. The rank of a piece
   says which pattern's which copy it goes to.

Only counts by length come to the driver, and only patterns go back.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import (
    documents_of,
    numbers,
    saved,
    shuffle_partitions,
    text_pieces,
    with_columns_of,
)
from tidemark.llm.simple8b import Encoder

UNITS = 256
GAP = 2e-4
#: Rounds of column generation per class. So many are not known to be needed; should they ever end first,
#: the packing is as valid, and the log says how far it may be from the best.
ROUNDS = 50

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Pattern:
    sequences: int
    pieces: tuple[tuple[int, int], ...]  # class (in units) and how many of it, largest first


def pieces_of(
    docs: DataFrame,
    encoder: Encoder,
    capacity: int,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, row, ids`` of the pieces of all documents.

    A document is cut every ``capacity`` ids; the rest is its last piece. Null text counts as
    empty. A document without any ids has no piece. ``ids`` are little-endian 32-bit integers.
    Pieces of rows without an id are told apart by ``row``, which is null for all others; it stays the
    same once the pieces are written.
    """
    docs = documents_of(docs, id_col, text_col)
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return docs.withColumn("row", row).mapInArrow(
        _cut(encoder, capacity, end_id),
        "doc_id bigint, start bigint, length bigint, doc_tokens bigint, row bigint, ids binary",
    )


def _cut(encoder: Encoder, capacity: int, end_id: int | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_pieces(whole):
                ids, counts = encoder(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                per_doc = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), per_doc)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = number * capacity
                length = np.minimum(capacity, counts[doc] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                content = np.ascontiguousarray(ids.astype("<u4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(counts[doc]),
                        batch.column("row").take(pa.array(doc)),
                        pa.Array.from_buffers(
                            pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(content)]
                        ),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "row", "ids"],
                )

    return task


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length`` (1 to capacity).

    Pieces of a sequence follow each other without gaps, larger classes first. Pieces that are
    equal in all columns are packed one after the other. ``pieces`` should be a written table.
    """
    spark = pieces.sparkSession
    unit = -(-capacity // UNITS)
    sized = pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    demand = np.zeros(capacity // unit + 1, np.int64)
    for row in sized.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():
        demand[row["class"]] = row["n"]
    places = Places(cutting_stock(demand), len(demand))

    numbered = saved(
        sized.repartitionByRange(shuffle_partitions(spark), "class", "doc_id", "start")
        .sortWithinPartitions("class", "doc_id", "start")
        .mapInArrow(_numbered, with_columns_of(sized, "part int, number bigint")),
        "numbered",
    )
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Partitions are ranges of classes: together they have as many rows as partitions and classes.
    ahead = (
        numbered.groupBy("class", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("class", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    )
    placed = (
        numbered.join(F.broadcast(ahead), ["class", "part"])
        .withColumn("rank", F.col("number") + F.col("ahead"))
        .drop("number", "ahead", "part")
    )
    placed = placed.mapInArrow(places.find, with_columns_of(placed, "sequence_id bigint"))
    filled = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    so_far = filled.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn(
        "offset", F.sum("length").over(so_far) - F.col("length")
    ).select(*pieces.columns, "sequence_id", "offset")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each class within the partition, which is in order of classes."""
    part, seen, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        kind = numbers(batch.column("class"))
        if not len(kind):
            continue
        if kind[0] != last:
            seen = 0
        change = np.flatnonzero(np.diff(kind, prepend=kind[0] - 1))
        run_start = np.repeat(change, np.diff(np.append(change, len(kind))))
        number = np.arange(len(kind)) - run_start
        number[run_start == 0] += seen
        last, seen = kind[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(kind), part, np.int32)), pa.array(number)],
            [*batch.schema.names, "part", "number"],
        )


class Places:
    """From the class and rank of a piece to its sequence."""

    def __init__(self, patterns: list[Pattern], classes: int):
        self.bounds = [[0] for _ in range(classes)]  # rank at which each pattern's places end
        self.base: list[list[int]] = [[] for _ in range(classes)]
        self.each: list[list[int]] = [[] for _ in range(classes)]
        sequence = 0
        for pattern in patterns:
            for kind, n in pattern.pieces:
                self.bounds[kind].append(self.bounds[kind][-1] + n * pattern.sequences)
                self.base[kind].append(sequence)
                self.each[kind].append(n)
            sequence += pattern.sequences

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = numbers(batch.column("class")), numbers(batch.column("rank"))
            out = np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                bounds = np.array(self.bounds[k])
                pattern = np.searchsorted(bounds, rank[at], side="right") - 1
                within = rank[at] - bounds[pattern]
                out[at] = np.array(self.base[k])[pattern] + within // np.array(self.each[k])[pattern]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out)], [*batch.schema.names, "sequence_id"]
            )


def cutting_stock(demand: np.ndarray) -> list[Pattern]:
    """Patterns that hold ``demand[k]`` pieces of size k each, in bins of size ``len(demand) - 1``."""
    capacity = len(demand) - 1
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    columns, amount = _column_generation(sizes, demand[sizes].astype(np.float64), capacity)
    patterns, left = [], demand.copy()
    for column, x in sorted(zip(columns, amount), key=lambda c: -c[1]):
        x = int(x + 1e-6)
        if x:
            pieces = [(int(sizes[i]), int(column[i])) for i in np.flatnonzero(column)[::-1]]
            patterns.append(Pattern(x, tuple(pieces)))
            left[sizes] -= x * column
    left = np.maximum(left, 0)  # a pattern may have more places than there are pieces
    while left.any():
        room, pieces = capacity, []
        for size in np.flatnonzero(left)[::-1].tolist():
            n = min(room // size, int(left[size]))
            if n:
                pieces.append((size, n))
                room -= n * size
        times = min(int(left[size]) // n for size, n in pieces)
        patterns.append(Pattern(times, tuple(pieces)))
        for size, n in pieces:
            left[size] -= n * times
    return patterns


def _column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Basis columns and their amounts after the simplex method, with columns as they are needed."""
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = (inverse * demand).sum(axis=1)
    worth = np.inf
    for _ in range(ROUNDS * m):
        price = inverse.sum(axis=0)  # all columns cost one sequence
        worth, column = _knapsack(sizes, price, capacity)
        # By the duals no plan needs fewer than amount.sum() / worth sequences.
        least = amount.sum() / worth
        if worth <= 1 + GAP or np.ceil(amount.sum() - 1e-6) <= np.ceil(least - 1e-6):
            break
        direction = (inverse * column).sum(axis=1)  # no BLAS: its threads cost more here
        positive = np.flatnonzero(direction > 1e-9)
        ratio = amount[positive] / direction[positive]
        leaving = positive[np.argmin(ratio)]
        step = ratio.min()
        amount -= step * direction
        amount[leaving] = step
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        columns[leaving] = column
        amount = np.maximum(amount, 0)
    else:
        log.warning("column generation ended after %d rounds, up to %.1f%% above the bound", ROUNDS * m, 100 * (worth - 1))
    return columns, amount


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth, by dynamic programming over the room that is left."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = int(np.searchsorted(sizes, room, side="right"))
        if fits:
            worth = best[room - sizes[:fits]] + price[:fits]
            i = int(np.argmax(worth))
            if worth[i] > best[room] + 1e-12:
                best[room], taken[room] = worth[i], i
    column, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            column[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), column
