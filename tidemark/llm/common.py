"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import working_folder

#: Rows of a key that one task may get in a join by key; larger keys are few and broadcast.
LARGE_KEYS = 1000

#: Edges that one task takes in ``components``, 16 bytes each.
TASK_EDGES = 1 << 19

#: Short rows, without texts, that one task writes.
WRITTEN_ROWS = 1 << 16


def saved(frame: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the step it was working on. A table of short
    rows, made from no more than ``rows``, is written by few tasks, however many partitions a shuffle has.
    """
    folder = working_folder(frame.sparkSession, purpose)
    if rows is not None:
        frame = frame.coalesce(max(1, -(-rows // WRITTEN_ROWS)))
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what the operators read, as ``doc_id`` bigint and ``text``, null text as empty."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def with_columns_of(frame: DataFrame, added: str) -> StructType:
    """The schema of ``frame``, with that of nested columns as it is, and the added columns."""
    return StructType([*frame.schema.fields, *StructType.fromDDL(added).fields])


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of all documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def join_uneven(rows: DataFrame, key: str, groups: DataFrame, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which hold ``key`` once and how often it occurs.

    Keys with more than a thousandth of all rows are fewer than a thousand: they are
    broadcast, and their rows stay where they are. All other keys are shuffled, and none
    of them is large. Rows that found a large key leave the shuffled join by a key of their
    own, so that they spread evenly.
    """
    names = [c for c in groups.columns if c != key]
    limit = max(1, total // LARGE_KEYS)
    large = groups.filter(F.col(size) > limit).select(
        F.col(key).alias("_large"), F.struct(*names).alias("_of_large")
    )
    small = groups.filter(F.col(size) <= limit).select(
        F.xxhash64(key).alias("_hash"), F.col(key).alias("_small"), F.struct(*names).alias("_of_small")
    )
    marked = rows.join(F.broadcast(large), F.col(key) == F.col("_large"), "left").withColumn(
        "_hash",
        F.when(F.col("_large").isNull() & F.col(key).isNotNull(), F.xxhash64(key)).otherwise(
            F.xxhash64(F.struct(*rows.columns))
        ),
    )
    joined = marked.join(small, (marked["_hash"] == small["_hash"]) & (F.col(key) == F.col("_small")), "left")
    found = F.coalesce("_of_large", "_of_small")
    return joined.select(*rows.columns, *(found[c].alias(c) for c in names))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``id`` and the smallest id reachable, ``root``.

    ``edges`` has bigint columns ``a`` and ``b``; every id in it gets a row. Large-star and
    small-star steps alternate until the edges form stars. Each step joins edges with one
    minimum per id, so a node with very many edges is never gathered in one place; the
    edges of a step are written, and only their count and checksum come to the driver.

    First each task makes stars of up to ``TASK_EDGES`` edges. A graph with no more is done then, without
    the many shuffles of a step.
    """
    edges = saved(edges.select("a", "b").filter("a <> b"), "edges")
    n = edges.count()
    edges = saved(edges.coalesce(max(1, -(-n // TASK_EDGES))).mapInArrow(_starred, "a bigint, b bigint"), "edges")
    if n > TASK_EDGES:
        edges = _shortened(edges)
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each id of a task to the smallest that its edges reach."""
    parts = [np.stack([numbers(batch.column(c)) for c in ("a", "b")]) for batch in batches]
    if parts:
        ends = np.concatenate(parts, axis=1)
        ids, node = np.unique(ends, return_inverse=True)
        left, right = node.reshape(ends.shape)
        least = ids[local_roots(len(ids), left, right)]
        apart = ids != least
        yield pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(least[apart])], ["a", "b"])


def _shortened(edges: DataFrame) -> DataFrame:
    """Stars with the same components, by steps over all edges until nothing changes."""
    edges = saved(_oriented(edges), "edges")
    state = _state(edges)
    while True:
        total = 2 * state[0]
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, total).filter(F.col("b") > F.col("a"))
        edges = _oriented(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        small = _with_least(edges, total)
        edges = _oriented(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                small.select("a", F.col("m").alias("b"))
            )
        )
        edges = saved(edges, "edges")
        last, state = state, _state(edges)
        if state == last:
            return edges


def _state(edges: DataFrame) -> tuple:
    checksum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), checksum).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Add ``m``, the smallest neighbour of each edge's ``a``, without bringing its edges together."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_uneven(edges, "a", least, "n", total)


def _oriented(edges: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return (
        edges.filter(a != b)
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the given links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    return root


def text_pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text is a slice of its own."""
    offsets, _ = string_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(batch.num_rows, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if where is None or len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], content[offsets[0] : offsets[-1]]


def binary_rows(parts: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def numbers(column: pa.Array | pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(kind, copy=False)
