"""Near-duplicate vectors by hashing into cells of the E8 lattice.

Vectors are linked when their cosine, in double precision, is at least a threshold; the result
has each vector's number of links and its connected component.

1. A table projects the unit vector at random into ``BLOCKS`` spaces of eight dimensions. In
   each, the point is decoded to the nearest point of the E8 lattice; the lattice points together
   are its cell. Neighbouring cells are probed: those with one lattice point replaced by one of
   the ``PROBES`` next nearest. There are ``TABLES`` tables. At a cosine of 0.9 a table brings a
   pair together about every other time, so about one pair in a hundred is missed by all, and
   far fewer above.
2. Vectors that share a key are compared by eight-bit copies of their components, with a margin
   for their error. Those that pass are joined into families. A key of more than ``KEY_BLOCK`` vectors
   is not compared pair by pair (``clusters.edges_in_large_groups``).
3. Within a family all pairs are compared exactly, in pairs of blocks of ``FAMILY_BYTES``. These comparisons
   count the links, so a pair that no table brought together still counts if others connect it.
   Every link counts, so a family of m vectors costs m * m / 2 products, and each vector is sent once per
   block of its family: with 64 components a block holds 65,536.

Equal unit vectors are one class from the start, whatever their ids; a link to a class counts once
per member. Rows that repeat an id are vectors of their own: each has its links and its component, which is the
smallest id among the rows it is connected with.
Only vectors of the same length are compared. Vectors that are null, empty, zero, or hold a null or
a component that is not finite are linked with nothing and stay. Rows without an id are left out.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.clusters import block_pairs, by_group, edge_table, forest, in_shared_keys, runs, stars, with_blocks
from tidemark.llm.common import (
    components,
    join_uneven,
    local_roots,
    numbers,
    saved,
    shuffle_partitions,
)
from tidemark.llm.hashing import mix

TABLES = 8
BLOCKS = 3
PROBES = 4
SCALE = 3.5
MARGIN = 0.02
KEY_BLOCK = 4096
FAMILY_BLOCK = 1 << 16
FAMILY_BYTES = 32 << 20
AT_ONCE = 2048
TASK_ROWS = 500_000


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = e8_neighbours()


def nearest_e8(points: np.ndarray) -> np.ndarray:
    """The nearest lattice point: whole numbers with an even sum, or all of them and a half."""

    def even(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        off = x - near
        row = np.arange(len(x))
        worst = np.abs(off).argmax(axis=1)
        other = near.copy()
        other[row, worst] += np.where(off[row, worst] >= 0, 1, -1)
        return np.where((near.sum(axis=1) % 2 != 0)[:, None], other, near)

    a, b = even(points), even(points - 0.5) + 0.5
    closer = ((points - a) ** 2).sum(axis=1) <= ((points - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    partitions = shuffle_partitions(vectors.sparkSession)
    table = saved(
        vectors.select(
            vectors[id_col].cast("bigint").alias("vec_id"),
            vectors[vector_col].cast("array<double>").alias("vector"),
        )
        .filter(F.col("vec_id").isNotNull())
        .mapInArrow(_unit, "vec_id bigint, digest binary, unit binary"),
        "vectors",
    )
    total = table.count()
    # A class of equal vectors is a node, numbered when it is written. All of its rows have the same vector.
    classes = saved(
        table.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    units = classes.select("id", "unit")
    per_vector = TABLES * (1 + BLOCKS * PROBES)
    tasks = max(partitions, -(-total * per_vector // (4 * TASK_ROWS)))
    near = in_shared_keys(
        units.mapInArrow(_cells, "key bigint, id bigint"), units.mapInArrow(_small, "id bigint, payload binary"),
        total * per_vector, KEY_BLOCK, tasks, _near(threshold - MARGIN), _near_across(threshold - MARGIN),
    )
    families = saved(components(near).select("id", F.col("root").alias("family")), "families")
    n_members = families.count()
    members = families.join(classes.select("id", "copies", "unit"), "id").withColumn("size", F.octet_length("unit"))
    members = with_blocks(members, "family", "id", FAMILY_BLOCK, n_members, "size", FAMILY_BYTES)
    found = saved(
        block_pairs(members, F.col("family"), max(partitions, n_members // 20_000))
        .select("task", "family", "i", "j", "block", "id", "copies", "unit")
        .groupBy("task")
        .applyInArrow(_links(threshold), "id bigint, root bigint, links bigint"),
        "links",
    )
    roots = saved(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "components")
    counted = found.groupBy("id").agg(F.sum("links").alias("others"))
    named = classes.select("digest", "copies", "vec_id", "id").join(counted, "id", "left").join(roots, "id", "left")
    least = named.filter(F.col("root").isNotNull()).groupBy("root").agg(
        F.min("vec_id").alias("component"), F.count(F.lit(1)).alias("size")
    )
    groups = join_uneven(named, "root", least, "size", n_members).select(
        "digest",
        "copies",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component"),
    )
    result = join_uneven(table.select("vec_id", "digest"), "digest", saved(groups, "groups"), "copies", total)
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector")
        length = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
        units: list[bytes | None] = [None] * batch.num_rows
        for n in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == n)
            x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
            largest = np.abs(x).max(axis=1)
            good = np.isfinite(largest) & (largest > 0)
            x = x[good] / largest[good, None]
            x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0  # no negative zeros
            for row, one in zip(rows[good].tolist(), x):
                units[row] = one.astype("<f8").tobytes()
        digests = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary())],
            ["vec_id", "digest", "unit"],
        )


def _by_length(values: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose vectors have the same length, and these as a matrix."""
    length = np.array([len(v) for v in values])
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield rows, np.frombuffer(b"".join([values[r] for r in rows.tolist()]), kind).reshape(len(rows), -1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a vector's own cell and of the probed ones, in all tables."""
    for batch in batches:
        ids = numbers(batch.column("id"))
        for rows, x in _by_length(batch.column("unit").to_pylist(), "<f8"):
            random = np.random.Generator(np.random.PCG64(x.shape[1]))
            for table in range(TABLES):
                keys = cell_keys(x, random.normal(size=(x.shape[1], 8 * BLOCKS)) / 8, table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.T.ravel().view(np.int64)), pa.array(np.tile(ids[rows], keys.shape[1]))],
                    ["key", "id"],
                )


def cell_keys(x: np.ndarray, projection: np.ndarray, table: int) -> np.ndarray:
    """One row per vector: the key of its cell, then those of the neighbouring cells."""
    y = (x @ projection) * SCALE
    own, others = [], []
    for block in range(BLOCKS):
        point = y[:, 8 * block : 8 * block + 8]
        cell = nearest_e8(point)
        nearer = np.argsort(-((point - cell) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :PROBES]
        own.append(_hashed(cell))
        others.append([_hashed(cell + NEIGHBOURS[nearer[:, p]]) for p in range(PROBES)])
    keys = [own] + [
        [*own[:block], other, *own[block + 1 :]] for block in range(BLOCKS) for other in others[block]
    ]
    start = np.uint64(x.shape[1] * 1000 + table)
    out = []
    for parts in keys:
        key = np.full(len(x), start, np.uint64)
        for part in parts:
            key = mix(key * np.uint64(3) + part)
        out.append(key)
    return np.stack(out, axis=1)


def _hashed(cell: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cell), np.uint64)
    for axis in range(8):
        out = mix(out * np.uint64(3) + np.rint(2 * cell[:, axis]).astype(np.int64).view(np.uint64))
    return out


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as eight-bit numbers, the largest as 127, after the factor to undo it."""
    for batch in batches:
        out: list[bytes] = [b""] * batch.num_rows
        for rows, x in _by_length(batch.column("unit").to_pylist(), "<f8"):
            whole = np.rint(x * (127 / np.abs(x).max(axis=1))[:, None])
            factor = (1 / np.sqrt((whole * whole).sum(axis=1))).astype("<f4")
            for row, f, v in zip(rows.tolist(), factor, whole.astype(np.int8)):
                out[row] = f.tobytes() + v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "payload"])


def _widened(raw: np.ndarray) -> np.ndarray:
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _near(threshold: float):
    def group(table: pa.Table) -> pa.Table:
        ids, key = numbers(table.column("id")), numbers(table.column("key"))
        found = []
        for rows, raw in _by_length(table.column("payload").to_pylist(), np.uint8):
            x = _widened(raw)
            # A vector that is in many runs of the task is compared through one copy of it.
            nodes, node = np.unique(ids[rows], return_inverse=True)
            order, starts = runs(key[rows])
            left, right = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                at = order[a:b]
                close = x[at] @ x[at].T >= threshold
                p, q = np.nonzero(np.triu(close, 1))
                left.append(node[at[p]])
                right.append(node[at[q]])
            none = np.zeros(0, np.int64)
            root = local_roots(len(nodes), np.concatenate([none, *left]), np.concatenate([none, *right]))
            found.append(forest(nodes, root))
        return edge_table(found)

    return group


def _near_across(threshold: float):
    def group(table: pa.Table) -> pa.Table:
        ids, found = numbers(table.column("id")), []
        for rows, raw in _by_length(table.column("payload").to_pylist(), np.uint8):
            x = _widened(raw)
            for asking, others in by_group(table.take(pa.array(rows))):
                for part in np.array_split(asking, -(-len(asking) // AT_ONCE)):
                    p, q = np.nonzero(x[part] @ x[others].T >= threshold)
                    found.append(stars(ids[rows], part[p], others[q]))
        return edge_table(found)

    return group


def _links(threshold: float):
    def group(table: pa.Table) -> pa.Table:
        ids, copies, block = (numbers(table.column(c)) for c in ("id", "copies", "block"))
        out: list[tuple[np.ndarray, ...]] = []
        for rows, x in _by_length(table.column("unit").to_pylist(), "<f8"):
            order, starts = runs(*(numbers(table.column(c))[rows] for c in ("family", "i", "j")))
            for a, b in zip(starts[:-1], starts[1:]):
                at = order[a:b]
                of = block[rows[at]]
                same = of.min() == of.max()
                one, other = np.flatnonzero(of == of.min()), np.flatnonzero(of == of.max())
                size = copies[rows[at]]
                links, root = np.zeros(len(at), np.int64), np.arange(len(at))
                for p in np.array_split(one, -(-len(one) // AT_ONCE)):
                    for q in np.array_split(other, -(-len(other) // AT_ONCE)):
                        linked = x[at[p]] @ x[at[q]].T >= threshold
                        if same:
                            linked &= p[:, None] != q[None, :]
                        else:
                            links[q] += linked.T @ size[p]
                        links[p] += linked @ size[q]
                        left, right = np.nonzero(linked)
                        root = root[local_roots(len(at), root[p[left]], root[q[right]])[root]] if len(left) else root
                some = links > 0
                name = ids[rows[at]]
                out.append((name[some], name[root][some], links[some]))
        parts = [np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3)]
        return pa.table([pa.array(p) for p in parts], names=["id", "root", "links"])

    return group
