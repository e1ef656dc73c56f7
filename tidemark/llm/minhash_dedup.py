"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

Documents are linked when the Jaccard similarity of their sets of word shingles is at least a
threshold; the result is the connected component of each document.

1. A document's signature has 64 symbols of 16 bits, one per hash function; its distance to
   another is the number of symbols that differ. For two sets with similarity 0.8, each symbol
   differs with probability 0.2, and 30 or more differ with a probability of about one in a
   million. All pairs with at most 29 differing symbols are therefore to be found.
2. By the pigeonhole principle, 29 errors in 15 chunks leave a chunk with at most one. Each
   chunk is indexed once for every symbol that may be wrong, by its other symbols: 64 keys per
   document, and every pair within the distance shares one.
3. Among the documents that share a key, those within the distance are joined into families
   (a spanning forest per task, then connected components).
4. Within a family documents are compared on their full sets of shingle hashes (64 bits). The links
   found there are the exact ones; their components are the result.

Only components are wanted, so a key of more than ``KEY_BLOCK`` documents, and a family of more than
``FAMILY_BLOCK`` or ``FAMILY_BYTES``, is not compared pair by pair: all are compared with a few first, then
what stays apart with all (``clusters.edges_in_large_groups``).

Documents with equal sets are one class from the start and enter steps 2 to 4 once.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z. A text with fewer words than a shingle
has its whole word sequence as its only one. Null and empty texts and texts without words have
an empty set and are linked with nothing. Rows without an id cannot be named in a result and are
left out; rows that repeat an id count as one document where they link. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.clusters import (
    EDGES_DDL,
    by_group,
    edge_table,
    edges_in_large_groups,
    fixed_width,
    forest,
    in_shared_keys,
    runs,
    stars,
    with_blocks,
)
from tidemark.llm.common import (
    binary_rows,
    components,
    documents_of,
    join_uneven,
    local_roots,
    numbers,
    saved,
    shuffle_partitions,
    string_buffer,
    text_pieces,
)
from tidemark.llm.hashing import distinct_per_text, mix, shingle_hashes

SYMBOLS = 64
CHUNKS = 15
MAX_ERRORS = 29
SMALL_RUN = 32
KEY_BLOCK = 4096
FAMILY_BLOCK = 2048
FAMILY_BYTES = 32 << 20
TASK_ROWS = 500_000

_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def left_out_keys() -> list[tuple[int, ...]]:
    """The symbol positions that form each key: a chunk without the symbols that may be wrong."""
    errors = MAX_ERRORS // CHUNKS
    chunks = np.array_split(np.arange(SYMBOLS), CHUNKS)
    return [kept for chunk in chunks for kept in combinations(chunk.tolist(), len(chunk) - errors)]


KEYS = left_out_keys()


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * (shared shingles) >= ``percent`` * (shingles of either).
    The signature's distance is set for 80 per cent and more. ``component_id`` is the smallest
    id reachable over links; a document is kept when it is its own.
    """
    if percent < 80:
        raise ValueError("signatures guarantee links of 80 per cent and more")
    docs = documents_of(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    partitions = shuffle_partitions(docs.sparkSession)
    signed = saved(
        docs.mapInArrow(_signed(width), "doc_id bigint, n int, digest binary, signature binary"),
        "signatures",
    )
    total = signed.count()
    filled = signed.filter("n > 0")
    classes = saved(
        filled.groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
        total,
    )
    several = saved(
        signed.join(classes.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select(
            "doc_id", "n", "signature"
        ),
        "representatives",
        total,
    )

    keys = several.select("doc_id", "signature").mapInArrow(_keyed, "key bigint, id bigint")
    tasks = max(partitions, -(-total * len(KEYS) // (4 * TASK_ROWS)))
    near = in_shared_keys(
        keys, several.select(F.col("doc_id").alias("id"), F.col("signature").alias("payload")),
        total * len(KEYS), KEY_BLOCK, tasks, _near, _near_across,
    )
    families = saved(components(near).select(F.col("id").alias("doc_id"), F.col("root").alias("family")), "families", total)

    n_members = families.count()
    sizes = several.groupBy("doc_id").agg(F.sum(F.lit(8) * F.col("n")).alias("bytes"))
    members = saved(
        with_blocks(families.join(sizes, "doc_id"), "family", "doc_id", FAMILY_BLOCK, n_members, "bytes", FAMILY_BYTES),
        "members",
        n_members,
    )

    def sets_of(some: DataFrame) -> DataFrame:
        rows = docs.join(some.select("doc_id", "family", "blocks").hint("shuffle_hash"), "doc_id")
        return rows.mapInArrow(_sets(width), "id bigint, group bigint, blocks int, payload binary")

    task = F.pmod(F.xxhash64("group"), F.lit(max(partitions, n_members // 4000)))
    links = (
        sets_of(members.filter("blocks = 1"))
        .select(task.alias("task"), "group", "id", "payload")
        .groupBy("task")
        .applyInArrow(_linked(percent), EDGES_DDL)
    )
    cut = members.filter("blocks > 1")
    if not cut.isEmpty():
        # Rows that repeat an id, or that equal another, are compared through one of each text.
        large = saved(sets_of(cut).dropDuplicates(["group", "id", "payload"]), "large-families")
        links = links.union(edges_in_large_groups(large, _linked_across(percent), FAMILY_BLOCK))
    roots = saved(components(links), "components", n_members)

    groups = classes.join(roots, classes["doc_id"] == roots["id"], "left").select(
        "digest", F.coalesce("root", "doc_id").alias("component"), "copies"
    )
    result = join_uneven(
        signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")),
        "digest",
        groups,
        "copies",
        total,
    )
    component = F.coalesce("component", "doc_id")
    return result.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )


def signatures(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` symbols per set of hashes; empty sets get zeros."""
    out = np.zeros((len(begin) - 1, SYMBOLS), np.uint16)
    filled = np.flatnonzero(np.diff(begin))
    if len(filled):
        starts = begin[:-1][filled]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(flat * FACTORS[k], starts)
            out[filled, k] = mix(least + np.uint64(k)) & np.uint64(0xFFFF)
    return out


def _signed(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_pieces(whole):
                offsets, data = string_buffer(batch.column("text"))
                flat, begin = distinct_per_text(*shingle_hashes(data, offsets, width))
                digest = np.zeros((batch.num_rows, 2), np.uint64)
                filled = np.flatnonzero(np.diff(begin))
                if len(filled):
                    starts = begin[:-1][filled]
                    digest[filled, 0] = np.add.reduceat(mix(flat + np.uint64(11)), starts)
                    digest[filled, 1] = np.add.reduceat(mix(flat + np.uint64(13)), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(begin).astype(np.int32)),
                        binary_rows(digest),
                        binary_rows(signatures(flat, begin)),
                    ],
                    ["doc_id", "n", "digest", "signature"],
                )

    return task


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            signature = fixed_width(pa.chunked_array([batch.column("signature")]), SYMBOLS, np.uint16)
            ids = numbers(batch.column("doc_id"))
            keys = np.empty((len(KEYS), len(ids)), np.uint64)
            for k, positions in enumerate(KEYS):
                key = np.full(len(ids), k + 1, np.uint64)
                for p in positions:
                    key = mix(key * np.uint64(3) + signature[:, p])
                keys[k] = key
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(ids, len(KEYS)))],
                ["key", "id"],
            )


def _near(table: pa.Table) -> pa.Table:
    """A spanning forest, per task, of the pairs that share a key and are within the distance."""
    ids = numbers(table.column("id"))
    symbols = _bytes_of(table)
    order, starts = runs(numbers(table.column("key")))
    sizes = np.diff(starts)
    run = np.repeat(np.arange(len(sizes)), sizes)
    # Copies of a document in many runs are one node of the forest.
    nodes, node = np.unique(ids, return_inverse=True)
    left, right = [], []
    small = order[(sizes <= SMALL_RUN)[run]]
    small_run = run[(sizes <= SMALL_RUN)[run]]
    for shift in range(1, SMALL_RUN):
        at = np.flatnonzero(small_run[shift:] == small_run[:-shift])
        if not len(at):
            break
        pair = np.unique(node[small[at]] * len(nodes) + node[small[at + shift]], return_index=True)[1]
        at = at[pair]
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            a, b = small[part], small[part + shift]
            close = (symbols[a] != symbols[b]).sum(axis=1) <= MAX_ERRORS
            left.append(node[a[close]])
            right.append(node[b[close]])
    for r in np.flatnonzero(sizes > SMALL_RUN):
        rows = order[starts[r] : starts[r + 1]]
        for a, b in _search(symbols[rows]):
            left.append(np.full(len(b), node[rows[a]]))
            right.append(node[rows[b]])
    root = local_roots(
        len(nodes),
        np.concatenate(left) if left else np.zeros(0, np.int64),
        np.concatenate(right) if right else np.zeros(0, np.int64),
    )
    return edge_table([forest(nodes, root)])


def _bytes_of(table: pa.Table) -> np.ndarray:
    """One byte per symbol: more pairs may pass than with two, none fewer."""
    return fixed_width(table.column("payload"), SYMBOLS, np.uint16).astype(np.uint8)


def _near_across(table: pa.Table) -> pa.Table:
    ids, symbols = numbers(table.column("id")), _bytes_of(table)
    found = []
    for asking, others in by_group(table):
        left, right = [], []
        for a in asking.tolist():
            close = others[(symbols[others] != symbols[a]).sum(axis=1) <= MAX_ERRORS]
            left.append(np.full(len(close), a))
            right.append(close)
        found.append(stars(ids, np.concatenate(left), np.concatenate(right)))
    return edge_table(found)


def _search(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth-first search: each reached row, with the rows that it is the first to reach."""
    waiting = np.arange(len(symbols))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            a = queue.pop()
            close = (symbols[waiting] != symbols[a]).sum(axis=1) <= MAX_ERRORS
            if close.any():
                yield a, waiting[close]
                queue.extend(waiting[close].tolist())
                waiting = waiting[~close]


def _sets(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_pieces(whole):
                offsets, data = string_buffer(batch.column("text"))
                flat, begin = distinct_per_text(*shingle_hashes(data, offsets, width))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("doc_id", "family", "blocks")),
                        binary_rows(flat[a:b] for a, b in zip(begin[:-1], begin[1:])),
                    ],
                    ["id", "group", "blocks", "payload"],
                )

    return task


def _linked(percent: int):
    def group(table: pa.Table) -> pa.Table:
        ids, shingles = numbers(table.column("id")), table.column("payload")
        order, starts = runs(numbers(table.column("group")))
        found = []
        for a, b in zip(starts[:-1], starts[1:]):
            rows = order[a:b]
            left, right = linked_pairs(_sets_in(shingles, rows), np.zeros(len(rows), np.int8), percent)
            found.append(forest(ids[rows], local_roots(len(rows), left, right)))
        return edge_table(found)

    return group


def _linked_across(percent: int):
    def group(table: pa.Table) -> pa.Table:
        ids, shingles = numbers(table.column("id")), table.column("payload")
        found = []
        for asking, others in by_group(table):
            rows = np.concatenate([asking, others])
            side = np.repeat(np.array([0, 1], np.int8), [len(asking), len(others)])
            left, right = linked_pairs(_sets_in(shingles, rows), side, percent)
            found.append(stars(ids, rows[left], rows[right]))
        return edge_table(found)

    return group


def _sets_in(shingles: pa.ChunkedArray, rows: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(shingles[int(r)].as_buffer(), np.uint64) for r in rows]


def linked_pairs(
    sets: list[np.ndarray], block: np.ndarray, percent: int, columns: int = 4096
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets that are similar enough; across blocks, if there are two."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * both >= percent * (int(sizes.sum()) - both)
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if linked else (np.zeros(0, np.int64),) * 2
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    use = common[which]
    owner, which = owner[use], number[which[use]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    first, second = np.flatnonzero(block == block.min()), np.arange(len(sets))
    if block.min() != block.max():
        second = np.flatnonzero(block == block.max())
    shared = np.zeros((len(first), len(second)), np.float32)
    n = int(common.sum())
    for at in range(0, n, columns):
        part = slice(*np.searchsorted(which, [at, at + columns]))
        here = np.zeros((len(sets), min(columns, n - at)), np.float32)
        here[owner[part], which[part] - at] = 1
        shared += here[first] @ here[second].T
    shared = np.rint(shared).astype(np.int64)
    linked = 100 * shared >= percent * (sizes[first][:, None] + sizes[second][None, :] - shared)
    linked &= first[:, None] != second[None, :]
    at, to = np.nonzero(linked)
    return first[at], second[to]
