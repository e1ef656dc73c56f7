"""Simple-8b: several integers per 64-bit word, and token files made of such words.

The top four bits of a word select how its other 60 bits are divided: 60 values of one bit,
30 of two, and so on to one value of 60 bits. Values of more than 60 bits are escapes: selector
0, with the place of the value in a list of whole numbers beside the words. Values are coded in
blocks of 1,024; a block starts a new word, and its place is kept, so that blocks can be decoded
on their own and all words of a chunk at once.

Fixed values of the format (count, bits) by selector:
1 (60, 1), 2 (30, 2), 3 (20, 3), 4 (15, 4), 5 (12, 5), 6 (10, 6), 7 (8, 7), 8 (7, 8), 9 (6, 10),
10 (5, 12), 11 (4, 15), 12 (3, 20), 13 (2, 30), 14 (1, 60).

A token file is a Parquet part file with one row per chunk of documents:

    shard       place of the file in the order of documents
    before      ids in this shard before the chunk
    doc_ids     the documents of the chunk in order, 64-bit little-endian
    unnamed     how many of them, the last ones, have no id
    counts      ids of each, 64-bit little-endian
    n_ids       their sum
    offsets     first word of each block, 32-bit little-endian
    words       the coded ids, 64-bit little-endian
    escaped     the values of the escapes, 64-bit little-endian
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary_rows, documents_of, numbers, shuffle_partitions, text_pieces

COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 1024
BLOCKS_AT_ONCE = 256
CHUNK_IDS = 1 << 19

CHUNK = pa.schema(
    [
        ("shard", pa.int32()),
        ("before", pa.int64()),
        ("doc_ids", pa.binary()),
        ("unnamed", pa.int64()),
        ("counts", pa.binary()),
        ("n_ids", pa.int64()),
        ("offsets", pa.binary()),
        ("words", pa.binary()),
        ("escaped", pa.binary()),
    ]
)
CHUNK_DDL = (
    "shard int, before bigint, doc_ids binary, unnamed bigint, counts binary, n_ids bigint, "
    "offsets binary, words binary, escaped binary"
)


SMALL_WIDTHS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    if values.size == 0 or int(values.max()) < 1 << 16:
        return SMALL_WIDTHS[values.astype(np.uint16)]
    out = np.zeros(values.shape, np.uint8)
    rest = values
    for bits in (32, 16):
        large = rest >= np.uint64(1 << bits)
        out[large] += bits
        rest = np.where(large, rest >> np.uint64(bits), rest)
    return out + SMALL_WIDTHS[rest.astype(np.uint16)]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and escaped values, of an array of uint64."""
    values = values.astype(np.uint64, copy=False)
    words, firsts, escaped = [], [], []
    n_words = n_escaped = 0
    step = BLOCK * BLOCKS_AT_ONCE
    for at in range(0, len(values), step):
        w, f, e = _encode_blocks(values[at : at + step], n_escaped)
        words.append(w)
        firsts.append(f + n_words)
        escaped.append(e)
        n_words += len(w)
        n_escaped += len(e)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(words), np.concatenate(firsts), np.concatenate(escaped)


def _encode_blocks(values: np.ndarray, n_escaped: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blocks = -(-len(values) // BLOCK)
    most = int(COUNTS.max())
    # The places after the end of a block have no bits and so fit into any word.
    grid = np.zeros((blocks, BLOCK + most), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    widest = _window_maxima(_widths(grid))
    best = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(len(COUNTS) - 1, 0, -1):  # the last that fits holds the most values
        best[widest[int(COUNTS[selector])] <= BITS[selector]] = selector
    size = np.full(blocks, BLOCK)
    size[-1] = len(values) - BLOCK * (blocks - 1)

    # All blocks advance together, one word each per round.
    place = np.zeros(blocks, np.int64)
    active = np.arange(blocks)
    which, where, chosen = [], [], []
    while len(active):
        selector = best[active, place[active]]
        which.append(active)
        where.append(place[active])
        chosen.append(selector)
        place[active] += COUNTS[selector]
        active = active[place[active] < size[active]]
    which, where, chosen = (np.concatenate(x) for x in (which, where, chosen))
    order = np.argsort(which, kind="stable")
    which, where, chosen = which[order], where[order], chosen[order]

    words, escaped = np.zeros(len(which), np.uint64), np.zeros(0, np.uint64)
    for selector in np.unique(chosen):
        at = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[at] = np.arange(n_escaped, n_escaped + len(at), dtype=np.uint64)
            escaped = grid[which[at], where[at]]
            continue
        word = np.full(len(at), int(selector) << 60, np.uint64)
        for k in range(int(COUNTS[selector])):
            word |= grid[which[at], where[at] + k] << np.uint64(k * int(BITS[selector]))
        words[at] = word
    return words, np.searchsorted(which, np.arange(blocks)), escaped


def _window_maxima(width: np.ndarray) -> dict[int, np.ndarray]:
    """Maximum over each ``count`` places from each place of a block, for all counts of the format.

    A window is covered by two, possibly overlapping, windows of the next smaller power of two.
    """
    powers, n = {1: width}, 1
    while 2 * n <= int(COUNTS.max()):
        powers[2 * n] = np.maximum(powers[n][:, :-n], powers[n][:, n:])
        n *= 2
    out = {}
    for count in set(COUNTS.tolist()):
        half = 1 << (count.bit_length() - 1)
        whole = powers[half]
        out[count] = np.maximum(whole[:, :BLOCK], whole[:, count - half : count - half + BLOCK])
    return out


def decode(words: np.ndarray, firsts: np.ndarray, n: int, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` values of coded blocks."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    block = np.searchsorted(firsts, np.arange(len(words)), side="right") - 1
    passed = np.cumsum(counts) - counts
    place = block * BLOCK + passed - passed[firsts][block]
    end = np.minimum((block + 1) * BLOCK, n)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        if s == 0:
            out[place[at]] = escaped[payload[at].astype(np.int64)]
            continue
        bits, mask = int(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            target = place[at] + k
            inside = target < end[at]
            out[target[inside]] = (payload[at[inside]] >> np.uint64(k * bits)) & mask
    return out


Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def write_token_files(
    docs: DataFrame,
    folder: str,
    encoder: Encoder,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all texts to ``folder``, documents in ascending order of their id.

    ``encoder`` turns a column of texts into all ids and their number per text; ``end_id`` is
    added to each document. Null text counts as empty. Rows that repeat an id follow each other in
    the order of their texts; so do those without an id, at the end.
    """
    docs = documents_of(docs, id_col, text_col)
    by_id = [F.col("doc_id").isNull(), F.col("doc_id")]
    in_order = docs.repartitionByRange(
        shuffle_partitions(docs.sparkSession), *by_id
    ).sortWithinPartitions(*by_id, "text")
    in_order.mapInArrow(_chunks(encoder, end_id), CHUNK_DDL).write.parquet(folder)


def _chunks(encoder: Encoder, end_id: int | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = unnamed = 0
        for whole in batches:
            for batch in text_pieces(whole):
                ids, counts = encoder(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                names = batch.column("doc_id")
                unnamed += names.null_count
                held.append((numbers(names.fill_null(0)), counts, ids))
                n += len(ids)
                if n >= CHUNK_IDS:
                    yield _chunk(shard, before, unnamed, held)
                    before, held, n, unnamed = before + n, [], 0, 0
        if held:
            yield _chunk(shard, before, unnamed, held)

    return task


def _chunk(shard: int, before: int, unnamed: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    docs, counts, ids = (np.concatenate(x) for x in zip(*held))
    words, firsts, escaped = encode(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()),
            pa.array([before], pa.int64()),
            binary_rows([docs.astype("<i8")]),
            pa.array([unnamed], pa.int64()),
            binary_rows([counts.astype("<i8")]),
            pa.array([len(ids)], pa.int64()),
            binary_rows([firsts.astype("<u4")]),
            binary_rows([words.astype("<u8")]),
            binary_rows([escaped.astype("<u8")]),
        ],
        schema=CHUNK,
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document; ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before. Only the number of ids per shard is
    brought together for it.
    """
    chunks = spark.read.schema(CHUNK_DDL).parquet(folder)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        chunks.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    docs = chunks.drop("n_ids").mapInArrow(
        _documents, "shard int, doc_id bigint, place bigint, n_tokens bigint, ids binary"
    )
    # One row per part file of the folder.
    return docs.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids"
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            docs, counts = (np.frombuffer(one[c], "<i8") for c in ("doc_ids", "counts"))
            words, escaped = (np.frombuffer(one[c], "<u8") for c in ("words", "escaped"))
            firsts = np.frombuffer(one["offsets"], "<u4").astype(np.int64)
            ids = decode(words, firsts, int(counts.sum()), escaped).astype("<u4")
            ends = np.cumsum(counts)
            named = np.arange(len(docs)) < len(docs) - one["unnamed"]
            offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
            column = pa.Array.from_buffers(
                pa.large_binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(docs), one["shard"], np.int32)),
                    pa.array(docs, mask=~named),
                    pa.array(one["before"] + ends - counts),
                    pa.array(counts),
                    column.cast(pa.binary()) if offsets[-1] < 2**31 else column,
                ],
                ["shard", "doc_id", "place", "n_tokens", "ids"],
            )
