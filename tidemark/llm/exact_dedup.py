"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

Documents are equal when their texts are equal after each run of white space
(``[\\x20\\x09-\\x0D]+``) became one space. Only what may have a copy is compared byte by byte:

1. One scan writes a fingerprint of 64 bits and the SHA-256 of each normalised text. Each task that
   reads them cuts its rows into blocks, whatever Arrow batches they come in. A block has 65,536 documents, or
   more in a larger table: with block and owner growing as the root of the number of documents, a
   message still has ``MESSAGE_ROWS`` fingerprints on average.
2. Each block sends every owner (a range of fingerprints) the sorted distinct fingerprints it
   has there, Golomb-coded. A fingerprint that thousands of documents of a block share is sent
   once, so no owner gets more of a hot fingerprint than one value per block.
3. An owner answers each block with a bitmap: which of its fingerprints occur elsewhere. The
   block adds those that it has more than once itself. These documents are the suspects.
4. The suspects' texts alone are grouped by their bytes, partly before the shuffle.

Null text counts as empty. Rows without an id are kept, as copies of the smallest id of their
text or, where no row of the text has an id, on their own. Rows that repeat an id are rows of
their own; all rows that carry the kept id are kept. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golomb
from tidemark.llm.common import documents_of, join_uneven, numbers, saved, shuffle_partitions

BLOCK_ROWS = 1 << 16
OWNER_ROWS = 500_000
MESSAGE_ROWS = 64


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    docs = documents_of(docs, id_col, text_col)
    norm = normalised("text")
    prints = saved(
        docs.select(
            "doc_id",
            F.xxhash64(norm).alias("print"),
            F.unhex(F.sha2(norm, 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "prints",
    )
    total = prints.count()
    block = block_rows(total)
    owners = max(shuffle_partitions(docs.sparkSession), -(-total // max(OWNER_ROWS, block)))
    messages = saved(coded_messages(prints, owners, block), "messages")
    answers = (
        messages.select("owner", "piece", "code")
        .groupBy("owner")
        .applyInArrow(_answers, "piece bigint, owner int, found binary")
    )
    rows = (
        messages.select("piece", "owner", "rows", "again")
        .join(answers, ["piece", "owner"])
        .mapInArrow(_suspect_rows, "row bigint")
    )
    # A row number is the place in the scan that was written, and with it the document.
    suspects = prints.join(rows, "row", "left_semi").select("doc_id")
    suspects = saved(suspects.filter(F.col("doc_id").isNotNull()).distinct(), "suspects")
    # Without an id a document cannot be asked for; these are compared in any case.
    texts = docs.join(suspects.hint("shuffle_hash"), "doc_id", "left_semi").union(
        docs.filter(F.col("doc_id").isNull())
    )
    groups = (
        texts.select("doc_id", norm.alias("norm"))
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = saved(groups, "groups")
    result = join_uneven(prints.select("doc_id", "sha"), "sha", groups, "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return result.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def block_rows(total: int) -> int:
    """Documents per block, for messages of ``MESSAGE_ROWS`` fingerprints where owners are as large as blocks."""
    return max(BLOCK_ROWS, math.isqrt(MESSAGE_ROWS * total))


def coded_messages(prints: DataFrame, owners: int, block: int) -> DataFrame:
    """One row per block and owner with fingerprints in common; the columns ``row`` and ``print`` are read."""
    return prints.select("row", "print").mapInArrow(
        _coded(owners, block), "piece bigint, owner int, code binary, rows binary, again binary"
    )


def _coded(owners: int, block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            row, prints = numbers(batch.column("row")), numbers(batch.column("print")).view(np.uint64)
            while waiting + len(row) >= block:
                fits = block - waiting
                held.append((prints[:fits], row[:fits]))
                yield _message(*map(np.concatenate, zip(*held)), owners)
                row, prints, held, waiting = row[fits:], prints[fits:], [], 0
            if len(row):
                held.append((prints, row))
                waiting += len(row)
        if held:
            yield _message(*map(np.concatenate, zip(*held)), owners)

    return task


def _message(prints: np.ndarray, row: np.ndarray, owners: int) -> pa.RecordBatch:
    order = np.argsort(prints, kind="stable")
    prints, row = prints[order], row[order]
    owner = ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    out = {"piece": [], "owner": [], "code": [], "rows": [], "again": []}
    bounds = np.searchsorted(owner, np.arange(owners + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[k], bounds[k + 1])
        values, counts = np.unique(prints[part], return_counts=True)
        out["piece"].append(int(row.min()))  # a row is in one piece, so this names the piece
        out["owner"].append(int(k))
        out["code"].append(golomb.encode(values))
        out["rows"].append(row[part].tobytes())
        out["again"].append(counts.astype(np.int64).tobytes())
    return pa.RecordBatch.from_pydict(
        out,
        pa.schema(
            [("piece", pa.int64()), ("owner", pa.int32()), ("code", pa.binary()), ("rows", pa.binary()), ("again", pa.binary())]
        ),
    )


def _answers(table: pa.Table) -> pa.Table:
    """Which fingerprints of each piece other pieces have as well, as a bitmap."""
    lists = [golomb.decode(code) for code in table.column("code").to_pylist()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    found = [
        np.packbits(np.isin(one, shared, assume_unique=True)).tobytes() for one in lists
    ]
    return pa.table(
        {
            "piece": table.column("piece"),
            "owner": table.column("owner"),
            "found": pa.array(found, pa.binary()),
        }
    )


def _suspect_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        picked = []
        for rows, again, found in zip(*(batch.column(c).to_pylist() for c in ("rows", "again", "found"))):
            counts = np.frombuffer(again, np.int64)
            bits = np.unpackbits(np.frombuffer(found, np.uint8))[: len(counts)].astype(bool)
            picked.append(np.frombuffer(rows, np.int64)[np.repeat(bits | (counts > 1), counts)])
        if picked:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked))], ["row"])
