"""Removing passages that an earlier document has as well, by sorting suffixes.

A byte of a document goes if it lies in a string of ``length`` bytes that also starts somewhere in
a document with a smaller id. All such strings are found, whatever documents they are in:

1. Of equal texts only the one with the smallest id can be an earlier document for others; the
   rest go as a whole (if they have ``length`` bytes).
2. Each string of ``length`` bytes is represented by the one of its ``GRAM``-byte parts that has
   the smallest hash, its anchor. Equal strings have equal anchors, and neighbouring strings
   mostly the same one, so there are far fewer anchors than bytes.
3. Documents are dealt into blocks. Each block sends every owner (a range of anchors) the sorted
   distinct anchors it has there, Golomb-coded, and gets back a bitmap of those that occur in
   another document.
4. Only the strings of repeated anchors are sorted. A block sends equal stretches once, with the
   smallest id that has them; the other documents that have them are settled already. An anchor
   that very many blocks have is dealt by the whole strings instead, so that no task gets all of it.
5. The task of an anchor range sorts its suffixes to ``length`` bytes, deep-shallow: multikey
   quicksort by eight-byte characters to a shallow depth, in which all groups of all anchors take
   a step together, then a blind trie for each group that still has a long common prefix. Equal
   suffixes end in one leaf; all but those of the smallest id are removed.
6. The removed stretches go back to their blocks, which cut them out.

The texts are shuffled once, by block; the three steps that read them share that shuffle. Strings
are judged on the input, not on what is left. Null text counts as empty. Documents without an id
lose nothing and remove nothing; rows that repeat an id are neither earlier than each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golomb
from tidemark.llm.common import (
    join_uneven,
    numbers,
    saved,
    shuffle_partitions,
    string_buffer,
    with_columns_of,
)
from tidemark.llm.hashing import BASE, BYTE_VALUES, INVERSE, mix, powers

GRAM = 24
BLOCK_BYTES = 2 << 20
PIECE = 1 << 18
OWNER_BYTES = 16 << 20
HOT_BLOCKS = 1024
SHALLOW = 2  # eight-byte characters
CHUNK_STRINGS = 100_000

RUNS = [("doc", np.int64), ("row", np.int64), ("start", np.int64), ("count", np.int64), ("anchor", np.uint64)]


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    as_text: bool = False,
    hot_blocks: int = HOT_BLOCKS,
) -> DataFrame:
    """All columns of ``docs`` with ``n_bytes``, ``removed`` and ``kept_bytes``.

    ``removed`` lists the maximal removed stretches (start and end in bytes of the UTF-8 text),
    ``kept_bytes`` are the other bytes. With ``as_text`` they are a string, without the bytes of
    characters that were cut apart. An anchor that ``hot_blocks`` blocks have is hot. Columns of ``docs`` with one of these names, or beginning with
    an underscore, are left out.
    """
    columns = [c for c in docs.columns if not c.startswith("_") and c not in ("n_bytes", "removed", "kept_bytes")]
    kept_kind = "string" if as_text else "binary"
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(
        *(docs[c] for c in columns),
        docs[id_col].cast("bigint").alias("_id"),
        text.alias("_text"),
        F.xxhash64(text).alias("_print"),
    )
    named = source.filter(F.col("_id").isNotNull())
    partitions = shuffle_partitions(docs.sparkSession)

    facts = saved(
        named.select(
            "_id", "_print", F.unhex(F.sha2("_text", 256)).alias("sha"), F.octet_length("_text").alias("bytes")
        ),
        "texts",
    )
    sums = facts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes").cast("bigint")).alias("bytes")).first()
    n, n_bytes = sums["n"], sums["bytes"] or 0
    blocks = max(partitions, -(-n_bytes // BLOCK_BYTES))
    anchor_owners = max(partitions, n_bytes // (8 * OWNER_BYTES))
    string_owners = max(partitions, -(-2 * n_bytes // OWNER_BYTES))
    # Of a hash, so that blocks do not follow the order of the ids.
    block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("_block")

    firsts = facts.groupBy("sha").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = saved(
        join_uneven(facts.select("_id", "_print", "sha"), "sha", firsts, "copies", n)
        .filter(F.col("_id") > F.col("first"))
        .select(block, "_id", "_print"),
        "copies",
    )
    # Shuffled once; the plan below uses it three times.
    texts = named.withColumn("_block", block).groupBy("_block")

    messages = (
        texts.cogroup(copies.groupBy("_block"))
        .applyInArrow(_anchors(length, anchor_owners), "block bigint, owner bigint, code binary, several binary")
    )
    answers = messages.groupBy("owner").applyInArrow(_answers(hot_blocks), "block bigint, owner bigint, kind int, id bigint, data binary, more binary")
    as_answers = copies.select(
        F.col("_block").alias("block"), F.lit(0).cast("bigint").alias("owner"), F.lit(COPY).alias("kind"),
        F.col("_id").alias("id"), F.lit(None).cast("binary").alias("data"),
        F.col("_print").cast("string").cast("binary").alias("more"),
    )
    strings = (
        texts.cogroup(answers.union(as_answers).groupBy("block"))
        .applyInArrow(
            _strings(length, anchor_owners, string_owners),
            "owner bigint, block bigint, kind int, data binary",
        )
    )
    removed = strings.groupBy("owner").applyInArrow(_sorted(length), "block bigint, id bigint, kind int, data binary")
    final = removed.union(
        as_answers.select("block", "id", F.col("kind"), F.col("more").alias("data"))
    )
    added = f"n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept_bytes {kept_kind}"
    shape = with_columns_of(docs.select(*columns), added)
    result = texts.cogroup(final.groupBy("block")).applyInArrow(_cut(length, columns, as_text), shape)
    unnamed = source.filter(F.col("_id").isNull()).select(
        *columns,
        F.octet_length("_text").cast("bigint").alias("n_bytes"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("removed"),
        F.col("_text").cast(kept_kind).alias("kept_bytes"),
    )
    return result.union(unnamed)


COPY, BITMAP, SETTLED, STRINGS = range(4)


def window_runs(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of strings of ``length`` bytes with the same anchor, for the given texts of a buffer.

    ``row`` is the text, ``start`` the place of the first string in the buffer, ``count`` how many
    strings follow each other, ``anchor`` 48 bits of the anchor's hash. Worked in pieces of
    ``PIECE`` bytes, so that memory does not grow with a text.
    """
    width = length - GRAM + 1
    mask = np.uint64((1 << 24) - 1)
    parts: list[tuple[np.ndarray, ...]] = []
    wanted = np.zeros(len(offsets) - 1, bool)
    wanted[rows] = True
    for at in range(0, max(0, int(offsets[-1]) - length + 1), PIECE):
        part = data[at : at + PIECE + length - 1]
        n = len(part)
        if n < length:
            break
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * powers(BASE, n), out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, n - GRAM + 1))
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least & mask).astype(np.int64)
        first, last = np.searchsorted(offsets, [at, at + len(anchor)], side="right")
        inner = offsets[first:last] - at
        inner = inner[inner < len(anchor)]
        change = np.ones(len(anchor), bool)
        change[1:] = anchor[1:] != anchor[:-1]
        change[inner] = True
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, len(anchor)))
        row = np.searchsorted(offsets, start + at, side="right") - 1
        # Strings must end within their text.
        count = np.minimum(count, offsets[row + 1] - length + 1 - (start + at))
        use = (count > 0) & wanted[row]
        # Smallest hashes are small; mixed again, they spread evenly over the owners.
        spread = mix(grams[anchor[start[use]]] + np.uint64(1)) >> np.uint64(16)
        parts.append((row[use], start[use] + at, count[use], spread))
    if not parts:
        return {k: np.zeros(0, t) for k, t in RUNS if k != "doc"}
    row, start, count, anchor = (np.concatenate(p) for p in zip(*parts))
    return {"row": row, "start": start, "count": count, "anchor": anchor}


def _text_rows(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    if not table.num_rows:
        return table, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets, data = string_buffer(table.column("_text").chunk(0))
    return table, numbers(table.column("_id")), numbers(table.column("_print")), offsets, data


def _without(ids: np.ndarray, prints: np.ndarray, copy_ids: np.ndarray, copy_prints: np.ndarray) -> np.ndarray:
    """Which rows are not among the copies."""
    if not len(copy_ids) or not len(ids):
        return np.ones(len(ids), bool)
    copies = set(zip(copy_ids.tolist(), copy_prints.tolist()))
    return np.array([pair not in copies for pair in zip(ids.tolist(), prints.tolist())])


def _shifts(ids: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Where the places of each row's text begin: 0, but apart for other texts of the same id."""
    order = np.lexsort((prints, ids))
    one, two = ids[order], prints[order]
    new_id, new_text = np.ones(len(ids), bool), np.ones(len(ids), bool)
    new_id[1:] = one[1:] != one[:-1]
    new_text[1:] = new_id[1:] | (two[1:] != two[:-1])
    number = np.cumsum(new_text)
    out = np.empty(len(ids), np.int64)
    out[order] = (number - number[_heads(new_id)]) << 40 if len(ids) else 0
    return out


def _owners(anchor: np.ndarray, owners: int) -> np.ndarray:
    return ((anchor >> np.uint64(16)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _anchors(length: int, owners: int):
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "owner": [], "code": [], "several": []}
        table, ids, prints, offsets, data = _text_rows(left)
        if table.num_rows:
            own = _without(ids, prints, numbers(right.column("_id")), numbers(right.column("_print")))
            found = window_runs(data, offsets, np.flatnonzero(own), length)
            doc = ids[found["row"]]
            order = np.lexsort((doc, found["anchor"]))
            anchor, doc = found["anchor"][order], doc[order]
            values, first = np.unique(anchor, return_index=True)
            # In several documents of this block if the first and the last one differ.
            last = np.append(first[1:], len(anchor)) - 1
            several = doc[first] != doc[last] if len(values) else np.zeros(0, bool)
            bounds = np.searchsorted(_owners(values, owners), np.arange(owners + 1))
            block = int(numbers(table.column("_block"))[0])
            for k in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[k], bounds[k + 1])
                out["block"].append(block)
                out["owner"].append(int(k))
                out["code"].append(golomb.encode(values[part]))
                out["several"].append(np.packbits(several[part]).tobytes())
        return pa.table(
            out, pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("code", pa.binary()), ("several", pa.binary())])
        )

    return group


ANSWER = pa.schema(
    [("block", pa.int64()), ("owner", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("data", pa.binary()), ("more", pa.binary())]
)


def _answers(hot_blocks: int):
    """For each block's list: the repeated anchors among it, and which of these are hot."""

    def group(table: pa.Table) -> pa.Table:
        lists = [golomb.decode(code) for code in table.column("code").to_pylist()]
        values, which, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(one) for one in lists])
        data, more = [], []
        for one, end, several in zip(lists, ends.tolist(), table.column("several").to_pylist()):
            at = which[end - len(one) : end]
            inside = np.unpackbits(np.frombuffer(several, np.uint8))[: len(one)].astype(bool)
            repeated = inside | (counts[at] > 1)
            data.append(golomb.encode(one[repeated]))
            more.append(np.packbits(counts[at][repeated] >= hot_blocks).tobytes())
        n = table.num_rows
        return pa.table(
            [
                table.column("block"), table.column("owner"), pa.array([BITMAP] * n, pa.int32()),
                pa.nulls(n, pa.int64()), pa.array(data, pa.binary()), pa.array(more, pa.binary()),
            ],
            schema=ANSWER,
        )

    return group


def _copies_in(right: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(numbers(right.column("kind")) == COPY)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = right.take(pa.array(rows))
    return numbers(part.column("id")), np.array([int(x) for x in part.column(column).to_pylist()], np.int64)


STRING_ROWS = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _strings(length: int, anchor_owners: int, owners: int):
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"owner": [], "block": [], "kind": [], "data": []}
        table, ids, prints, offsets, data = _text_rows(left)
        lists = [] if not right.num_rows else np.flatnonzero(numbers(right.column("kind")) == BITMAP).tolist()
        if table.num_rows and lists:
            block = int(numbers(table.column("_block"))[0])
            own = _without(ids, prints, *_copies_in(right, "more"))
            answers = [(golomb.decode(right.column("data")[i].as_py()), right.column("more")[i].as_py()) for i in lists]
            values = np.concatenate([v for v, _ in answers])
            hot = np.concatenate(
                [np.unpackbits(np.frombuffer(b, np.uint8))[: len(v)].astype(bool) for v, b in answers]
            )
            order = np.argsort(values)
            values, hot = values[order], hot[order]
            if len(values):
                found = window_runs(data, offsets, np.flatnonzero(own), length)
                place = np.minimum(np.searchsorted(values, found["anchor"]), len(values) - 1)
                use = values[place] == found["anchor"]
                runs = {k: v[use] for k, v in found.items()}
                runs = _single_if_hot(runs, hot[place[use]], data, length)
                for owner, kind, blob in _dealt(runs, ids, offsets[:-1] - _shifts(ids, prints), data, length, owners, block):
                    out["owner"].append(owner)
                    out["block"].append(block)
                    out["kind"].append(kind)
                    out["data"].append(blob)
        return pa.table(out, STRING_ROWS)

    return group


def _single_if_hot(runs: dict[str, np.ndarray], hot: np.ndarray, data: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of hot anchors as single strings, each with a hash of all its bytes as its anchor."""
    if not hot.any():
        return runs
    cold = {k: v[~hot] for k, v in runs.items()}
    times = runs["count"][hot]
    row = np.repeat(runs["row"][hot], times)
    start = np.repeat(runs["start"][hot], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    anchor = _content_hash(data, start, np.full(len(start), length)) >> np.uint64(16)
    single = {"row": row, "start": start, "count": np.ones(len(start), np.int64), "anchor": anchor}
    return {k: np.concatenate([cold[k], single[k]]) for k in cold}


def _content_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each stretch; stretches may overlap. For choosing equals, not proving."""
    out = np.zeros(len(start), np.uint64)
    for k in range(0, int(size.max()) if len(size) else 0):
        inside = k < size
        at = np.minimum(start + k, len(data) - 1)
        out = np.where(inside, (out ^ data[at]) * np.uint64(0x100000001B3) + np.uint64(1), out)
    return mix(out + size.astype(np.uint64))


def _stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after the other."""
    shift = start - (np.cumsum(size) - size)
    return data[np.arange(int(size.sum())) + np.repeat(shift, size)]


def _dealt(
    runs: dict[str, np.ndarray], ids: np.ndarray, zero: np.ndarray, data: np.ndarray, length: int, owners: int, block: int
) -> Iterator[tuple[int, int, bytes]]:
    """What a block sends for its repeated anchors, one message per owner, and what it settles itself."""
    if not len(runs["row"]):
        return
    size = runs["count"] + length - 1
    doc = ids[runs["row"]]
    content = _content_hash(data, runs["start"], size) ^ runs["anchor"]
    order = np.lexsort((doc, size, content))
    content, size, doc = content[order], size[order], doc[order]
    runs = {k: v[order] for k, v in runs.items()}
    same = np.zeros(len(order), bool)
    same[1:] = (content[1:] == content[:-1]) & (size[1:] == size[:-1])
    # Hashes only propose: a stretch counts as the same if all its bytes are those of the one before.
    at = np.flatnonzero(same)
    if len(at):
        differ = _stretches(data, runs["start"][at], size[at]) != _stretches(data, runs["start"][at - 1], size[at])
        begin = np.cumsum(size[at]) - size[at]
        same[at] = np.add.reduceat(differ.astype(np.int64), begin) == 0
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    settled = same & (doc > doc[first])
    local = runs["start"] - zero[runs["row"]]
    if settled.any():
        spans = np.stack([doc[settled], local[settled], local[settled] + size[settled]], axis=1)
        yield block % owners, SETTLED, spans.astype("<i8").tobytes()
    send = ~same | (doc == doc[first])
    owner = _owners(runs["anchor"], owners)
    order = np.flatnonzero(send)
    order = order[np.argsort(owner[order], kind="stable")]
    bounds = np.searchsorted(owner[order], np.arange(owners + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        at = order[bounds[k] : bounds[k + 1]]
        head = np.stack([doc[at], local[at], runs["count"][at], runs["anchor"][at].view(np.int64)], axis=1)
        body = _stretches(data, runs["start"][at], size[at])
        yield k, STRINGS, len(at).to_bytes(8, "little") + head.astype("<i8").tobytes() + body.tobytes()


def _sorted(length: int):
    def group(table: pa.Table) -> pa.Table:
        block, kind = numbers(table.column("block")), numbers(table.column("kind"))
        out_block, out_data = [], []
        for row in np.flatnonzero(kind == SETTLED).tolist():
            out_block.append(int(block[row]))
            out_data.append(table.column("data")[row].as_py())
        heads, bodies, of = [], [], []
        for row in np.flatnonzero(kind == STRINGS).tolist():
            raw = table.column("data")[row].as_py()
            n = int.from_bytes(raw[:8], "little")
            heads.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(n, 4))
            bodies.append(np.frombuffer(raw, np.uint8, -1, 8 + 32 * n))
            of.append(np.full(n, block[row]))
        if heads:
            head, of = np.concatenate(heads), np.concatenate(of)
            data = np.concatenate([*bodies, np.zeros(8, np.uint8)])
            spans, at = _repeated_spans(head, data, length)
            of = of[at]
            order = np.argsort(of, kind="stable")
            spans, of = spans[order], of[order]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(of)).tolist()):
                out_block.append(int(of[a]))
                out_data.append(spans[a:b].astype("<i8").tobytes())
        n = len(out_block)
        return pa.table(
            [pa.array(out_block, pa.int64()), pa.nulls(n, pa.int64()), pa.array([SETTLED] * n, pa.int32()), pa.array(out_data, pa.binary())],
            names=["block", "id", "kind", "data"],
        )

    return group


def _repeated_spans(head: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document, start and end of what is removed, and the run that each comes from."""
    doc, local, count, anchor = head.T
    size = count + length - 1
    begin = np.cumsum(size) - size
    order = np.argsort(anchor, kind="stable")
    change = np.flatnonzero(np.diff(anchor[order], prepend=anchor[order[0]] - 1 if len(order) else 0))
    strings = np.add.reduceat(count[order], change) if len(change) else np.zeros(0, np.int64)
    spans, origin = [], []
    # Whole anchors together, as many as make a chunk.
    chunk = np.cumsum(strings) // CHUNK_STRINGS
    cuts = np.append(change[np.flatnonzero(np.diff(chunk, prepend=-1))], len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        runs = order[a:b]
        run = np.repeat(runs, count[runs])
        step = np.arange(len(run)) - np.repeat(np.cumsum(count[runs]) - count[runs], count[runs])
        # Equal strings have equal anchors, so each anchor's strings are sorted by themselves.
        leaf = deep_shallow(data, begin[run] + step, length, anchor[run])
        least = np.full(int(leaf.max()) + 1 if len(leaf) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, leaf, doc[run])
        gone = np.flatnonzero(doc[run] > least[leaf])
        if len(gone):
            first = local[run[gone]] + step[gone]
            begins = np.ones(len(gone), bool)
            begins[1:] = (run[gone][1:] != run[gone][:-1]) | (first[1:] != first[:-1] + 1)
            at = np.flatnonzero(begins)
            last = np.append(at[1:], len(gone)) - 1
            spans.append(np.stack([doc[run[gone[at]]], first[at], first[last] + length], axis=1))
            origin.append(run[gone[at]])
    if not spans:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    return np.concatenate(spans), np.concatenate(origin)


def _character(data: np.ndarray, start: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The eight bytes of each suffix at ``depth``, as one number that sorts like them."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[start + depth]
    word = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)
    beyond = max(0, depth + 8 - length)
    return word >> np.uint64(8 * beyond) << np.uint64(8 * beyond) if beyond else word


def deep_shallow(data: np.ndarray, start: np.ndarray, length: int, group: np.ndarray) -> np.ndarray:
    """Sort the strings of ``length`` bytes at ``start`` within each group; the leaf of each.

    Strings of a group share a leaf exactly when they are equal, and the order of leaves is that
    of the strings. ``data`` must go on for seven bytes after the last string.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    # head[i]: where the group of the i-th string in order begins.
    head = _heads(np.diff(group[order], prepend=group[order[:1]] - 1) != 0)
    for k in range(SHALLOW):
        open_ = _open(head)
        if not len(open_):
            break
        # One step of multikey quicksort for every group that is not sorted yet.
        key = _character(data, start[order[open_]], 8 * k, length)
        inner = np.lexsort((key, head[open_]))
        order[open_] = order[open_][inner]
        key = key[inner]
        new = np.ones(len(open_), bool)
        new[1:] = (key[1:] != key[:-1]) | (head[open_][1:] != head[open_][:-1])
        head[open_] = open_[_heads(new)]
    _blind_tries(data, start, length, order, head)
    leaf = np.empty(n, np.int64)
    leaf[order] = head
    return leaf


def _heads(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _open(head: np.ndarray) -> np.ndarray:
    """Places in groups of more than one string."""
    alone = head == np.arange(len(head))
    alone[:-1] &= head[1:] != head[:-1]
    return np.flatnonzero(~alone)


def _blind_tries(data: np.ndarray, start: np.ndarray, length: int, order: np.ndarray, head: np.ndarray) -> None:
    """Order what still shares a long prefix, with one trie per group, all built side by side.

    A trie is built along the path of one of its strings: every other string leaves the path at
    the first byte that differs. Those that leave at the same depth and with the same byte form
    the subtrie there and are treated the same way in the next round; those that never leave are
    equal. Below the path hang, from the deepest branch up, the smaller ones before it and the
    larger ones behind it.
    """
    done = 8 * SHALLOW
    words = max(0, -(-(length - done) // 8))
    open_ = _open(head)
    while len(open_) and words:
        path = order[head[open_]]
        here = order[open_]
        depth = np.full(len(open_), length, np.int64)
        byte = np.zeros(len(open_), np.int64)
        left = np.arange(len(open_))
        for k in range(words):
            one = _character(data, start[here[left]], done + 8 * k, length)
            two = _character(data, start[path[left]], done + 8 * k, length)
            differ = one ^ two
            off = np.flatnonzero(differ)
            if len(off):
                first = _first_byte(differ[off])
                at = left[off]
                depth[at] = done + 8 * k + first
                value = (one[off] >> (np.uint64(56) - np.uint64(8) * first.astype(np.uint64))) & np.uint64(255)
                other = (two[off] >> (np.uint64(56) - np.uint64(8) * first.astype(np.uint64))) & np.uint64(255)
                # Before the path: leaving early comes first. Behind it: leaving late comes first.
                smaller = value < other
                byte[at] = value.astype(np.int64) + 1
                depth[at] = np.where(smaller, depth[at] - 2 * length, 2 * length - depth[at])
            left = left[differ == 0]
        equal = byte == 0
        depth[equal] = 0
        inner = np.lexsort((byte, depth, head[open_]))
        order[open_] = order[open_][inner]
        depth, byte, equal = depth[inner], byte[inner], equal[inner]
        new = np.ones(len(open_), bool)
        new[1:] = (depth[1:] != depth[:-1]) | (byte[1:] != byte[:-1]) | (head[open_][1:] != head[open_][:-1])
        head[open_] = open_[_heads(new)]
        rest = open_[~equal]
        alone = _open(head)
        open_ = np.intersect1d(rest, alone, assume_unique=True)


def _first_byte(differ: np.ndarray) -> np.ndarray:
    """Which of eight bytes, from the front, is the first that is not zero."""
    out = np.zeros(len(differ), np.int64)
    rest = differ.copy()
    for step in (4, 2, 1):
        empty = rest >> np.uint64(64 - 8 * step) == 0
        out[empty] += step
        rest = np.where(empty, rest << np.uint64(8 * step), rest)
    return out


def _cut(length: int, columns: list[str], as_text: bool):
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        table, ids, prints, offsets, data = _text_rows(left)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        size = np.diff(offsets)
        spans = [np.zeros((0, 3), np.int64)]
        own = np.ones(table.num_rows, bool)
        if right.num_rows and table.num_rows:
            own = _without(ids, prints, *_copies_in(right, "data"))
            for row in np.flatnonzero(numbers(right.column("kind")) == SETTLED).tolist():
                spans.append(np.frombuffer(right.column("data")[row].as_py(), "<i8").reshape(-1, 3))
        span = np.concatenate(spans)
        shift = _shifts(ids, prints)
        order = np.argsort(span[:, 0], kind="stable")
        span = span[order]
        removed, kept = [], []
        first, last = np.searchsorted(span[:, 0], ids), np.searchsorted(span[:, 0], ids, side="right")
        for row in range(table.num_rows):
            text = data[offsets[row] : offsets[row + 1]]
            if not own[row]:
                found = [(0, int(size[row]))] if size[row] >= length else []
            else:
                here = span[first[row] : last[row], 1:] - shift[row]
                found = _merged(here[(here[:, 0] >= 0) & (here[:, 0] < 1 << 40)])
            parts, at = [], 0
            for a, b in found:
                parts.append(text[at:a].tobytes())
                at = b
            parts.append(text[at:].tobytes())
            whole = b"".join(parts)
            kept.append(whole.decode("utf-8", "ignore") if as_text else whole)
            removed.append([{"start": a, "end": b} for a, b in found])
        return pa.table(
            [*(table.column(c) for c in columns), pa.array(size), pa.array(removed, kind), pa.array(kept, pa.string() if as_text else pa.binary())],
            names=[*columns, "n_bytes", "removed", "kept_bytes"],
        )

    return group


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    ends = reach[np.append(at[1:], len(spans)) - 1]
    return [(int(a), int(b)) for a, b in zip(spans[at, 0], ends)]
