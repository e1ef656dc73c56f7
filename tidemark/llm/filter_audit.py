"""How filters on documents interact: what each removes at each step of every order.

The failures of a document are a set of filters. Counting documents by part and set leaves at most
``2 ** n`` rows per part, whatever the number of documents, and everything follows from these:

1. For each coalition of filters, how many documents any of them removes (for five filters a table of 32).
   The step of a filter after others removes the difference of two coalitions.
2. A filter's Shapley value is its mean removal over all orders. It comes from exact constrained
   least squares: a sum of one value per filter is fitted to the removals of all coalitions, each
   weighted by the Shapley kernel, such that the values add up to the removal of all filters.
   The normal equations with that constraint are solved in rationals.

``document_filters`` marks five usual failures: too few words, too few distinct words, too many
capitals, symbols, and a text that a smaller id has as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_uneven, saved, string_buffer, text_pieces
from tidemark.llm.word_numbers import character_class, numbered, spans_of

INSIDE = character_class([(0x20, 0x20), (0x09, 0x0D)], outside=True)
CAPITALS = character_class([(0x41, 0x5A)])
#: The symbols that a document may not hold.
SYMBOLS = character_class([(ord(c), ord(c)) for c in "#$%&*|"])


def document_filters(
    docs: DataFrame,
    part: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    fewest_words: int = 200,
    distinct_percent: int = 50,
    capital_percent: int = 3,
) -> DataFrame:
    """``doc_id``, ``part`` and whether the document fails ``A`` to ``E``, one row per row of ``docs``.

    A: fewer than ``fewest_words`` words. B: less than ``distinct_percent`` of them distinct. C: more than
    ``capital_percent`` of the characters A-Z. D: one of ``#$%&*|``. E: a row with a smaller id has the same
    text, compared by SHA-256. Null text counts as empty; a row without an id never fails E and
    fails no other row. A null part counts as the empty string. Extra columns are not read.
    """
    part = F.lit("") if part is None else part
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    ).withColumn("sha", F.unhex(F.sha2("text", 256)))
    limits = (fewest_words, distinct_percent, capital_percent)
    marked = saved(
        rows.mapInArrow(_failures(limits), "doc_id bigint, part string, sha binary, A boolean, B boolean, C boolean, D boolean"),
        "failures",
    )
    copies = (
        marked.groupBy("sha")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    joined = join_uneven(marked, "sha", copies, "copies", marked.count())
    return joined.select("doc_id", "part", "A", "B", "C", "D", later.alias("E"))


def _failures(limits: tuple[int, int, int]):
    fewest, distinct_percent, capital_percent = limits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                offsets, data = string_buffer(piece.column("text"))
                starts, ends, words = spans_of(INSIDE[data], offsets)
                number, most = numbered(data, starts, ends)
                row = np.repeat(np.arange(len(words)), words)
                distinct = np.bincount(np.unique(row * max(most, 1) + number) // max(most, 1), minlength=len(words))
                capitals = _within(CAPITALS[data], offsets)
                points = _within((data & 0xC0) != 0x80, offsets)
                fails = (
                    words < fewest,
                    100 * distinct < distinct_percent * words,
                    100 * capitals > capital_percent * points,
                    _within(SYMBOLS[data], offsets) > 0,
                )
                rest = [piece.column(c) for c in ("doc_id", "part", "sha")]
                yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, fails)], ["doc_id", "part", "sha", *"ABCD"])

    return task


def _within(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    return np.diff(np.concatenate([[0], np.cumsum(marked)])[offsets])


def with_labels(rows: DataFrame, labels: DataFrame, flags: Mapping[str, Column], id_col: str = "doc_id") -> DataFrame:
    """Add a boolean per flag: whether some label row of the document's id has it."""
    label = labels.groupBy(id_col).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))
    joined = rows.join(label, id_col, "left")
    return joined.select(*rows.columns, *(F.coalesce(label[n], F.lit(False)).alias(n) for n in flags))


def audit(rows: DataFrame, filters: Sequence[str], lost: Mapping[str, str], part: str = "part") -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents.

    ``filters`` are boolean columns, true where a document fails, with names of one character;
    ``filter_order`` strings them together. ``lost`` maps a result column to the boolean column it counts. Per step:
    ``kept`` after it, ``removed`` in it, ``redundant`` (removed earlier and failing this filter too),
    ``unique_fails`` (failing only this filter, in any order), each column of ``lost`` counted among the
    removed, and ``shapley``: the filter's removals summed over all orders, at any step.
    A part is there if some document has it; null is a part of its own. No rows give no rows.
    """
    mask = reduce(lambda a, b: a + b, (F.col(f).cast("int") * (1 << k) for k, f in enumerate(filters)))
    table = rows.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("documents"), *(F.count_if(F.col(c)).alias(name) for name, c in lost.items())
    )
    counts = "".join(f", {name} bigint" for name in lost)
    schema = (
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        f"unique_fails bigint{counts}, shapley bigint"
    )
    return table.groupBy("part").applyInArrow(_audited("".join(filters), list(lost)), schema)


def _audited(filters: str, lost: list[str]):
    def task(table: pa.Table) -> pa.Table:
        n = len(filters)
        fails = {}
        for name in ("documents", *lost):
            fails[name] = [0] * (1 << n)
            for mask, count in zip(table.column("mask").to_pylist(), table.column(name).to_pylist()):
                fails[name][mask] += count
        removed = {name: removals(counts) for name, counts in fails.items()}
        documents, total = removed["documents"], sum(fails["documents"])
        values = [v * factorial(n) for v in shapley(documents)]
        out: dict[str, list] = {}
        for order in permutations(range(n)):
            before = 0
            for step, f in enumerate(order, 1):
                after = before | 1 << f
                row = {
                    "part": table.column("part")[0].as_py(),
                    "filter_order": "".join(filters[k] for k in order),
                    "step": step,
                    "kept": total - documents[after],
                    "removed": documents[after] - documents[before],
                    "redundant": documents[1 << f] - documents[after] + documents[before],
                    "unique_fails": fails["documents"][1 << f],
                    **{name: removed[name][after] - removed[name][before] for name in lost},
                    "shapley": int(values[f]),
                }
                for name, value in row.items():
                    out.setdefault(name, []).append(value)
                before = after
        kinds = {"part": pa.string(), "filter_order": pa.string(), "step": pa.int32()}
        return pa.table({name: pa.array(column, kinds.get(name, pa.int64())) for name, column in out.items()})

    return task


def removals(fails: Sequence[int]) -> list[int]:
    """For each coalition, as a set of bits, how many documents fail one of its filters.

    ``fails`` has the number of documents by the set of filters that they fail.
    """
    everything = len(fails) - 1
    inside = list(fails)  # becomes the number that fail nothing outside the set
    bit = 1
    while bit <= everything:
        for s in range(len(fails)):
            if s & bit:
                inside[s] += inside[s ^ bit]
        bit <<= 1
    return [inside[everything] - inside[everything ^ s] for s in range(len(fails))]


def shapley(removed: Sequence[int]) -> list[Fraction]:
    """The Shapley value of each filter, by exact constrained least squares.

    Minimises ``sum(weight(S) * (removed[S] - sum(x[i] for i in S)) ** 2)`` over all coalitions but the
    empty and the full one, where ``sum(x) == removed[all]``.
    """
    n = len(removed).bit_length() - 1
    if n == 0:
        return []
    matrix = [[Fraction(0)] * (n + 2) for _ in range(n + 1)]
    for s in range(1, len(removed) - 1):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            matrix[i][n + 1] += weight * removed[s]
            for j in inside:
                matrix[i][j] += weight
    for i in range(n):  # the multiplier of the constraint, and the constraint
        matrix[i][n] = matrix[n][i] = Fraction(1)
    matrix[n][n + 1] = Fraction(removed[-1])
    return _solved(matrix)[:n]


def _solved(matrix: list[list[Fraction]]) -> list[Fraction]:
    """The solution of linear equations, the right side in the last column."""
    size = len(matrix)
    for k in range(size):
        pivot = next(r for r in range(k, size) if matrix[r][k])
        matrix[k], matrix[pivot] = matrix[pivot], matrix[k]
        matrix[k] = [x / matrix[k][k] for x in matrix[k]]
        for r in range(size):
            if r != k and matrix[r][k]:
                factor = matrix[r][k]
                matrix[r] = [x - factor * y for x, y in zip(matrix[r], matrix[k])]
    return [row[-1] for row in matrix]
