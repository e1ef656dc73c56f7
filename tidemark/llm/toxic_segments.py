"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting, on the labelled documents that are not held out:

1. Tokens are runs of letters, in small letters. A token counts as itself and as each of its
   beginnings of 4 to 6 letters, so that inflected forms share their evidence. Documents are
   counted per class. Units that stand out are counted once more, by the contexts they occur in:
   how many different tokens a token follows, and how many different tokens have a beginning.
   Copies of one toxic document repeat its words, but always in the same contexts.
2. A unit's score is the difference of the log-odds of these counts in toxic and in clean
   documents, with a Dirichlet prior of ``PRIOR`` per unit. It enters the lexicon if it is more
   frequent in toxic documents and the likelihood ratio says that, of ``CHANCES`` times as many
   units, less than one would stand out so by chance. This test alone decides, at every size.
3. Tokens outside the lexicon score ``-DRIFT``, so the expected score of clean text is negative.
   With the scores' frequencies in clean text, lambda solves sum(p * exp(lambda * s)) = 1. K is
   fitted to the tail, the numbers of segments of clean text that score ``s`` or more: in a text
   of m tokens, K * m * exp(-lambda * s) of them are expected by chance.

Scoring scans a text once and finds all its maximal scoring segments. Those with an expected
number below ``SIGNIFICANT`` are its toxic passages. A document's evidence is the sum of their
calibrated scores, lambda * s - ln(K * m); a logistic curve turns it into a probability. It is
fitted to the evidence of the training documents, one point per document.

The lexicon is a written table. Workers get ``UNITS_AT_ONCE`` units of it at a time: a larger one takes
several passes over the texts, each of which adds what its units hit, and gives the same result. Its size
is logged.

Null and empty texts, and those without letters, have no passage and get the score of a document
without evidence. Without labels of both kinds the score is 0 for all (no toxic example) or the
curve's constant. Labels without a document, with a null or for an id that several rows carry are
used for each such row or not at all; extra columns of either table are not read.
"""

from __future__ import annotations

import logging
import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_rows, held_out, numbers, saved, string_buffer, text_pieces, with_columns_of
from tidemark.llm.hashing import POINT_VALUES, mix, span_hashes
from tidemark.llm.language_filters import LOWER
from tidemark.llm.pretokens import LETTER, UNSAFE, Text

log = logging.getLogger(__name__)

BEGINNINGS = (4, 5, 6)
ITSELF = 9
PRIOR = 0.5
UNITS_AT_ONCE = 1 << 20
CHANCES = 50
DRIFT = 0.1
SIGNIFICANT = 0.05
HELD_UNITS = 1 << 20
BIN_WIDTH = 0.25
SCORE_BINS = 16  # bins of token and segment scores, per unit of the score
MIN_K = 1e-9

HIT = np.dtype([("place", np.int32), ("level", np.int8), ("score", np.float64)])


@dataclass
class Lexicon:
    """Some of the units, ready to look up."""

    units: np.ndarray  # sorted hashes
    scores: np.ndarray
    marks: np.ndarray = field(init=False)  # a bit table that most other units fail

    def __post_init__(self):
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.units >> np.uint64(42)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Scores of units, 0 for those outside the lexicon."""
        out = np.zeros(len(hashes))
        at = np.flatnonzero(self.marks[(hashes >> np.uint64(42)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.units, hashes[at]), len(self.units) - 1)
            hit = self.units[place] == hashes[at]
            out[at[hit]] = self.scores[place[hit]]
        return out


@dataclass
class Units:
    """A written table of ``unit`` and ``score``, to be taken in ``parts`` of bounded size."""

    table: DataFrame
    size: int

    @classmethod
    def written(cls, table: DataFrame, purpose: str) -> Units:
        table = saved(table, purpose)
        return cls(table, table.count())

    @property
    def parts(self) -> int:
        return max(1, -(-self.size // UNITS_AT_ONCE))

    def part(self, k: int) -> Lexicon:
        rows = self.table.filter(F.pmod(F.xxhash64("unit"), F.lit(self.parts)) == k).toArrow()
        unit = numbers(rows.column("unit")).view(np.uint64)
        order = np.argsort(unit)
        return Lexicon(unit[order], numbers(rows.column("score"), np.float64)[order])


@dataclass
class Model:
    lexicon: Units | None
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)  # constant and slope


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens (places in the code points), and where each text's begin."""
    text = Text(offsets, data)
    letter = text.kind == LETTER
    unsafe = np.flatnonzero(text.kind == UNSAFE)
    if len(unsafe):
        points, which = np.unique(text.points[unsafe], return_inverse=True)
        letter[unsafe] = np.array([unicodedata.category(chr(p))[0] == "L" for p in points.tolist()])[which]
    edge = np.zeros(len(letter) + 1, bool)
    edge[text.first] = True
    before, after = np.zeros(len(letter), bool), np.zeros(len(letter), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    low = np.minimum(text.points, 0x10000)
    small = low < 0x10000
    low[small] = LOWER[low[small]]
    text.points = low
    return text, starts, ends, np.searchsorted(starts, text.first)


def units(text: Text, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens themselves and then their beginnings: places of tokens and hashes of units."""
    yield np.arange(len(starts)), mix(span_hashes(text.points, starts, ends, POINT_VALUES))
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts >= n)
        begun = span_hashes(text.points, starts[at], starts[at] + n, POINT_VALUES)
        yield at, mix(begun + np.uint64(n))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
) -> Model:
    """A model from all labelled documents that are not held out."""
    marked = (
        labels.select(
            labels[label_id_col].cast("bigint").alias("doc_id"),
            labels[label_col].cast("int").alias("toxic"),
        )
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    texts = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    # Written once: the texts are shuffled for the join, and three steps read the result.
    training = saved(
        texts.filter(~held_out()).join(marked.hint("shuffle_hash"), "doc_id").select("text", "toxic"),
        "training",
    )
    counts = (
        training.mapInArrow(_counted, "unit bigint, toxic bigint, clean bigint")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    # Unit 0 holds the number of tokens and unit 1 that of documents.
    counts = saved(counts, "token-counts")
    sums = {r["unit"]: r for r in counts.filter("unit IN (0, 1)").collect()}
    if 1 not in sums or sums[1]["toxic"] == 0:
        return Model(None, curve=(-math.inf, 0.0))
    share = sums[0]["toxic"] / max(1, sums[0]["toxic"] + sums[0]["clean"])
    distinct = counts.count() - 2
    candidates = Units.written(_standing_out(counts.filter("unit NOT IN (0, 1)"), share, distinct), "candidates")
    contexts = (
        _contexts(training, candidates)
        .distinct()
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )
    model = Model(Units.written(_standing_out(contexts, share, distinct), "lexicon"))
    log.info("%d of %d units have a score", model.lexicon.size, distinct)
    if not model.lexicon.size:
        rate = sums[1]["toxic"] / (sums[1]["toxic"] + sums[1]["clean"])
        model.curve = (math.log(rate / (1 - rate)) if rate < 1 else math.inf, 0.0)
        return model

    # One more pass over the training documents: first the chance of scores in clean text.
    seen = _over_texts(
        training.withColumnRenamed("text", "_text"), ["toxic"], model, _seen,
        "toxic int, m bigint, hits array<double>, segments array<double>",
    )
    seen = saved(seen, "segments")
    clean = seen.filter("toxic = 0")
    model.lam, model.k = chance(_histogram(clean, "hits"), _histogram(clean, "segments"), float(sums[0]["clean"]))
    model.curve = _curve(seen, model)
    return model


def _standing_out(counts: DataFrame, share: float, distinct: int) -> DataFrame:
    """The units that stand out, with their log-odds; ``share`` of all tokens are in toxic texts."""
    y1, y0 = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = min(max(share, 1e-9), 1 - 1e-9)

    def term(y, part):
        return F.when(y > 0, y * F.log(y / ((y1 + y0) * part))).otherwise(0.0)

    ratio = 2 * (term(y1, share) + term(y0, 1 - share))
    odds = F.log((y1 + PRIOR) / share) - F.log((y0 + PRIOR) / (1 - share))
    return (
        counts.withColumns({"ratio": ratio, "score": odds})
        .filter((F.col("score") > 0) & (F.col("ratio") > 2 * math.log(CHANCES * max(2, distinct))))
        .select("unit", "score")
    )


def _contexts(training: DataFrame, candidates: Units) -> DataFrame:
    """Where the candidates occur: a token after which token, a beginning in which token."""
    parts = [training.mapInArrow(_contexts_of(training, candidates.part(k)), "unit bigint, context bigint, toxic int") for k in range(candidates.parts)]
    return reduce(DataFrame.union, parts)


def _contexts_of(training: DataFrame, lexicon: Lexicon):
    shared = training.sparkSession.sparkContext.broadcast(lexicon)  # at most about UNITS_AT_ONCE units

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_pieces(whole):
                toxic = numbers(batch.column("toxic"), np.int32)
                text, starts, ends, begin = tokens(*string_buffer(batch.column("text")))
                label = np.repeat(toxic, np.diff(begin))
                itself = next(iter(units(text, starts, ends)))[1]
                before = np.concatenate([[np.uint64(0)], itself[:-1]]) if len(itself) else itself
                if len(itself):
                    before[begin[:-1][begin[:-1] < len(itself)]] = 0
                found = []
                for k, (at, hashes) in enumerate(units(text, starts, ends)):
                    hit = np.flatnonzero(shared.value.look_up(hashes))
                    context = (itself if k else before)[at[hit]]
                    rows = np.stack([hashes[hit], context, label[at[hit]].astype(np.uint64)], axis=1)
                    found.append(np.unique(rows, axis=0))
                rows = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[:, 0].copy().view(np.int64)),
                        pa.array(rows[:, 1].copy().view(np.int64)),
                        pa.array(rows[:, 2].astype(np.int32)),
                    ],
                    ["unit", "context", "toxic"],
                )

    return task


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
    for whole in batches:
        for batch in text_pieces(whole):
            toxic = numbers(batch.column("toxic"))
            text, starts, ends, begin = tokens(*string_buffer(batch.column("text")))
            label = np.repeat(toxic, np.diff(begin))
            one = [np.zeros(len(label), np.uint64), np.ones(len(toxic), np.uint64)]
            of = [label, toxic]
            for at, hashes in units(text, starts, ends):
                # Once per document: a word that a text repeats is no stronger sign for it.
                doc = np.repeat(np.arange(len(toxic)), np.diff(begin))[at]
                first = np.unique(mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                one.append(hashes[first])
                of.append(label[at][first])
            one, of = np.concatenate(one), np.concatenate(of)
            found, which = np.unique(one, return_inverse=True)
            n = np.stack([np.bincount(which, of == c, len(found)) for c in (1, 0)], axis=1).astype(np.int64)
            both, which = np.unique(np.concatenate([held[0], found]), return_inverse=True)
            sums = np.zeros((len(both), 2), np.int64)
            np.add.at(sums, which, np.concatenate([held[1], n]))
            held = (both, sums)
            if len(both) > HELD_UNITS:
                yield _count_rows(held)
                held = (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
    yield _count_rows(held)


def _count_rows(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held[0].view(np.int64)), pa.array(held[1][:, 0].copy()), pa.array(held[1][:, 1].copy())],
        ["unit", "toxic", "clean"],
    )


@dataclass
class Scored:
    """The tokens of some texts, and the score of each in the lexicon (0: not in it).

    A token has the score of its longest unit in the lexicon, itself before its beginnings; ``level`` says
    which that is.
    """

    text: Text
    starts: np.ndarray
    ends: np.ndarray
    begin: np.ndarray  # where each text's tokens begin
    score: np.ndarray
    level: np.ndarray

    @classmethod
    def of(cls, offsets: np.ndarray, data: np.ndarray, lexicon: Lexicon, earlier: pa.Array | None = None) -> Scored:
        text, starts, ends, begin = tokens(offsets, data)
        out = cls(text, starts, ends, begin, np.zeros(len(starts)), np.zeros(len(starts), np.int8))
        if earlier is not None:
            rows = [np.frombuffer(r, HIT) for r in earlier.to_pylist()]
            hits = np.concatenate([*rows, np.zeros(0, HIT)])
            place = hits["place"] + np.repeat(begin[:-1], [len(r) for r in rows])
            out.score[place], out.level[place] = hits["score"], hits["level"]
        for level, (at, hashes) in zip((ITSELF, *BEGINNINGS), units(text, starts, ends)):
            found = lexicon.look_up(hashes)
            better = (found > 0) & (level > out.level[at])
            out.score[at[better]], out.level[at[better]] = found[better], level
        return out

    def hits(self) -> pa.Array:
        """The tokens in the lexicon, by text, for the next part of the lexicon."""
        at = np.flatnonzero(self.score > 0)
        cuts = np.searchsorted(at, self.begin)
        rows = np.zeros(len(at), HIT)
        rows["place"] = at - self.begin[np.searchsorted(self.begin, at, side="right") - 1]
        rows["score"], rows["level"] = self.score[at], self.level[at]
        return binary_rows(rows[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


def _over_texts(texts: DataFrame, kept: list[str], model: Model, finish: Callable, schema) -> DataFrame:
    """``finish(batch, scored)`` of all texts in ``_text``, after all parts of the lexicon were looked up."""
    context = texts.sparkSession.sparkContext
    units_of = model.lexicon
    parts = units_of.parts if units_of else 1
    for k in range(parts):
        lexicon = units_of.part(k) if units_of else Lexicon(np.zeros(0, np.uint64), np.zeros(0))
        shared = context.broadcast(lexicon)  # at most about UNITS_AT_ONCE units
        if k < parts - 1:
            added = with_columns_of(texts.select(*kept, "_text"), "_hits binary")
            texts = saved(texts.mapInArrow(_looked_up(shared, _more_hits(kept)), added), "hits")
        else:
            texts = texts.mapInArrow(_looked_up(shared, finish), schema)
    return texts


def _looked_up(shared, finish: Callable):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_pieces(whole, "_text"):
                earlier = batch.column("_hits") if "_hits" in batch.schema.names else None
                yield finish(batch, Scored.of(*string_buffer(batch.column("_text")), shared.value, earlier))

    return task


def _more_hits(kept: list[str]):
    def finish(batch: pa.RecordBatch, scored: Scored) -> pa.RecordBatch:
        names = [*kept, "_text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), scored.hits()], [*names, "_hits"])

    return finish


def maximal_segments(places: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in one scan: first and last place, and score.

    Only the places with a positive score are given; each place between counts ``-DRIFT``.
    Candidates are kept on a stack with the running total left and right of them; a new one
    is joined with those it improves. Each joins at most once, so the scan is linear.
    """
    stack: list[list[float]] = []  # first, last, total before, total after, smaller total before
    total, last = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist()):
        total -= DRIFT * (place - last - 1)
        one = [place, place, total, total + score, -1]
        total, last = total + score, place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= one[3]:
                one[4] = j
                stack.append(one)
                break
            one = [stack[j][0], one[1], stack[j][2], one[3], -1]
            del stack[j:]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in stack]


def _segments_of(scores: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    hits = np.flatnonzero(scores > 0)
    text = np.searchsorted(begin, hits, side="right") - 1
    for one in np.unique(text):
        at = hits[text == one] if len(hits) < 1000 else hits[slice(*np.searchsorted(text, [one, one + 1]))]
        yield int(one), maximal_segments(at - begin[one], scores[at])


def _seen(batch: pa.RecordBatch, scored: Scored) -> pa.RecordBatch:
    """One row per training document: its tokens, and the scores of its hits and of its segments."""
    hits: list[list[float]] = [[] for _ in range(batch.num_rows)]
    found: list[list[float]] = [[] for _ in range(batch.num_rows)]
    for i, segments in _segments_of(scored.score, scored.begin):
        mine = scored.score[scored.begin[i] : scored.begin[i + 1]]
        hits[i], found[i] = mine[mine > 0].tolist(), [x[2] for x in segments]
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [batch.column("toxic"), pa.array(np.diff(scored.begin), pa.int64()), pa.array(hits, kind), pa.array(found, kind)],
        ["toxic", "m", "hits", "segments"],
    )


def _histogram(seen: DataFrame, column: str) -> list[tuple[float, float]]:
    """Mean and number of the scores in each bin; scores of tokens are logarithms of counts."""
    scores = seen.select(F.explode(column).alias("s"))
    bins = scores.groupBy(_bin(F.col("s"), SCORE_BINS)).agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("n"))
    return sorted((float(r["s"]), float(r["n"])) for r in bins.collect())


def _bin(x, per_unit: float):
    """Bins of equal width up to 100, and of a hundredth of the value beyond: some thousands in all."""
    return F.when(x < 100, F.floor(x * per_unit)).otherwise(F.floor(100 * per_unit + 100 * F.log(x / 100))).alias("bin")


def chance(
    hits: list[tuple[float, float]], segments: list[tuple[float, float]], clean_tokens: float
) -> tuple[float, float]:
    """Lambda and K of clean text, from histograms of the scores of its hits and of its segments.

    Lambda is the positive root of sum(p * exp(lambda * s)) = 1 over the scores of tokens, -DRIFT
    included. K comes from the tail: of the C(s) segments that score s or more, those not above the median
    count of segments, the mean of ln C(s) + lambda * s - ln(tokens), weighted by C(s). Without any hit in
    clean text, half an occurrence of a score of 8 keeps both finite.
    """
    n = max(1.0, clean_tokens)
    hits = hits or [(8.0, 0.5)]
    segments = segments or hits
    share = [(s, min(c / n, 0.999)) for s, c in hits]
    rest = max(0.0, 1 - sum(p for _, p in share))

    def total(lam: float) -> float:
        return sum(p * math.exp(min(700.0, lam * s)) for s, p in share) + rest * math.exp(-lam * DRIFT) - 1

    low, high = 1e-3, 1e-3
    while total(high) < 0 and high < 20:
        high *= 1.5
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 0 else (low, middle)
    lam = high
    tail, above = [], 0.0
    for s, c in reversed(segments):
        above += c
        tail.append((s, above))
    upper = [x for x in tail if x[1] <= above / 2] or tail
    weight = sum(c for _, c in upper)
    log_k = sum(c * (math.log(c) + lam * s - math.log(n)) for s, c in upper) / weight
    return lam, min(1.0, max(MIN_K, math.exp(log_k)))


def evidence(lam: float, k: float, m: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of the calibrated scores of the significant segments, and those segments."""
    kept, total = [], 0.0
    for first, last, score in segments:
        calibrated = lam * score - math.log(k * max(1, m))
        if calibrated > -math.log(SIGNIFICANT):
            kept.append((first, last, calibrated))
            total += calibrated
    return total, kept


def _curve(seen: DataFrame, model: Model) -> tuple[float, float]:
    """Constant and slope of a logistic curve over the documents' evidence.

    Newton's method on bins of the evidence, each with its mean and its number of documents.
    """
    base = F.log(F.lit(model.k) * F.greatest("m", F.lit(1)))
    calibrated = F.transform("segments", lambda s: F.lit(model.lam) * s - base)
    significant = F.filter(calibrated, lambda c: c > -math.log(SIGNIFICANT))
    x = F.aggregate(significant, F.lit(0.0), lambda total, c: total + c)
    rows = (
        seen.select("toxic", x.alias("x"))
        .groupBy("toxic", _bin(F.col("x"), 1 / BIN_WIDTH))
        .agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    x = np.array([float(r["x"]) for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    w = np.array([float(r["n"]) for r in rows])
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 1e-3 * a, (w * (y - p) * x).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        det = h[0, 0] * h[1, 1] - h[0, 1] ** 2
        step = np.array([h[1, 1] * g[0] - h[0, 1] * g[1], h[0, 0] * g[1] - h[0, 1] * g[0]]) / det
        step = np.clip(step, -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), max(0.0, float(b))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``passages`` (start, end in characters, score)."""
    kept = [c for c in docs.columns if c not in ("score", "passages", "_text", "_hits")]
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text")
    passage = "array<struct<start: int, end: int, score: double>>"
    schema = with_columns_of(docs.select(*kept), f"score double, passages {passage}")
    return _over_texts(docs.select(*(docs[c] for c in kept), text), kept, model, _judged(kept, model), schema)


def _judged(kept: list[str], model: Model):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    lam, k, (constant, slope) = model.lam, model.k, model.curve

    def finish(batch: pa.RecordBatch, scored: Scored) -> pa.RecordBatch:
        total, m = np.zeros(batch.num_rows), np.diff(scored.begin)
        passages = [[] for _ in range(batch.num_rows)]
        for i, segments in _segments_of(scored.score, scored.begin):
            total[i], significant = evidence(lam, k, int(m[i]), segments)
            base, zero = scored.begin[i], scored.text.first[i]
            passages[i] = [
                {"start": int(scored.starts[base + a] - zero), "end": int(scored.ends[base + b] - zero), "score": s}
                for a, b, s in significant
            ]
        probability = 1 / (1 + np.exp(-np.clip(constant + slope * total, -30, 30)))
        if constant == -math.inf:
            probability = np.zeros(batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(probability), pa.array(passages, kind)],
            [*kept, "score", "passages"],
        )

    return finish
