"""Language identification with n-gram filters that hold a bitmask of languages per slot.

The filters of all languages are one Bloom filter cut the other way: instead of a bit array per
language, each slot has one bit per language. One lookup of an n-gram (the bitwise AND of its
slots) returns all languages that contain it.

Fitting counts the three-letter sequences of the labelled documents per language. A language
contains an n-gram when its share of the language's n-grams is at least ``SHARE`` of the
largest share it has in any language, and at least ``LEAST``. Shares mean the same at every size,
and as they add up to one, no language contains more than ``1 / LEAST`` n-grams. The filter has eight
slots or more per n-gram of the largest language, so at most 64 MB per 64 languages; its bits are set by Spark, and
only the filter itself comes to the driver.

A document's n-grams are looked up one by one and the bits counted per language. A language that
does not contain an n-gram still answers yes with a known probability, that all its slots are
taken; the counts are corrected for it. The language with the largest corrected share wins, ties
go to the one first in the alphabet. The score is that share's part of the two largest shares. Whether
the text is in that language at all is told by the share itself: ``levels`` measures how low it
falls, for short and long texts, in labelled documents that the filter has not seen.

N-grams are centred on a letter, in small letters; everything that is no letter, and the ends of
the text, count as a blank. Null texts, and texts without a letter, are ``und`` with score 0. A
text with letters none of whose n-grams any language contains gets the language with most n-grams
and score 0. Without any labelled text all predictions are ``und``. Every row gets a result, in
whatever columns it has nulls; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, numbers, saved, string_buffer, text_pieces, with_columns_of
from tidemark.llm.hashing import mix
from tidemark.llm.pretokens import LETTER, UNSAFE, Text

SHARE = 0.25
LEAST = 2.0**-20
FEWEST_SLOT_BITS = 16
SLOTS_PER_GRAM = 8
LOOKUPS = 2
KEPT_SHARE = 0.9999
LEVEL_ROWS = 1000
HELD_GRAMS = 1 << 20
UNDETERMINED = "und"
PREDICTED = ("lang_pred", "score", "share", "n_grams")


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # by language
    most_grams: int  # the language with most n-grams


def _letters(text: Text) -> np.ndarray:
    out = text.kind == LETTER
    unsafe = np.flatnonzero(text.kind == UNSAFE)
    if len(unsafe):
        points, which = np.unique(text.points[unsafe], return_inverse=True)
        out[unsafe] = np.array([unicodedata.category(chr(p))[0] == "L" for p in points.tolist()])[which]
    return out


LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x10000)], np.uint32)


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as exact 63-bit codes, and where each text's begin."""
    text = Text(offsets, data)
    letter = _letters(text)
    points = text.points.copy()
    low = points < 0x10000
    points[low] = LOWER[points[low]]
    points = np.where(letter, points, 0x20).astype(np.uint64)
    n = len(points)
    before, after = np.full(n, 0x20, np.uint64), np.full(n, 0x20, np.uint64)
    before[1:], after[:-1] = points[:-1], points[1:]
    inner = text.first[(text.first > 0) & (text.first < n)]
    before[inner] = 0x20
    after[inner - 1] = 0x20
    codes = (before << np.uint64(42)) | (points << np.uint64(21)) | after
    at = np.flatnonzero(letter)
    return codes[at], np.searchsorted(at, text.first)


def labelled(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang``, ``text`` and ``fold`` (0 or 1) of the documents that have both and are not held out."""
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) == 0
    return rows.select("lang", "text", fold.cast("int").alias("fold"))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Filters:
    """Filters from the documents that have a language and are not held out."""
    return fit_labelled(labelled(docs, lang_col, id_col, text_col))


def fit_labelled(rows: DataFrame) -> Filters:
    """Filters from all texts in ``text`` with their language in ``lang``."""
    counts = saved(
        rows.select("lang", "text")
        .mapInArrow(_counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "gram-counts",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    share = F.col("n") / F.col("total")
    kept = saved(
        counts.join(F.broadcast(totals), "lang")
        .withColumn("share", share)
        .withColumn("largest", F.max("share").over(Window.partitionBy("gram")))
        .filter((F.col("share") >= SHARE * F.col("largest")) & (F.col("share") >= LEAST))
        .select("lang", "gram"),
        "grams",
        counts.count(),  # short rows: few files
    )
    sizes = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    bits = slot_bits(max(sizes.values(), default=0))
    taken = (
        kept.mapInArrow(_taken(languages, bits), "slot int, word int, mask bigint")
        .groupBy("slot", "word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()  # at most one row per slot and 64 languages
    )
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    slots[numbers(taken.column("slot")), numbers(taken.column("word"))] = numbers(taken.column("mask")).view(np.uint64)
    return _filters(languages, slots, [sizes[x] for x in languages])


def slot_bits(grams: int) -> int:
    """So many bits number the slots of a filter whose largest language has ``grams`` n-grams."""
    return max(FEWEST_SLOT_BITS, (SLOTS_PER_GRAM * grams - 1).bit_length())


def _filters(languages: list[str], slots: np.ndarray, sizes: list[int]) -> Filters:
    taken = [((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
    most = int(np.argmax(sizes)) if len(languages) else 0
    return Filters(languages, slots, np.array(taken) ** LOOKUPS, most)


def _taken(languages: list[str], bits: int):
    """The slots of each n-gram, with the bit of its language."""
    place = {lang: k for k, lang in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            mask = (np.uint64(1) << (which % 64).astype(np.uint64)).view(np.int64)
            for slot in _slots(numbers(batch.column("gram")).view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot, pa.int32()), pa.array(which // 64, pa.int32()), pa.array(mask)], ["slot", "word", "mask"]
                )

    return task


def _slots(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = mix(gram + np.uint64(1))
    return [((mixed >> np.uint64(32 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(LOOKUPS)]


def levels(rows: DataFrame) -> list[float]:
    """The share that texts in a learned language reach, by the number of bits of their number of n-grams.

    ``rows`` are ``labelled`` documents. Filters are fitted to one half of them; of the other half, those with
    the language that was found tell how large the share is in texts the filter has not seen.
    ``KEPT_SHARE`` of them reach the level of their length. Lengths with fewer than ``LEVEL_ROWS`` such
    documents are taken together with the next longer ones, and the longest with the shorter ones;
    with fewer in all, every level is 0.
    """
    found = predict(rows.filter("fold = 1"), fit_labelled(rows.filter("fold = 0")))
    right = saved(found.filter(F.col("lang") == F.col("lang_pred")).select(_length().alias("length"), "share"), "shares")
    count = F.count(F.lit(1)).alias("n")
    sizes = {r["length"]: r["n"] for r in right.groupBy("length").agg(count).collect()}  # at most 64 rows
    groups, held = [], 0
    for length in sorted(sizes):
        if not groups or held >= LEVEL_ROWS:
            groups.append([])
            held = 0
        groups[-1].append(length)
        held += sizes[length]
    if len(groups) > 1 and held < LEVEL_ROWS:
        last = groups.pop()
        groups[-1] += last
    if not groups or sum(sizes[x] for x in groups[0]) < LEVEL_ROWS:
        return [0.0]
    group = {x: k for k, some in enumerate(groups) for x in some}
    # Shares in bins of a ten-thousandth: the level is the lower end of the bin in which the quantile lies.
    bins = (
        right.groupBy("length", F.floor(F.col("share") * 10_000).alias("bin")).agg(count).collect()
    )
    found_levels = []
    for k in range(len(groups)):
        mine = sorted((r["bin"], r["n"]) for r in bins if group[r["length"]] == k)
        left, below = sum(n for _, n in mine) * (1 - KEPT_SHARE), 0
        for at, n in mine:
            below += n
            if below > left:
                found_levels.append(at / 10_000)
                break
    return [found_levels[max((k for y, k in group.items() if y <= x), default=0)] for x in range(64)]


def _length() -> Column:
    return F.length(F.bin("n_grams")).alias("length")


def reaches(found: list[float]) -> Column:
    """Whether a predicted row's share reaches the level of its length.

    Few n-grams tell little: twice the deviation of a share of that many is allowed below the level.
    """
    level = F.get(F.array(*(F.lit(x) for x in found)), F.least(_length(), F.lit(len(found) - 1)))
    return F.col("share") >= level - 2 * F.sqrt(level * (1 - level) / F.greatest("n_grams", F.lit(1)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams per language of a task's documents, handed on whenever there are very many."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for whole in batches:
        for batch in text_pieces(whole):
            grams, begin = trigrams(*string_buffer(batch.column("text")))
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            of = np.repeat(which, np.diff(begin))
            for k, lang in enumerate(langs):
                found, n = np.unique(grams[of == k], return_counts=True)
                if lang in held:
                    found, at = np.unique(np.concatenate([held[lang][0], found]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[lang][1], n]), len(found)).astype(np.int64)
                held[str(lang)] = (found, n)
            if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                yield from _counts(held)
                held = {}
    yield from _counts(held)


def _counts(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (grams, n) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
            ["lang", "gram", "n"],
        )


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` that are not called so already, and those of ``PREDICTED``.

    ``share`` is the corrected share of the text's ``n_grams`` n-grams that its language contains.
    """
    kept = [c for c in docs.columns if c not in (*PREDICTED, "_text")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # of a bounded size per 64 languages
    texts = docs.withColumn("_text", docs[text_col].cast("string")).select(*(docs[c] for c in kept), "_text")
    schema = with_columns_of(texts.drop("_text"), "lang_pred string, score double, share double, n_grams bigint")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known = whole.column("_text").is_valid().to_numpy(zero_copy_only=False)
            filled = whole.set_column(
                whole.schema.get_field_index("_text"), "_text", whole.column("_text").fill_null("")
            )
            done = 0
            for batch in text_pieces(filled, "_text"):
                lang, score, share, n = languages_of(*string_buffer(batch.column("_text")), shared.value)
                valid = known[done : done + batch.num_rows]
                done += batch.num_rows
                lang = np.where(valid, lang, UNDETERMINED)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in kept),
                        pa.array(lang.tolist(), pa.string()),
                        *map(pa.array, (score, share, n)),
                    ],
                    [*kept, *PREDICTED],
                )

    return texts.mapInArrow(task, schema)


def languages_of(
    offsets: np.ndarray, data: np.ndarray, filters: Filters
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The language of each text, its score, its corrected share of the n-grams, and their number."""
    grams, begin = trigrams(offsets, data)
    n = np.diff(begin)
    texts, languages = len(n), len(filters.languages)
    lang = np.full(texts, UNDETERMINED, dtype=object)
    score, reached = np.zeros(texts), np.zeros(texts)
    if not languages or not len(grams):
        return lang, score, reached, n
    first, second = _slots(grams, len(filters.slots).bit_length() - 1)
    share = np.zeros((texts, languages))
    safe = np.minimum(begin[:-1], len(grams) - 1)
    for word in range(filters.slots.shape[1]):
        mask = filters.slots[:, word][first] & filters.slots[:, word][second]
        for k in range(64 * word, min(languages, 64 * word + 64)):
            bits = ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)
            share[:, k] = np.add.reduceat(bits, safe)
    lettered = n > 0
    share = share[lettered] / n[lettered, None]
    share = np.clip((share - filters.false_rate) / (1 - np.minimum(filters.false_rate, 0.999)), 0, 1)
    best = share.argmax(axis=1)
    top = share.max(axis=1)
    rest = np.sort(share, axis=1)[:, -2] if languages > 1 else np.zeros(len(top))
    best[top == 0] = filters.most_grams
    lang[lettered] = np.array(filters.languages, dtype=object)[best]
    score[lettered] = np.divide(top, top + rest, out=np.zeros(len(top)), where=top > 0)
    reached[lettered] = top
    return lang, score, reached, n
