"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept and applies one operator of
``tidemark.llm`` to all of them. ``run`` writes every stage's result to the shared folder and reads
it back, so a lost executor costs no more than the stage it was working on.

Stages that join an operator's decisions back to the documents keep rows without an id, which no
operator can name.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_tokens, language_filters
from tidemark.llm.common import saved
from tidemark.llm.exact_dedup import exact_groups, normalised
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import pack, pieces_of
from tidemark.llm.queries import SEQUENCE, vocabulary
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.sources.tables import read_table

END_OF_DOCUMENT = 1
PASSAGE_BYTES = 50


READ = ("doc_id", "text", "lang", "n_chars")


def wrapped(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and all others in one, so that no name can clash."""
    rest = [F.col(c) for c in docs.columns if c not in READ]
    return docs.select(*(c for c in docs.columns if c in READ), F.struct(F.lit(0).alias("none"), *rest).alias("rest"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return rows.select(*(F.col(c) if c in READ else F.col("rest").getField(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Those go that have no letter, or of whose n-grams the best language contains a smaller share than
    practically all labelled documents of their length reach.
    """
    rows = wrapped(docs)
    labelled = language_filters.labelled(rows)
    judged = language_filters.predict(rows, language_filters.fit_labelled(labelled))
    known = (F.col("lang_pred") != language_filters.UNDETERMINED) & (F.col("share") > 0)
    return unwrapped(judged.filter(known & language_filters.reaches(language_filters.levels(labelled))), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    rows = wrapped(docs)
    kept = exact_groups(rows).filter("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("sha"))
    sha = F.sha2(normalised(F.coalesce("text", F.lit(""))), 256)
    same = F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("own") == F.col("sha"))
    return unwrapped(rows.withColumn("own", sha).join(kept.hint("shuffle_hash"), same, "left_semi"), docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and more."""
    rows = wrapped(docs)
    kept = near_duplicates(rows, width=5, percent=80).filter("kept").select("doc_id")
    named = rows.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    return unwrapped(named.select(*rows.columns).union(rows.filter(F.col("doc_id").isNull())), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents left with nothing go."""
    cut = remove_repeats(wrapped(docs), length=PASSAGE_BYTES, as_text=True)
    shorter = F.size("removed") > 0
    kept = cut.filter(~shorter | (F.col("kept_bytes") != ""))
    changed = {"text": F.when(shorter, F.col("kept_bytes")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.char_length("kept_bytes").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(shorter, length).otherwise(F.col("n_chars"))
    return unwrapped(kept.withColumns(changed), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2,048; ``row`` tells documents without an id apart."""
    encoder = partial(byte_tokens.encode, path=vocabulary("byte_bpe_50k.json"))
    pieces = pieces_of(docs, encoder, SEQUENCE, end_id=END_OF_DOCUMENT)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "row")
    return pack(saved(pieces, "pieces"), SEQUENCE)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


#: SQL cannot express trained filters and tokenisation; the tests compare with plain Python.
ORACLE_SQL = None
