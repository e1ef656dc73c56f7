"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_tokens, language_filters, licence_scan, toxic_segments
from tidemark.llm.benchmark_index import contamination
from tidemark.llm.common import held_out, saved
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.filter_audit import audit, document_filters, with_labels
from tidemark.llm.lattice_dedup import near_vectors
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.oracle_sql import BENCHMARK_INDEX_SQL, PERIODIC_RUNS_SQL, SUFFIX_DEDUP_SQL
from tidemark.llm.packing import pack, pieces_of
from tidemark.llm.periodic_runs import collapse_runs
from tidemark.llm.simple8b import read_token_files, write_token_files
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.word_lexicon import encode_and_decode
from tidemark.session import working_folder
from tidemark.sources.tables import read_table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


# Pairs are found by their common shingles; components by following links to ever smaller ids.
MINHASH_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i)
  WHERE len(words) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN n USING (doc_id)
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licence_scan.licences(docs, licence_scan.fit(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


EXACT_DEDUP_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxic_segments.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxic_segments.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    filters = language_filters.fit(docs)
    return language_filters.predict(docs.select("doc_id", "text"), filters).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SEQUENCE = 2048


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = partial(byte_tokens.encode, path=vocabulary("byte_bpe_50k.json"))
    pieces = pieces_of(read_table(spark, sf_dir, "documents"), encoder, SEQUENCE, end_id=1)
    pieces = saved(
        pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "row"),
        "pieces",
    )
    return pack(pieces, SEQUENCE)


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = partial(byte_tokens.encode, path=vocabulary("byte_bpe_50k.json"))
    folder = working_folder(spark, "tokens")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, encoder, end_id=0)
    return read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


# The cosine in double precision; sums of the products in DuckDB may differ in the last bit.
LATTICE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    result = remove_repeats(docs, length=50)
    return result.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op10_word_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_and_decode(docs, vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = with_labels(document_filters(docs, part=docs["lang"]), read_table(spark, sf_dir, "labels"), flags)
    return audit(rows, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


# Documents are counted by part and the letters they fail, then put through all steps of all orders.
FILTER_AUDIT_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d
),
label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
),
n AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN label USING (doc_id)
  GROUP BY part, fails
),
orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(f)
  WHERE NOT contains(filter_order, f)
),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS f,
         filter_order[:step - 1] AS earlier, filter_order[:step] AS until
  FROM orders, unnest(range(1, 6)) AS t(step)
  WHERE length(filter_order) = 5
),
tested AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails = f AS only_this,
         contains(fails, f) AS this, translate(fails, earlier, '') <> fails AS gone,
         translate(fails, until, '') = fails AS stays
  FROM n, steps
),
counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (stays), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (this AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (this AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (this AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (this AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM tested
  GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all documents; one in ten has its last words replaced by a repeated stretch."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, g % n, null)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(words, (w, i) -> if(i >= a, words[cast(a + (i - a) % p as int)], w)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(repeated_tails(read_table(spark, sf_dir, "documents")))
    greater = "x.length * best.period > best.length * x.period"
    best = F.expr(f"aggregate(runs, get(runs, 0), (best, x) -> if({greater}, x, best))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(F.col("best").getField(c).alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simple8b": op7_simple8b,
    "op8_lattice_dedup": op8_lattice_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_word_lexicon": op10_word_lexicon,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_benchmark_index": op13_benchmark_index,
}

ORACLE_SQL = {
    "op1_minhash_dedup": MINHASH_SQL,
    "op6_exact_dedup": EXACT_DEDUP_SQL,
    "op8_lattice_dedup": LATTICE_SQL,
    "op9_suffix_dedup": SUFFIX_DEDUP_SQL,
    "op11_filter_audit": FILTER_AUDIT_SQL,
    "op12_periodic_runs": PERIODIC_RUNS_SQL,
    "op13_benchmark_index": BENCHMARK_INDEX_SQL,
}
