"""DuckDB SQL for operators that a join, a window or a grouping can express on small tables.

Each says what the result is, by a plainer way than the operator: all 50-byte strings grouped, all words
of a document compared over doubling stretches, all windows of words joined.
"""

from __future__ import annotations

BLOCK = 512
LENGTH = 50

# Texts as hexadecimal digits, cut into blocks first: finding a place in a long string takes as long as the string.
SUFFIX_DEDUP_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
blocks AS (
  SELECT r, doc_id, j * {BLOCK} AS place, substring(h, 2 * {BLOCK} * j + 1, 2 * ({BLOCK} + {LENGTH} - 1)) AS piece
  FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // (2 * {BLOCK}) + 1)) AS j FROM docs) numbered
),
strings AS MATERIALIZED (
  SELECT r, doc_id, place + s AS start, substring(piece, 2 * s + 1, 2 * {LENGTH}) AS string
  FROM (SELECT r, doc_id, place, piece, unnest(range(0, least({BLOCK}, length(piece) // 2 - {LENGTH - 1}))) AS s
        FROM blocks) numbered
),
shared AS (
  SELECT string, min(doc_id) AS first FROM strings GROUP BY string HAVING min(doc_id) < max(doc_id)
),
marked AS (
  SELECT r, start, CASE WHEN start <= lag(start) OVER (PARTITION BY r ORDER BY start) + {LENGTH} THEN 0 ELSE 1 END AS opens
  FROM strings JOIN shared USING (string) WHERE doc_id > first
),
spans AS MATERIALIZED (
  SELECT r, min(start) AS first, max(start) + {LENGTH} AS until
  FROM (SELECT r, start, sum(opens) OVER (PARTITION BY r ORDER BY start) AS span FROM marked) numbered
  GROUP BY r, span
),
pieces AS (
  SELECT r, coalesce(lag(until) OVER (PARTITION BY r ORDER BY first), 0) AS a, first AS b FROM spans
  UNION ALL
  SELECT r, max(until), NULL FROM spans GROUP BY r
),
kept AS (
  SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS k
  FROM pieces JOIN docs USING (r) GROUP BY r
),
counted AS (
  SELECT r, count(*) AS n_spans, sum(until - first) AS n_removed FROM spans GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN counted USING (r) LEFT JOIN kept USING (r)
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10

BENCHMARK_INDEX_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM documents
),
items AS MATERIALIZED (
  SELECT row_number() OVER () AS m, item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM benchmark
),
item_words AS (
  SELECT m, item_id, least(len(words), {WINDOW}) AS k, len(words) AS n,
         unnest(words) AS word, unnest(range(0, len(words))) AS i
  FROM items WHERE len(words) > 0
),
item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, k, string FROM (
    SELECT item_id, k, n, i, string_agg(word, ' ') OVER (PARTITION BY m ORDER BY i
             ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS string
    FROM item_words) windows
  WHERE i + k <= n
),
doc_words AS MATERIALIZED (
  SELECT r, len(words) AS n, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM docs
),
doc_windows AS (
  SELECT r, k, i, string_agg(word, ' ') OVER (PARTITION BY r, k ORDER BY i
           ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS string, n
  FROM doc_words, (SELECT DISTINCT k FROM item_windows) sizes
),
met AS MATERIALIZED (
  SELECT r, i, k, item_id FROM doc_windows JOIN item_windows USING (k, string) WHERE i + k <= n
),
hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, i, k FROM met) found) places
  GROUP BY r
),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM met) found GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

SPACE = r"[\x20\x09-\x0D]+"
SHORTEST, REPEATS = 24, 3
FIRST_LEVEL, LAST_LEVEL = 4, 20


def _periodic_runs_sql() -> str:
    """Stretches of 2^level words are named by hashes of their halves, and each looks for its next occurrence.

    In a run of smallest period q, with q above half a stretch and not beyond it, the next occurrence of every
    stretch that lies in the run before its last period is exactly q words on: were it nearer, the q words of a
    period would equal their own rotation and have a smaller period. So the places whose next
    occurrence is q on, next to each other, are the run. Periods up to 16 are found by stretches of 16 words, which a
    run of ``max(24, 3 q)`` words holds twice, q apart.
    """
    levels = []
    for level in range(1, LAST_LEVEL + 1):
        half = 2 ** (level - 1)
        levels.append(f"""
g{level} AS MATERIALIZED (
  SELECT x.r, x.i, md5(concat(x.g, ',', y.g)) AS g
  FROM g{level - 1} x JOIN g{level - 1} y ON y.r = x.r AND y.i = x.i + {half}
)""")
    repeated = " UNION ALL ".join(
        f"SELECT r, {2**level} AS size, list_sort(list(i)) AS places FROM g{level} GROUP BY r, g HAVING count(*) > 1"
        for level in range(FIRST_LEVEL, LAST_LEVEL + 1)
    )
    return f"""
WITH bits AS (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(0, 8)),
                        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(0, 256) AS t(b)
),
crc AS (SELECT list(c ORDER BY b) AS codes FROM bits),
given AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS words,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, codes[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM documents, crc
),
placed AS (
  SELECT r, doc_id, words, len(words) AS n,
         CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a,
         3 + (h // 10) % 8 AS times
  FROM given
),
of_docs AS MATERIALIZED (
  SELECT r, n, a, 1 + (n - a) // times AS p, unnest(words) AS word, unnest(range(0, n)) AS i FROM placed
),
w AS MATERIALIZED (
  SELECT x.r, x.i, CASE WHEN x.i >= x.a THEN y.word ELSE x.word END AS word
  FROM of_docs x JOIN of_docs y ON x.r = y.r AND y.i = CASE WHEN x.i >= x.a THEN x.a + (x.i - x.a) % x.p ELSE x.i END
),
g0 AS MATERIALIZED (SELECT r, i, md5(word) AS g FROM w),{",".join(levels)},
next AS (
  SELECT r, size, unnest(places[:-2]) AS i, unnest(places[2:]) AS j FROM ({repeated}) of_levels
),
near AS (
  SELECT r, i, size, j - i AS q FROM next
  WHERE j - i <= size AND (2 * (j - i) > size OR size = {2**FIRST_LEVEL})
),
found AS (
  SELECT r, q, size, unnest(places) AS i, unnest(range(0, len(places))) AS k
  FROM (SELECT r, q, size, list_sort(list(i)) AS places FROM near GROUP BY r, q, size) of_periods
),
runs AS MATERIALIZED (
  SELECT * FROM (
    SELECT r, min(i) AS start, max(i) - min(i) + size + q AS length, q AS period
    FROM found GROUP BY r, q, size, i - k) stretches
  WHERE length >= greatest({SHORTEST}, {REPEATS} * period)
),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r
),
best AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1
),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
       period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM placed LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


PERIODIC_RUNS_SQL = _periodic_runs_sql()
