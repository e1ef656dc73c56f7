"""Small tables that hold the awkward cases, and plain Python versions of what operators do."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, _text int, block int"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text, lang), with nulls and clashing names in the other columns."""
    return spark.createDataFrame(
        [(i, t, l, None, None, "x", None, 7, None) for i, t, l in rows], SCHEMA
    ).repartition(5)


def awkward(seed: int = 1, n: int = 120) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, and a repeated row."""
    r = random.Random(seed)
    syllables = ["an", "er", "the", "ou", "ing", "é", "ß", "st", "re", "on", "ñ"]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def text(k: int) -> str:
        return " ".join(word() for _ in range(k))

    passage = text(30)
    base = text(60).split(" ")
    rows: list[tuple] = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            body = " ".join(w if r.random() > 0.03 else word() for w in base)
        elif kind == 1:
            body = f"{text(5)} {passage}\n{text(r.randint(1, 40))}"
        elif kind == 2 and rows:
            body = r.choice(rows)[1]
        elif kind == 3:
            body = text(r.randint(1, 5))
        else:
            body = text(r.randint(5, 80)) + r.choice(["", ".", "\n", "  ", " 12 345!"])
        rows.append((i * 3 + 1, body, r.choice(["aa", "bb"])))
    rows += [
        (2, None, "aa"), (5, "", "aa"), (8, "   \n\t", None), (11, "!!! 123", "bb"), (14, None, None),
        (None, rows[3][1], "aa"), (None, None, None), (None, "only here without an id", "bb"),
        (17, "a  b\tc", "aa"), (20, "a b c", "aa"), (23, "A b C", "aa"),
        (26, text(9000), "bb"), (29, "x" * 40_000, "aa"), (32, "ab" * 300, "aa"), (35, "ab" * 200, "bb"),
        (38, "😀 <|endoftext|> 'S it's ６ ǅ İstanbul", "aa"),
    ]
    return [*rows, rows[0], rows[0]]


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, width: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def smallest_reachable(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
