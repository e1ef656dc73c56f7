from __future__ import annotations

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.data import awkward, documents, empty
from tests.llm.test_classifiers import is_held_out, plain_trigrams
from tests.llm.test_dedup import brute_components, brute_spans
from tests.llm.test_tokens import check_packed
from tidemark.llm.common import saved


def test_stages_are_named_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "minhash_dedup", "suffix_dedup", "packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def plain_stages(rows: list[tuple]) -> list[list[tuple]]:
    """What the first four stages keep, in plain Python.

    With too few labelled documents for a level, all texts that share a trigram with a language stay.
    """
    out = []
    taught = {g for i, t, lang in rows if t and lang and (i is None or not is_held_out(i)) for g in plain_trigrams(t)}
    rows = [r for r in rows if r[1] is not None and any(g in taught for g in plain_trigrams(r[1]))]
    assert all(any(c.isalpha() for c in r[1]) for r in rows)
    out.append(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least: dict[str, int | None] = {}
    for i, t, _ in rows:
        if norm(t) not in least or (i is not None and (least[norm(t)] is None or i < least[norm(t)])):
            least[norm(t)] = i
    rows = [r for r in rows if least[norm(r[1])] == r[0]]
    out.append(rows)
    roots = brute_components(rows, 5)
    rows = [r for r in rows if r[0] is None or roots[r[0]] == r[0]]
    out.append(rows)
    cut = {(i, n): kept for (i, n, gone, _, kept) in brute_spans(rows, 50) if gone}
    kept = []
    for i, t, lang in rows:
        whole = cut.get((i, len((t or "").encode())))
        text = t if whole is None else whole.decode("utf-8", "ignore")
        if whole is None or text:
            kept.append((i, text, lang))
    out.append(kept)
    return out


def key(row) -> tuple:
    return (row[0] is None, row[0] or 0, row[1] or "", row[2] or "")


def test_stages_against_plain_python(spark):
    rows = awkward(n=160)
    docs = documents(spark, rows)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain_stages(rows)):
        docs = saved(stage(spark, docs, ""), name)
        got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()), key=key)
        assert got == sorted(expected, key=key), name
        assert docs.columns == documents(spark, []).columns
    found = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    check_packed(expected, found, 2048)


def test_language_stage_rejects_junk_and_unlearned_languages(spark):
    r = random.Random(2)
    parts = {"aa": ["ban", "dor", "mel", "ti", "sa", "ro", "kem"], "bb": ["xu", "gra", "pil", "wen", "ost", "fe", "ny"]}

    def text(lang: str, n: int) -> str:
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))

    clean = [(i, text(lang, r.choice([1, 2, 5, 30, 200])), lang) for i in range(6000) for lang in [r.choice(["aa", "bb"])]]
    unlabelled = [(10_000 + i, text(r.choice(["aa", "bb"]), r.choice([3, 40])), None) for i in range(300)]
    foreign = [
        (20_000, "Tämä on suomenkielinen lause, jossa puhutaan säästä ja monista muista asioista.", None),
        (20_001, "Это предложение написано на другом языке.", None),
        (20_002, "zqx vkjw qqzz hcvk jjwq zxcq vvkh " * 8, None),
        (20_003, "12 345 !!", "aa"), (20_004, None, "bb"), (20_005, "", "aa"),
    ]
    rows = clean + unlabelled + foreign
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, documents(spark, rows), "").collect()}
    assert kept & {i for i, *_ in foreign} == set()
    assert len({i for i, *_ in clean + unlabelled} - kept) <= 6


def test_run_is_the_stages_in_turn(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, data), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    check_packed(rows, corpus_pipeline.run(spark, data).collect(), 2048)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_nothing(spark, name, stage):
    assert stage(spark, empty(spark), "").count() == 0
