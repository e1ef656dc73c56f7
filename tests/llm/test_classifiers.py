from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.llm.data import awkward, documents, empty
from tidemark.llm import language_filters, licence_scan, toxic_segments
from tidemark.llm.language_filters import languages_of, trigrams
from tidemark.llm.toxic_segments import DRIFT, maximal_segments

FOLDER = "/root/testdata/sf0.01"


def is_held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return {r["doc_id"]: r for r in docs.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id", "left").collect()}


def test_language_query_on_held_out_documents(spark, tables):
    found = __spark_entry__.queries()["op4_language_id"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in found} == set(tables)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang_pred"] == tables[r["doc_id"]]["lang"] for r in held]) > 0.98


def test_language_learns_nothing_from_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.expr("crc32(cast(doc_id AS string)) % 3 = 1"), "xx").otherwise(F.col("lang")))
    a, b = language_filters.fit(docs), language_filters.fit(wrong)
    assert a.languages == b.languages and (a.slots == b.slots).all()


def test_language_filters_are_written_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, the n-grams of a small table are written by one task."""
    written = {}
    real = language_filters.saved

    def look(frame, purpose, *rows):
        written[purpose] = real(frame, purpose, *rows)
        return written[purpose]

    monkeypatch.setattr(language_filters, "saved", look)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = language_filters.fit(docs)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = language_filters.fit(docs)
    finally:
        spark.conf.set(name, before)
    assert len(written["gram-counts"].inputFiles()) > 1
    assert len(written["grams"].inputFiles()) == 1
    assert found.languages == expected.languages and (found.slots == expected.slots).all()


def test_language_of_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows).withColumn("lang_pred", F.lit(1))
    found = language_filters.predict(docs, language_filters.fit(docs))
    assert found.columns.count("lang_pred") == 1 and "_text" not in found.columns and "score" in found.columns
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["lang_pred"] in ("und", "aa", "bb")


def test_language_without_labels(spark):
    assert language_filters.predict(empty(spark), language_filters.fit(empty(spark))).count() == 0
    rows = [(1, "text", None), (2, None, "aa")]
    filters = language_filters.fit(documents(spark, rows))
    assert {r["lang_pred"] for r in language_filters.predict(documents(spark, rows), filters).collect()} == {"und"}


def plain_trigrams(text: str) -> list[str]:
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    padded = f" {low} "
    return [padded[i : i + 3] for i in range(len(low)) if padded[i + 1] != " "]


def as_text(code: int) -> str:
    return "".join(chr(code >> shift & (1 << 21) - 1) for shift in (42, 21, 0))


def test_trigrams_are_those_of_plain_python():
    texts = ["", "a", "Äb c", "  ", "x😀y ß", "ab\ncd", "é" * 5, "中文 text"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    codes, begin = trigrams(offsets, np.frombuffer(b"".join(raw), np.uint8))
    for i, text in enumerate(texts):
        assert [as_text(int(c)) for c in codes[begin[i] : begin[i + 1]]] == plain_trigrams(text)


def build(lang: list[str], gram: np.ndarray, bits: int = 16) -> language_filters.Filters:
    languages = sorted(set(lang))
    rows = pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram.view(np.int64))], ["lang", "gram"])
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    for out in language_filters._taken(languages, bits)(iter([rows])):
        slot, word, mask = (c.to_numpy(zero_copy_only=False) for c in out.columns)
        np.bitwise_or.at(slots, (slot, word), mask.view(np.uint64))
    return language_filters._filters(languages, slots, [lang.count(x) for x in languages])


def contained(filters: language_filters.Filters, gram: int) -> set[str]:
    bits = len(filters.slots).bit_length() - 1
    first, second = (int(x[0]) for x in language_filters._slots(np.array([gram], np.uint64), bits))
    mask = [int(a & b) for a, b in zip(filters.slots[first], filters.slots[second])]
    return {x for k, x in enumerate(filters.languages) if mask[k // 64] >> k % 64 & 1}


def test_language_fit_against_plain_python(spark):
    rows = awkward(n=200)
    counts: dict[str, dict[str, int]] = {"aa": {}, "bb": {}}
    for i, t, lang in rows:
        if t is not None and lang and (i is None or not is_held_out(i)):
            for gram in plain_trigrams(t):
                counts[lang][gram] = counts[lang].get(gram, 0) + 1
    totals = {x: sum(n.values()) for x, n in counts.items()}
    share = {x: {g: n / totals[x] for g, n in c.items()} for x, c in counts.items()}
    least, part = language_filters.LEAST, language_filters.SHARE
    expected = {
        g: {x for x in share if share[x].get(g, 0) >= max(least, part * max(s.get(g, 0) for s in share.values()))}
        for g in {*share["aa"], *share["bb"]}
    }
    filters = language_filters.fit(documents(spark, rows))
    assert filters.languages == ["aa", "bb"]
    surplus = 0
    for gram, languages in expected.items():
        code = ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])
        found = contained(filters, code)
        assert languages <= found
        surplus += found != languages
    assert surplus < 0.02 * len(expected)
    sizes = {x: sum(x in languages for languages in expected.values()) for x in share}
    assert filters.most_grams == (0 if sizes["aa"] >= sizes["bb"] else 1)


def test_a_language_may_have_very_many_ngrams(spark):
    """Sixty thousand different ones, each once: none is left out, however rare."""
    r = random.Random(8)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 15_000)]
    texts = ["".join(r.choice(signs) for _ in range(2000)) for _ in range(60)]
    rows = [(i, texts[i], "zh") for i in range(60)] + [(100 + i, "one two three four", "en") for i in range(30)]
    filters = language_filters.fit(documents(spark, rows))
    taught = [t for i, t in enumerate(texts) if not is_held_out(i)]
    assert len(filters.slots) >= 8 * len({g for t in taught for g in plain_trigrams(t)})
    pieces = [(i, t[k : k + 5], None) for i, t in enumerate(taught) for k in (1, 700, 1990)]
    found = language_filters.predict(documents(spark, pieces), filters).collect()
    assert all(x["lang_pred"] == "zh" and x["share"] > 0.55 and x["n_grams"] == 5 for x in found)


def test_levels_of_lengths(spark, monkeypatch):
    """Against plain Python, with a predictor that only counts words of the language."""
    def predict(rows, filters):
        words = F.split("text", " ")
        n = F.size(words).cast("bigint")
        return rows.select(
            "lang", F.lit("aa").alias("lang_pred"), n.alias("n_grams"), (F.size(F.filter(words, lambda w: w == "a")) / n).alias("share")
        )

    monkeypatch.setattr(language_filters, "predict", predict)
    monkeypatch.setattr(language_filters, "LEVEL_ROWS", 50)
    monkeypatch.setattr(language_filters, "KEPT_SHARE", 0.9)
    r = random.Random(5)
    rows = []
    for i in range(1500):
        n = r.choice([1, 2, 3, 3, 3, 9, 9, 9, 9, 12, 40, 70])
        rows.append((i, " ".join(r.choice("aaaaab") for _ in range(n)), r.choice(["aa", "aa", "bb"])))
    found = language_filters.levels(language_filters.labelled(documents(spark, rows)))
    taught = [(len(t.split()), t.split().count("a") / len(t.split())) for i, t, x in rows if x == "aa" and zlib.crc32(str(i).encode()) % 3 == 0]
    lengths = sorted({n.bit_length() for n, _ in taught})
    groups: list[list[int]] = [[]]
    held = 0
    for length in lengths:
        if held >= 50:
            groups.append([])
            held = 0
        groups[-1].append(length)
        held += sum(n.bit_length() == length for n, _ in taught)
    if held < 50 and len(groups) > 1:
        last = groups.pop()
        groups[-1] += last
    assert len(groups) > 1 and len(found) == 64
    for group in groups:
        bins = sorted(int(s * 10_000) for n, s in taught if n.bit_length() in group)
        level = bins[int(len(bins) * (1 - 0.9) + 1e-9)] / 10_000
        assert all(found[x] == level for x in group)
    assert language_filters.levels(language_filters.labelled(documents(spark, rows[:20]))) == [0.0]


def test_filters_hold_more_than_64_languages():
    languages = [f"l{k:03d}" for k in range(100)]
    grams = [np.arange(5) + 1000 * k + 7 for k in range(100)]
    filters = build([x for x in languages for _ in range(5)], np.concatenate(grams).astype(np.uint64))
    assert filters.languages == languages and filters.slots.shape[1] == 2
    first, second = language_filters._slots(grams[77].astype(np.uint64), 16)
    mask = filters.slots[first] & filters.slots[second]
    assert ((mask[:, 1] >> np.uint64(77 - 64)) & np.uint64(1)).all()


def test_language_popcounts_against_sets():
    r = random.Random(1)
    texts = {"aa": "banana bandana", "bb": "zebra zorro azure"}
    lang, gram, sets = [], [], {}
    for name, text in texts.items():
        raw = text.encode()
        codes, _ = trigrams(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        sets[name] = set(codes.tolist())
        lang += [name] * len(sets[name])
        gram += sorted(sets[name])
    filters = build(lang, np.array(gram, np.uint64))
    for _ in range(50):
        text = " ".join(r.choice(["banana", "zebra", "band", "zor", "q"]) for _ in range(4))
        raw = text.encode()
        codes, _ = trigrams(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        hits = {n: sum(c in s for c in codes.tolist()) for n, s in sets.items()}
        got, score, share, n = languages_of(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), filters)
        if hits["aa"] != hits["bb"]:
            assert got[0] == max(hits, key=hits.get)
            assert abs(score[0] - max(hits.values()) / sum(hits.values())) < 1e-3
            assert abs(share[0] - max(hits.values()) / len(codes)) < 1e-3 and n[0] == len(codes)


def test_toxicity_query_on_held_out_documents(spark, tables):
    folder = "/root/testdata/sf0.1"
    found = __spark_entry__.queries()["op2_toxicity"](spark, folder)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = found.collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == is_held_out(r["doc_id"]) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    hits = sum(p and y for p, y in held)
    assert hits / sum(p for p, _ in held) > 0.9
    assert hits / sum(y for _, y in held) > 0.9


def toxic_rows() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(2)
    common = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    rows, labels = [], []
    for i in range(300):
        words = [r.choice(common) for _ in range(r.randint(5, 60))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grobble", "snarkit", "Grobbled"]))
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_toxic_passages_of_awkward_rows(spark):
    rows, labels = toxic_rows()
    # A repeated row, nulls, an empty and a long text; labels without a document, null and repeated.
    rows += [rows[0], (None, "grobble grobble grobble", "aa"), (1000, None, "aa"), (1001, "", "aa"), (1002, "one " * 30_000, "aa"), (1003, "!!", "aa")]
    labels += [(5000, 1, 1), (None, None, 1), (3, None, None), labels[0], (1000, 0, 0)]
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    found = toxic_segments.score(docs, toxic_segments.fit(docs, marks)).collect()
    assert len(found) == len(rows)
    for r in found:
        bad = any(w in (r["text"] or "").lower() for w in ("grobble", "snarkit"))
        assert (r["score"] >= 0.7) == bad, r
        assert (len(r["passages"]) > 0) == bad
        for p in r["passages"]:
            inside = r["text"][p["start"] : p["end"]].lower()
            assert inside.startswith(("grobble", "snarkit")) and re.search(r"(grobbled?|snarkit)$", inside)


@pytest.mark.parametrize("toxic", [0, 1])
def test_toxicity_with_one_class_only(spark, toxic):
    docs = documents(spark, awkward())
    marks = docs.select("doc_id", F.lit(toxic).alias("toxic"))
    scores = {r["score"] for r in toxic_segments.score(docs, toxic_segments.fit(docs, marks)).collect()}
    assert len(scores) == 1 and all(0 <= s <= 1 for s in scores)
    if not toxic:
        assert scores == {0.0}


def test_toxicity_of_nothing(spark):
    marks = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxic_segments.score(empty(spark), toxic_segments.fit(empty(spark), marks)).count() == 0


def test_maximal_segments_by_recursion():
    """Against the definition: the best segment, then the best on either side of it."""

    def best(scores, a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (top is None or total > top[2] + 1e-9):
                    top = (i, j, total)
        if top is None:
            return []
        return best(scores, a, top[0]) + [top] + best(scores, top[1] + 1, b)

    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 40)
        places = sorted(r.sample(range(n), r.randint(1, n)))
        value = {p: round(r.uniform(0.05, 0.6), 3) for p in places}
        scores = [value.get(p, -DRIFT) for p in range(n)]
        found = maximal_segments(np.array(places), np.array([value[p] for p in places]))
        expected = best(scores, 0, n)
        assert [f[:2] for f in found] == [e[:2] for e in expected]
        assert np.allclose([f[2] for f in found], [e[2] for e in expected])


@pytest.fixture(scope="module")
def licence_model(spark):
    return licence_scan.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_licence_notices_are_those_in_the_texts(spark, tables, licence_model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {(r["doc_id"], r["number"]): r["family"] for r in licence_scan.notices(docs, licence_model).collect()}
    marks = {"Apache": "Apache-2.0", "MIT": "MIT", "GNU": "GPL", "BY-NC": "CC-BY-NC", "reserved": "reserved"}
    expected = {}
    for i, row in tables.items():
        for k, line in enumerate(row["text"].split("\n")):
            if re.search(r"licen[sc]e|rights reserved", line, re.I):
                expected[(i, k)] = next(f for m, f in marks.items() if m in line)
    assert found == expected


def test_templates_are_found_and_only_by_their_words(spark, licence_model):
    """Every template is a notice of its family; without the search for telling words nothing more is found."""
    rows = awkward() + [(500 + k, t.text, "aa") for k, t in enumerate(licence_scan.NOTICES)]
    rows += [(700, "Licensed under\nthe MIT License of\r\nAll Rights RESERVED", "aa"), (701, "use of this and all of the work by", "bb")]
    docs = documents(spark, rows).drop("block")
    found = licence_scan.notices(docs, licence_model)
    every = licence_scan._confirmed(
        licence_scan.paragraphs(docs).withColumn("_part", F.col("paragraph")), licence_model, 0
    )
    key = lambda r: (r["doc_id"], r["number"], r["paragraph"], r["family"])
    a, b = ({key(r) for r in frame.collect()} for frame in (found, every))
    assert a == b
    by_id = {i: f for i, _, _, f in a}
    wrong = {t.text: by_id.get(500 + k) for k, t in enumerate(licence_scan.NOTICES) if by_id.get(500 + k) != t.family}
    assert not wrong
    assert 701 not in by_id and by_id[700] == "reserved"


def test_stems_are_in_all_telling_words():
    for t in licence_scan.NOTICES:
        hit = re.search("(?i)" + t.telling, t.text).group().lower()
        assert any(stem in hit for stem in licence_scan.STEMS) or re.search(licence_scan.STEM_PATTERN, hit), t


AGPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)
OF_ITS_OWN_FAMILY = [
    (AGPL, "AGPL"),
    (AGPL.replace("Affero", "Lesser"), "LGPL"),
    (AGPL.replace("Affero ", ""), "GPL"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC"),
    ("SPDX-License-Identifier: ISC", "ISC"),
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("Licensed under the Artistic License, version 2.0.", "Artistic-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Licensed under the Eclipse Public License, version 2.0.", "EPL"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
]
OF_NONE = [
    "This project is not licensed under the MIT license.",
    "The tool was never released under the BSD License, whatever others say.",
    "All rights are reserved for guests of the hotel.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: MIT-0",
    "Licensed under the Open Software License, version 3.0.",
    "The general public has no license to fish here, and permission is rarely granted.",
    "Creative people commons in the attribution of their work, version 4.0 of it.",
]


@pytest.mark.parametrize("wrapped", [False, True])
def test_notices_are_of_their_own_family_or_none(spark, licence_model, wrapped):
    lines = [(text, family) for text, family in OF_ITS_OWN_FAMILY if not wrapped or len(text.split()) > licence_scan.SENTENCE + 6]
    lines += [(text, None) for text in OF_NONE]

    def shaped(text: str) -> str:
        if not wrapped:
            return text
        words = text.split(" ")
        return "\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))

    rows = [(k, shaped(text), "aa") for k, (text, _) in enumerate(lines)]
    found = {r["doc_id"]: r["families"] for r in licence_scan.licences(documents(spark, rows), licence_model).collect()}
    assert {lines[k][0]: f for k, f in found.items() if f != (lines[k][1] or "")} == {}


def test_standard_notices_are_found_in_lines_and_over_lines(spark, licence_model):
    """None of these texts is a template; each has one among other words or wrapped."""
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    )
    gpl = (
        "# Frobnicate is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public "
        "License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    )
    lgpl = (
        " * This file is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General "
        "Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your "
        "option) any later version."
    )
    mpl = (
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not "
        "distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    )
    apache = (
        "Copyright 2024 Some Body Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"
    )
    end = "The small tool reads tables from a folder and writes them again with fewer rows. It is licensed under the MIT License."
    filler = " ".join(f"zo{k % 7}ra ve{k % 11}lo" for k in range(200))
    texts = {
        "MIT": [mit, end, f"{filler} {end} {filler}", f"{filler}\n\n{mit}\n\n{filler}"],
        "GPL": [gpl, f"{filler}\n{gpl}\n{filler}"],
        "LGPL": [lgpl],
        "MPL-2.0": [mpl, mpl.replace("\n", " ")],
        "Apache-2.0": [apache],
    }
    rows = [(k, text, "aa") for k, text in enumerate(t for some in texts.values() for t in some)]
    found = licence_scan.licences(documents(spark, rows), licence_model).collect()
    got = {r["doc_id"]: (r["families"], r["n_notices"]) for r in found}
    assert got == {k: (f, 1) for k, f in enumerate(f for f, some in texts.items() for _ in some)}
    at = licence_scan.notices(documents(spark, rows).drop("block"), licence_model).filter("doc_id = 5").first()
    assert 0 <= at["number"] <= 4 and "Public" in at["paragraph"]


def test_sample_of_other_paragraphs_has_no_copies(spark, monkeypatch):
    class Enough(Exception):
        pass

    seen = []

    def look(frame, purpose):
        seen.extend(r["paragraph"] for r in frame.collect())
        raise Enough

    monkeypatch.setattr(licence_scan, "saved", look)
    rows = [(k, "the same line" if k % 3 else f"line {k}", "aa") for k in range(300)]
    with pytest.raises(Enough):
        licence_scan.fit(documents(spark, rows))
    assert sorted(seen) == sorted(set(t for _, t, _ in rows))


def test_all_paragraphs_teach_what_is_no_licence(spark, monkeypatch):
    """Of more paragraphs than any sample had, every one counts once, whatever its place or copies."""
    written = {}
    real = licence_scan.saved

    def look(frame, purpose, *rows):
        written[purpose] = real(frame, purpose, *rows)
        return written[purpose]

    monkeypatch.setattr(licence_scan, "saved", look)
    lines = [f"the line {k} of all files" for k in range(9000)] + ["Licensed under the MIT License.", "the files of a license"]
    model = licence_scan.fit(documents(spark, [(k // 3, text, "aa") for k, text in enumerate(lines * 2)]))
    counted = written["examples-of-no-licence"].agg({"n": "sum"}).first()[0]
    assert counted == 9001  # the notice of the MIT License is none of them
    weight = written["licence-examples"].filter(f"label = {len(licence_scan.TEMPLATES)}").agg({"weight": "sum"}).first()[0]
    assert licence_scan.UNKNOWN_WEIGHT < weight < licence_scan.UNKNOWN_WEIGHT + len(licence_scan.NEAR_MISSES) + 2
    assert 0.5 <= model.accepted < 1


def test_common_words_alone_resemble_no_template():
    for t in licence_scan.NOTICES:
        common = [g for g in t.grams if set(g.split()) <= licence_scan.COMMON]
        assert len(common) < licence_scan.SIMILAR * len(t.grams), t


def test_licence_query_runs_no_python(spark, data):
    found = __spark_entry__.queries()["op5_license_scan"](spark, data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found.count() == docs.count()
    assert found.filter("n_notices > 0").count() > 0


def test_licences_of_awkward_rows(spark, licence_model):
    rows = awkward() + [(35, "Released under the MIT License.\nAll rights reserved.", "aa"), (None, "All rights reserved.", "bb")]
    found = licence_scan.licences(documents(spark, rows), licence_model).collect()
    assert len(found) == len(rows)
    of = {(r["doc_id"], r["families"], r["n_notices"]) for r in found}
    assert (35, "MIT,reserved", 2) in of and (None, "reserved", 1) in of and (2, "", 0) in of
    assert licence_scan.licences(empty(spark), licence_scan.fit(empty(spark))).count() == 0


def test_only_what_is_learned_of_paragraphs_is_written(spark, monkeypatch):
    """Long paragraphs are told apart, copies counted once, and none of their text is shuffled or written."""
    written = {}
    real = licence_scan.saved

    def look(frame, purpose, *rows):
        written[purpose] = real(frame, purpose, *rows)
        return written[purpose]

    monkeypatch.setattr(licence_scan, "saved", look)
    plain = "wolken ziehen über das feld " * 40
    lines = [plain + f"q{k}" for k in range(30)] + ["x" * 23, "x" * 24, "the MIT license of a work", "the MIT. License, of A work!"]
    licence_scan.fit(documents(spark, [(k // 2, text, "aa") for k, text in enumerate(lines * 2)]))
    found = written["unknown-paragraphs"].collect()
    assert len(found) == len(lines)
    assert max(sum(len(str(x)) for x in r) for r in found) < 200
    counted = {tuple(sorted(r["features"].indices.tolist())): 0 for r in written["examples-of-no-licence"].collect()}
    for r in written["examples-of-no-licence"].collect():
        counted[tuple(sorted(r["features"].indices.tolist()))] += r["n"]
    assert sorted(counted.values()) == [2, 32]  # the two with the same known words are alike


def test_known_words_are_those_of_all_words(spark):
    vocabulary = sorted({g for t in licence_scan.NOTICES for g in t.grams})
    texts = [t.text for t in licence_scan.NOTICES] + licence_scan.NEAR_MISSES + licence_scan.AROUND
    texts += ["", "the the the", "Ünder THE MIT-License, version2 any a-an an", "x license y version 2 0"]
    rows = licence_scan._with_known(documents(spark, [(k, t, "aa") for k, t in enumerate(texts)]), "text", vocabulary).collect()
    for r in rows:
        w = licence_scan._plain_words(r["text"])
        assert r["grams"] == sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))} & set(vocabulary)), r["text"]


def test_what_lacks_the_needed_words_resembles_no_template():
    needed = set(licence_scan._needed())
    for t in licence_scan.NOTICES:
        rest = [g for g in t.grams if g not in needed]
        assert len(rest) / len(t.grams) < licence_scan.SIMILAR, t


def test_telling_words_are_those_of_any_template():
    """The one pattern finds what the patterns of all templates find, with each word's place and end."""
    each = re.compile("(?i)(?:" + "|".join(t.telling for t in licence_scan.NOTICES) + ")")
    one = re.compile(licence_scan.TELLING)
    assert licence_scan.TELLING.count("(?<![a-zA-Z0-9])") == 1  # looked for at the beginning of words only
    for t in licence_scan.NOTICES:
        start, end = re.search("(?i)" + t.telling, t.text).span()
        for k in range(start, end + 1):
            for text in (t.text[:k] + t.text[k + 1 :], t.text[:k] + "x" + t.text[k:], t.text[:k] + "- " + t.text[k:], t.text[:k].upper()):
                assert bool(one.search(text)) == bool(each.search(text)), text
