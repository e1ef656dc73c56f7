"""The fit of the toxicity operator against plain Python, and its chance model against random text."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents
from tests.llm.test_classifiers import is_held_out, toxic_rows
from tidemark.llm import toxic_segments
from tidemark.llm.toxic_segments import BEGINNINGS, CHANCES, DRIFT, PRIOR, SIGNIFICANT, chance, maximal_segments


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def units_of(word: str) -> list[tuple]:
    return [("word", word), *((n, word[:n]) for n in BEGINNINGS if len(word) >= n)]


def standing_out(counts: dict, share: float, distinct: int) -> dict:
    out = {}
    for unit, (y1, y0) in counts.items():
        ratio = sum(2 * y * math.log(y / ((y1 + y0) * p)) for y, p in ((y1, share), (y0, 1 - share)) if y)
        odds = math.log((y1 + PRIOR) / share) - math.log((y0 + PRIOR) / (1 - share))
        if odds > 0 and ratio > 2 * math.log(CHANCES * distinct):
            out[unit] = odds
    return out


def plain_lexicon(training: list[tuple[str, int]]) -> dict:
    tokens, counts, contexts = Counter(), defaultdict(lambda: [0, 0]), defaultdict(set)
    for text, toxic in training:
        words = words_of(text)
        tokens[toxic] += len(words)
        for unit in {u for w in words for u in units_of(w)}:
            counts[unit][1 - toxic] += 1
        for before, word in zip([None, *words], words):
            contexts[("word", word)].add((before, toxic))
            for unit in units_of(word)[1:]:
                contexts[unit].add((word, toxic))
    share = tokens[1] / sum(tokens.values())
    candidates = standing_out(counts, share, len(counts))
    again = {u: [sum(t == y for _, t in contexts[u]) for y in (1, 0)] for u in candidates}
    return standing_out(again, share, len(counts))


def lexicon_of(model) -> np.ndarray:
    return np.sort([r["score"] for r in model.lexicon.table.collect()])


def training_of(rows, labels) -> list[tuple[str, int]]:
    toxic: dict[int, int] = {}
    for i, _, t in labels:
        if i is not None and t is not None:
            toxic[i] = max(toxic.get(i, 0), t)
    return [(t, toxic[i]) for i, t, _ in rows if i in toxic and not is_held_out(i)]


def noisy_rows(seed: int = 6) -> tuple[list[tuple], list[tuple]]:
    """Toxic words also in some clean texts, several passages in some toxic ones."""
    r = random.Random(seed)
    common = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    bad = ["grobble", "snarkit", "Grobbled", "vlix", "snarkits", "mozgo"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(common) for _ in range(r.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(r.randint(1, 3) if toxic else r.random() < 0.1):
            at = r.randrange(len(words))
            words[at:at] = [r.choice(bad) for _ in range(r.randint(2, 5) if toxic else 1)]
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def fitted(spark, rows, labels):
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return toxic_segments.fit(documents(spark, rows), marks)


def plain_evidence(lexicon: dict, model, text: str) -> float:
    words = words_of(text)
    score = [next((lexicon[u] for u in [("word", w), *((n, w[:n]) for n in (6, 5, 4) if len(w) >= n)] if u in lexicon), 0.0) for w in words]
    places = np.array([k for k, s in enumerate(score) if s > 0], np.int64)
    found = maximal_segments(places, np.array([score[k] for k in places]))
    calibrated = [model.lam * s - math.log(model.k * max(1, len(words))) for _, _, s in found]
    return sum(c for c in calibrated if c > -math.log(SIGNIFICANT))


@pytest.mark.parametrize("make", [toxic_rows, noisy_rows])
def test_fit_against_plain_python(spark, make):
    rows, labels = make()
    model = fitted(spark, rows, labels)
    training = training_of(rows, labels)
    lexicon = plain_lexicon(training)
    assert len(lexicon) > 2
    assert np.allclose(lexicon_of(model), np.sort([*lexicon.values()]))
    # The curve: one point per document, by gradient steps on the documents themselves.
    x = np.array([plain_evidence(lexicon, model, t) for t, _ in training])
    y = np.array([t for _, t in training], float)
    assert (x > 0).sum() > 20
    a, b = model.curve
    p = 1 / (1 + np.exp(-(a + b * x)))
    # At the fit both sums are zero but for the small ridge; bins move them by little.
    assert abs((y - p).sum() - 1e-3 * a) < 0.5
    assert abs(((y - p) * x).sum() - 1e-3 * b) < 0.02 * (y * x).sum() + 0.5


def test_parts_of_the_lexicon_give_the_same(spark, monkeypatch):
    rows, labels = noisy_rows(7)
    docs = documents(spark, rows)
    once = fitted(spark, rows, labels)
    assert once.lexicon.parts == 1
    expected = {r["doc_id"]: (r["score"], r["passages"]) for r in toxic_segments.score(docs, once).collect()}
    monkeypatch.setattr(toxic_segments, "UNITS_AT_ONCE", 2)
    often = fitted(spark, rows, labels)
    assert often.lexicon.parts > 2
    found = toxic_segments.score(docs, often)
    assert "_hits" not in found.columns
    for r in found.collect():
        assert math.isclose(r["score"], expected[r["doc_id"]][0], rel_tol=1e-6)
        assert [(p["start"], p["end"]) for p in r["passages"]] == [(p["start"], p["end"]) for p in expected[r["doc_id"]][1]]


def test_no_unit_that_stands_out_is_left_out(spark):
    """Hundreds of toxic words, each in few documents: all that pass the test have a score."""
    r = random.Random(3)
    common = [f"c{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(20)]
    bad = ["".join(r.choice("bdgklmnprstvz") + r.choice("aeiou") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(3000):
        words = [r.choice(common) for _ in range(40)]
        if toxic := i % 3 == 0:
            words[10:10] = [w for b in r.sample(bad, 20) for w in (b, r.choice(common))]
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, 0, int(toxic)))
    lexicon = plain_lexicon(training_of(rows, labels))
    assert len(lexicon) > 300
    assert np.allclose(lexicon_of(fitted(spark, rows, labels)), np.sort([*lexicon.values()]))


def simulated(r: np.random.Generator, scores: list[float], p: list[float], texts: int, size: int):
    hits, segments = Counter(), []
    for _ in range(texts):
        drawn = r.choice(len(scores) + 1, size=size, p=[1 - sum(p), *p])
        places = np.flatnonzero(drawn)
        value = np.array([0.0, *scores])[drawn[places]]
        hits.update(value.tolist())
        segments += [s for _, _, s in maximal_segments(places, value)]
    return hits, segments


@pytest.mark.parametrize(
    "scores, p, within",
    # One rare high score beside a low one is no smooth tail: the single law is further off there.
    [([0.5, 1.0, 1.5], [0.02, 0.01, 0.005], 2), ([0.3], [0.12], 2), ([0.4, 2.0], [0.05, 0.004], 4)],
)
def test_expected_number_of_segments_in_random_text(scores, p, within):
    r = np.random.default_rng(1)
    hits, segments = simulated(r, scores, p, 300, 2000)
    lam, k = chance(sorted(hits.items()), sorted(Counter(segments).items()), 600_000.0)
    # Lambda is the root of the equation for the scores of a token.
    assert abs(sum(q * math.exp(lam * s) for s, q in zip(scores, p)) + (1 - sum(p)) * math.exp(-lam * DRIFT) - 1) < 0.01
    _, fresh = simulated(r, scores, p, 300, 2000)
    ordered = np.sort(fresh)[::-1]
    for n in (3000, 1000, 300, 100):
        if n < len(ordered) / 2:
            s = ordered[n - 1]
            observed = (ordered >= s).sum()
            assert 1 / within < k * 600_000 * math.exp(-lam * s) / observed < within


def test_chance_without_hits():
    lam, k = chance([], [], 1000.0)
    assert 0 < lam < 20 and 0 < k <= 1
