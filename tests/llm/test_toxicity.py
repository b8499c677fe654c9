"""Toxicity against plain counts and the definition of a maximal segment, and how the scan grows."""

import math
import time
from collections import Counter

import numpy as np
import pytest

from llm import toxicity as t
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_text_operators import plain_segments


def labelled():
    data, marks = [], []
    for i in range(300):
        text = prose(3000 + i, 40)
        if i % 6 == 0:
            text = text[:60] + " grobian lout " + text[60:] + " grobian"
        data.append((i, text, "en", "s"))
        marks.append((i, int(i % 6 == 0)))
    data += [(400 + i, data[0][1], "en", "s") for i in range(50)] + [(500, None, "en", "s"), (501, "", "en", "s"), (502, "x" * 100 + " lout", "en", "s"), (None, "grobian", "en", "s")]
    marks += [(400 + i, 1) for i in range(50)] + [(500, 0), (501, 0), (502, 1), (502, 0), (503, 1), (504, None), (None, 1)]
    data += [(502, "another row of one id", "en", "s")]
    return data, marks


def test_fit_and_score_against_plain_counts(spark):
    data, marks = labelled()
    docs, labels = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = t.fit(docs.repartition(7), labels)
    again = t.fit(docs.repartition(3), labels)
    assert (model.table, model.lam, model.log_k) == (again.table, again.lam, again.log_k)
    assert (model.weight, model.bias) == pytest.approx((again.weight, again.bias))
    # One row an id, one of each set of copies and of the texts without words.
    y = {}
    for d, m in marks:
        if m is not None and d is not None:
            y[d] = max(y.get(d, 0), m)
    pick = next(r["text"] for r in docs.filter("doc_id = 502").sort("doc_id").selectExpr("text", "xxhash64(text) h").sort("h").collect())
    texts = {d: x for d, x, *_ in data if d is not None and d in y and d < 400 or d == 500} | {502: pick}
    counts = {0: Counter(), 1: Counter()}
    for d, x in texts.items():
        counts[y[d]].update({f for w in set(t.tokens(x)) for f in t.features(w)})
    n1, n0 = sum(counts[1].values()), sum(counts[0].values())
    want = {}
    for f in counts[0] | counts[1]:
        a, b = counts[1][f], counts[0][f]
        if a + b < t.LEAST_COUNT:
            continue
        weight = t.PRIOR * (n1 + n0)
        p = weight * (a + b) / (n1 + n0)
        odds = math.log((a + p) / (n1 + weight - a - p)) - math.log((b + p) / (n0 + weight - b - p))
        if abs(odds) / math.sqrt(1 / (a + p) + 1 / (b + p)) >= t.LEAST_Z:
            want[f] = max(-t.HIGHEST, min(t.HIGHEST, odds))
    assert model.table == pytest.approx(want) and "=grobian" in want
    for r in t.score(docs, model).collect():
        words = t.tokens(r["text"])
        scores = [max((want[f] for f in t.features(w) if f in want), key=abs, default=t.NEUTRAL) for w in words]
        margins = [(a, b, model.lam * s - model.log_k - math.log(len(words))) for a, b, s in plain_segments(scores)]
        spans = [(a, b) for a, b, m in margins if m > 0]
        e = math.log1p(sum(m for _, _, m in margins if m > 0))
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-(model.bias + model.weight * e))))
        assert list(zip(r["toxic_starts"], r["toxic_ends"], strict=True)) == spans


def test_the_scan_is_linear():
    rng = np.random.default_rng(1)
    took = {}
    for n in (250_000, 1_000_000):
        for mean in (-0.5, 0.0, 0.5):
            scores = (rng.normal(size=n) + mean).tolist()
            began = time.process_time()
            t.maximal_segments(scores)
            took[n, mean] = time.process_time() - began
    for mean in (-0.5, 0.0, 0.5):
        assert took[1_000_000, mean] < 10 * max(0.05, took[250_000, mean])
    up_and_down = [1.0, -2.0] * 200_000 + [1.5, -1.0] * 200_000
    began = time.process_time()
    assert t.maximal_segments(up_and_down)
    assert time.process_time() - began < 20


def test_k_counts_documents_without_a_segment():
    rng = np.random.default_rng(2)
    best = rng.gumbel(1.7, 1, 20_000)
    assert t._log_k(best, 0) == pytest.approx(1.7, abs=0.1)
    for cut in (1.0, 2.5):
        assert t._log_k(best[best > cut], int((best <= cut).sum())) == pytest.approx(1.7, abs=0.1)
    assert t._log_k(best[:0], 5) == 0.0


def test_long_words_are_whole():
    assert t.features("a" * 50) != t.features("a" * 51)
