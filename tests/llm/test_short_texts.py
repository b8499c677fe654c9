"""Texts shorter than a benchmark item, against brute force."""

from collections import Counter

import pytest

from llm import decontamination
from tests.llm.conftest import prose


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_short_texts_against_plain_similarity():
    items = [(k, prose(700 + k, 5 + k)) for k in range(56)]
    index = decontamination.Index(items, 0.75)
    found = 0
    for k, text in items:
        w = text.split(" ")
        for cut in range(1, len(w) // 3 + 2):
            for part in (w[:-cut], w[cut:], w[cut // 2 : len(w) - (cut - cut // 2)], ["zzz", *w[: -cut - 1]]):
                words = decontamination.Words([" ".join(part).encode()])
                got = {h[0]: h[1:] for h in index.hits(words.hash)}
                a, b = bag(part), bag(w)
                low = sum((a & b).values())
                score = low / (sum(a.values()) + sum(b.values()) - low)
                assert len(part) < len(w)
                if score >= 0.75:
                    found += 1
                    assert got[k] == (pytest.approx(score), 0, len(part))
                else:
                    assert k not in got
    assert found > 500


def test_leak_of_most_of_an_item(spark):
    item = prose(900, 40)
    bench = spark.createDataFrame([(1, item), (2, "a b c d")], "item_id long, text string")
    words = item.split(" ")
    texts = [(1, " ".join(words[:36])), (2, " ".join(words[:30])), (3, "a b c"), (4, None), (5, ""), (6, "zzz " + " ".join(words[2:38])), (7, "word")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"]) for r in decontamination.find(docs, bench).collect()}
    assert got == {(1, 1): (pytest.approx(32 / 36), 0, 36), (6, 1): (pytest.approx(32 / 37), 0, 37)}
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {2, 3, 4, 5, 7}
