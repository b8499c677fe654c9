"""The multi-index of decontamination: what it lets through, what it finds, and blocks of items."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm import decontamination as d
from tests.llm.conftest import SCHEMA, prose


def test_blocks_find_all_within_the_radius_and_reject_the_rest():
    rng = np.random.default_rng(4)
    items = [(k, prose(k, 30)) for k in range(300)]
    index = d.Index(items, 0.75)
    assert d.RADIUS == 31 and len(d._BALL) == 697
    unrelated = rng.integers(0, 1 << 63, (400, 2)).astype(np.uint64) * np.uint64(2)
    w, k = index.probe(unrelated)
    assert len(w) < 0.1 * 400 * 300  # 0.082 of unrelated pairs get past the blocks
    assert len(index.near(unrelated, 30)[0]) == 0
    for flips in (0, 1, 16, 31, 40):
        prints = index.prints.copy()
        for row in prints:
            for b in rng.choice(128, flips, replace=False).tolist():
                row[b // 64] ^= np.uint64(1 << (b % 64))
        found = set(zip(*(x.tolist() for x in index.near(prints, 30)), strict=True))
        brute = {(i, j) for i in range(300) for j in np.flatnonzero(d.distance(prints[i][None, :], index.prints) <= d.RADIUS).tolist()}
        assert found == brute and ((len(found) == 300) == (flips <= 31))


def test_recall_against_brute_force(spark):
    """Passages edited to a similarity of 0.75 and a little more: find reports at least 0.9 of what brute force does."""
    r = random.Random(8)
    items = [(k, prose(7000 + k, r.randrange(14, 60))) for k in range(40)]
    texts = []
    for n in range(160):
        w = items[n % 40][1].split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 1, 2])):
            w[r.randrange(len(w))] = "zz" + str(n)
        texts.append((n, prose(8000 + n, 30) + " " + " ".join(w[r.randrange(3) :]) + " " + prose(9000 + n, 30), "en", "s"))
    bags = {k: Counter(zip(*(t.split(" ")[i:] for i in range(5)), strict=False)) for k, t in items}
    want = set()
    for n, text, *_ in texts:
        w = text.split(" ")
        shingles = list(zip(*(w[i:] for i in range(5)), strict=False))
        for k, bag in bags.items():
            m = sum(bag.values())
            for s in range(len(shingles) - m + 1):
                low = sum((bag & Counter(shingles[s : s + m])).values()) if shingles[s] in bag or shingles[s + m - 1] in bag or m < 60 and any(x in bag for x in shingles[s : s + m : 3]) else 0
                if low / (2 * m - low) >= 0.75:
                    want.add((n, k))
                    break
    got = {(x["doc_id"], x["item_id"]) for x in d.find(spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 80
    assert len(got) >= 0.97 * len(want)


def test_many_items_of_one_size():
    """20,000 items, half of them equal: sparse candidates, no matrix of windows and items."""
    items = [(k, prose(k // 2, 20)) for k in range(20_000)]
    index = d.Index(items, 0.75)
    text = " ".join(prose(k, 20) for k in range(0, 400))
    began = time.time()
    hits = index.hits(d.Words([text.encode()]).hash)
    assert {h[0] for h in hits} == set(range(800)) and all(h[1] == 1.0 for h in hits)
    assert time.time() - began < 60


def test_more_items_than_one_pass_takes(spark, docs, monkeypatch):
    items = [(k, prose(100 + k, 20)) for k in range(7)] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.find(docs, bench).collect()), key=repr)
    monkeypatch.setattr(d, "ITEMS", 2)
    assert sorted(map(tuple, d.find(docs, bench).collect()), key=repr) == one and len(one) >= 1
    assert d.clean(docs, bench).count() == docs.count() - docs.filter(F.col("doc_id").isin([r[0] for r in one])).count()


def test_without_items_or_texts(spark, docs, empty):
    none = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "item_id long, text string")
    for bench in (none, none.limit(0)):
        assert d.find(docs, bench).count() == 0
        assert d.clean(docs, bench).count() == docs.count()
    assert d.find(empty, none).columns == ["doc_id", "item_id", "similarity", "start_word", "n_words"]
