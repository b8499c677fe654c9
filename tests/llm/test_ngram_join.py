"""The join against all pairs compared one by one."""

import numpy as np
from tests.llm.plain import brute_components, rows

from llm import ngram_join


def answer(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()), key=repr)


def test_against_brute_force(docs):
    assert answer(ngram_join.join(docs)) == sorted(brute_components(rows()), key=repr)


def test_clashing_columns(docs, clashing):
    assert answer(ngram_join.join(clashing)) == answer(ngram_join.join(docs))


def test_empty(empty):
    assert ngram_join.join(empty).count() == 0


def test_compare_opens_what_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 200 - k], rng.integers(0, 1 << 40, k).astype(np.uint64)))) for k in range(0, 120, 5)]
    i, j = ngram_join.compare(sets, sets, 75, 100)
    want = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {(r["node"], r["root"]) for r in ngram_join.components(edges).collect()}
    assert found == {(i, 0) for i in range(1, 61)} | {(101, 100)}
