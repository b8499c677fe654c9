"""Removed bytes against a table of all 50-byte strings; the kernels against plain sorting."""

import numpy as np
import pytest

from llm import suffix_dedup as S
from tests.llm.plain import brute_dedup, rows

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def answer(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def test_against_brute_force(docs):
    assert answer(S.dedup(docs)) == sorted(brute_dedup(rows()), key=repr)


def test_small_shards_and_hot_anchors(docs, monkeypatch):
    """Anchors that go on over shards, and anchors dealt out by window, give the same rows."""
    want = sorted(brute_dedup(rows()), key=repr)
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 7)
    assert answer(S.dedup(docs)) == want
    monkeypatch.setattr(S, "HOT_SEGMENTS", 5)
    assert answer(S.dedup(docs)) == want


def test_clashing_columns_and_texts(docs, clashing):
    got = S.dedup(clashing, text_out=True)
    assert answer(got) == answer(S.dedup(docs))
    for r in got.select("n_bytes", "n_removed", "kept_bytes", "spans").collect():
        assert len(r["kept_bytes"]) == r["n_bytes"] - r["n_removed"]
        assert sum(e - b for b, e in r["spans"]) == r["n_removed"]


def test_empty(empty):
    assert S.dedup(empty).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"ab\0", b"abcdefghijklmnopqrstuvwxyz"])
def test_suffix_array_and_prefixes(letters):
    rng = np.random.default_rng(len(letters))
    base = rng.choice(np.frombuffer(letters, np.uint8), 90)
    bodies = []
    for k in range(60):
        b = base[rng.integers(0, 6) : 84 + rng.integers(-20, 6)].copy()
        if k % 3:
            b[rng.integers(0, len(b))] = letters[0]
        bodies.append(b.tobytes()[:84])
    length = np.array([len(b) for b in bodies])
    rows_ = np.frombuffer(b"".join(b.ljust(84, b"\0") for b in bodies), np.uint8).reshape(-1, 84)
    order = S.suffix_array(rows_, length, 50)
    lcp = S.common_prefixes(rows_, length, order, 50)
    text = [bodies[p // 84][p % 84 :] for p in order]
    assert sorted(order.tolist()) == [r * 84 + c for r in range(60) for c in range(length[r] - 49)]
    windows = [t[:50] for t in text]
    assert all(a <= b for a, b in zip(windows, windows[1:], strict=False))
    for i in range(1, len(order)):
        a, b = text[i - 1], text[i]
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert (lcp[i] >= 50) == (want >= 50)
        if 0 not in letters:
            assert lcp[i] == want


def test_null_ids_each_have_their_place(spark):
    """Rows without an id don't remove each other's bytes, however many there are, and ids of another type are refused."""
    import pytest

    from llm import suffix_dedup
    from tests.llm.conftest import SCHEMA, prose
    from tests.llm.plain import brute_dedup

    data = [(None, prose(k % 7, 40), "en", "s") for k in range(40)] + [(5, prose(3, 40), "en", "s"), (6, prose(4, 30) + " " + prose(3, 40), "en", "s"), (6, prose(4, 30), "en", "s")]
    got = suffix_dedup.dedup(spark.createDataFrame(data, SCHEMA).repartition(6)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_dedup(data)))
    with pytest.raises(TypeError):
        suffix_dedup.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
