"""Registered queries at the smallest size: those with SQL against it, the others against plain answers from the library or brute force."""

import zlib

import duckdb
import numpy as np
import pytest

from llm import queries
from tests.llm.plain import brute_dedup


def tables(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(sf):
    return tables(sf).execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_those_of_the_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = tables(sf).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda f: sorted(repr([None if x is None or x != x else round(float(x), 6) if isinstance(x, (float, np.floating)) else x.item() if isinstance(x, np.generic) else x for x in r]) for r in f[columns].astype(object).to_numpy().tolist())
    assert rows(got) == rows(want)


def test_language_against_profiles_of_dicts(spark, sf, texts):
    from llm import language

    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in texts}
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf).collect()}
    assert len(got) == len(texts) and all(got[d]["held_out"] == held[d] for d in got)
    counts: dict[str, dict[int, int]] = {}
    for d, text, lang, _ in texts:
        if lang is not None and not held[d]:
            c = counts.setdefault(lang, {})
            for code, n in zip(*(x.tolist() for x in language.grams(text)), strict=True):
                c[code] = c.get(code, 0) + n
    top = lambda c: sorted(c, key=lambda k: (-c[k], k))[: language.PROFILE]
    ranks = {lang: {code: i for i, code in enumerate(top(c))} for lang, c in counts.items()}
    for d, text, *_ in texts:
        mine = top(dict(zip(*(x.tolist() for x in language.grams(text)), strict=True)))
        if not mine:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(i - r[c]) if c in r else language.PROFILE for i, c in enumerate(mine)) for lang, r in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert got[d]["lang_pred"] == best and got[d]["score"] == pytest.approx(1 - far[best] / (language.PROFILE * len(mine)))
    known = [(lang, got[d]["lang_pred"]) for d, _, lang, _ in texts if lang is not None and held[d] and got[d]["lang_pred"] != "und"]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_shards(spark, sf, texts):
    got = queries.op7_sharding(spark, sf).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in texts]
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_substrings(spark, sf, texts):
    got = sorted(tuple(r) for r in queries.op8_suffix_dedup(spark, sf).collect())
    assert got == sorted(brute_dedup(texts))


def test_tokens(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t, *_ in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op9_token_store(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_toxicity(spark, sf, texts):
    got = queries.op10_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_decontamination_by_brute_force(spark, sf, texts):
    """Every item whose text stands in a document as it is, is found there."""
    items = tables(sf).execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontamination(spark, sf).collect()}
    words = lambda t: " " + " ".join((t or "").lower().split()) + " "
    plain = [(d, words(t)) for d, t, *_ in texts]
    assert {(d, i) for d, t in plain for i, x in items if words(x) in t} <= got
