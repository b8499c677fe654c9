"""Language, mixing, quality, licenses, decontamination, sharding, tokens, toxicity: edge cases and plain answers."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import decontamination, language, licenses, mixing, quality, sharding, tokenstore, toxicity
from tests.llm.conftest import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- language


def test_language_profiles(spark):
    data = [(i, "the cat and the dog are in the house with their old friends", "en", "") for i in range(30)]
    data += [(100 + i, "der hund und die katze sind mit ihren freunden in dem haus", "de", "") for i in range(30)]
    profiles = language.fit(spark.createDataFrame(data, SCHEMA))
    assert profiles.names == ["de", "en"]
    assert profiles.predict("the old house and the cat")[0] == "en"
    assert profiles.predict("die alte katze und der hund")[0] == "de"
    for text in (None, "", "12 34 !?", "\n"):
        assert profiles.predict(text) == ("und", 0.0)
    assert 0 <= profiles.predict("zzz qqq xxx")[1] <= 1


def test_language_rows(docs, clashing, empty):
    profiles = language.fit(docs)
    got = language.identify(clashing, profiles)
    assert got.count() == len(rows()) and set(clashing.columns) < set(got.columns)
    assert got.filter("text is null and lang_pred <> 'und'").count() == 0
    none = language.fit(empty)
    assert none.names == [] and none.predict("abc") == ("und", 0.0)
    assert language.identify(empty, none).count() == 0


def test_ranks_match_plain_counts():
    text = "Banana bandana, cabana!"
    codes = language.ranked(*language.grams(text), 10)
    padded = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
    count = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if (n == 1 and g == " ") or (n == 3 and g[1] == " "):
                continue
            code = 0
            for c in g:
                code = code << 21 | ord(c)
            count[code] += 1
    want = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))][:10]
    assert codes.tolist() == want


# ---------------------------------------------------------------- mixing


def plain_targets(sizes: dict, weights=(3, 1, 2)):
    """The clamp-and-reshare loop itself."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        rest = goal - sum(capped.values())
        share = {n: rest * w[n] / sum(w[x] for x in free) for n in free}
        over = [n for n in free if share[n] > 2 * sizes[n]]
        if not over:
            return {**capped, **share}
        capped |= {n: 2.0 * sizes[n] for n in over}


def test_mixing(docs, clashing, empty):
    for table in (docs, clashing):
        got = mixing.mix(table).select("doc_id", "text", "source", *mixing.OWN).collect()
        assert len(got) == len(rows())
        sizes, taken = Counter(), Counter()
        for r in got:
            assert r["mix_size"] == len(WORD.findall(r["text"] or ""))
            t = r["mix_whole"] * r["mix_size"] + r["mix_part"]
            assert 0 <= t <= 2 * r["mix_size"]
            sizes[r["source"]] += r["mix_size"]
            taken[r["source"]] += t
        want = plain_targets(dict(sizes))
        for r in got:
            assert r["mix_target"] == pytest.approx(want[r["source"]]) and r["mix_source_size"] == sizes[r["source"]]
        for s, t in taken.items():
            assert abs(t - want[s]) <= 1
    assert mixing.mix(empty).count() == 0
    again = [sorted(map(repr, mixing.mix(docs, keep=["doc_id"]).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_repeated_rows_of_a_mix(docs):
    mixed = mixing.mix(docs)
    want = mixed.agg(F.sum(F.expr("mix_whole * mix_size + mix_part"))).first()[0]
    out = mixing.repeated(mixed)
    assert out.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    total = 0
    for r in out.collect():
        total += len(WORD.findall(r["text"] or ""))
        assert any(d == r["doc_id"] and (t or "").startswith(r["text"] or "") for d, t in texts)
    assert total == want
    more = mixed.withColumns({"mix_full": F.lit("own"), "n_chars": F.length("text")})
    out = mixing.repeated(more, chars_col="n_chars")
    assert out.columns == [*docs.columns, "mix_full", "n_chars"]
    assert out.filter("mix_full != 'own' or n_chars != length(text)").count() == 0 and out.count() > 0


# ---------------------------------------------------------------- quality


def test_quality(docs, clashing, empty):
    cascade = quality.fit(docs)
    assert sorted(cascade.order) == sorted(quality.RULES)
    got = quality.judge(clashing, cascade).collect()
    assert len(got) == len(rows())
    for r in got:
        text = r["text"] or ""
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (r["rejected_by"] is None) and not (r["kept"] and r["base_failed"])
    assert quality.judge(empty, quality.fit(empty)).count() == 0


def test_any_order_of_rules_keeps_the_same():
    texts = [prose(i, 60) + " #$%" * i for i in range(30)] + [None, ""]
    one, two = quality.Cascade(list(quality.RULES)), quality.Cascade(list(quality.RULES)[::-1])
    for t in texts:
        x = quality.Text(t)
        assert (one.verdict(x) is None) == (two.verdict(x) is None) == (not any(rule(x) for rule in quality.RULES.values()))


# ---------------------------------------------------------------- licenses


def test_licenses(spark, docs, clashing, empty):
    mit = [s for s, i in licenses.SENTENCES.items() if i in ("mit-title", "mit-grant", "mit-notice")]
    texts = [
        (1, "Some prose. Released under the MIT License.\nMore."),
        (2, "licensed under  the APACHE license, version 2.0"),
        (3, mit[1] + ".\n" + mit[2] + ".\n" + mit[3] + "."),
        (4, "The word license, and the MIT license text is not here"),
        (5, None), (6, ""), (7, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0."),
    ]
    got = {(r["doc_id"], r["license"], r["rule"]) for r in licenses.license_matches(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", 3), (2, "Apache-2.0", 5), (3, "MIT", 0), (7, "CC-BY-4.0", 12), (7, "CC-BY-NC-4.0", 11)}
    assert licenses.license_matches(clashing).count() == licenses.license_matches(docs).count() == 0
    assert licenses.license_matches(empty).count() == 0


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark, docs, clashing, empty):
    items = [(1, prose(900, 30)), (2, prose(901, 16)), (3, "just three words"), (4, None), (5, ""), (6, prose(900, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = prose(900, 30).split(" ")
    texts = [
        (1, prose(1, 200) + " " + prose(900, 30).upper() + " " + prose(2, 100)),
        (2, prose(3, 50) + " " + " ".join(one[:27]) + " " + prose(4, 50)),
        (3, prose(5, 50) + " " + " ".join(one[:15]) + " " + prose(6, 50)),
        (4, "so it is JUST\tthree\nwords here"), (5, prose(901, 16)), (6, None), (7, ""), (8, prose(7, 400)),
    ]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find(more, bench).collect()}
    assert set(got) == {(1, 1), (1, 6), (2, 1), (2, 6), (4, 3), (5, 2)}
    assert got[1, 1]["similarity"] == 1.0 and got[1, 1]["start_word"] == 200 and got[1, 1]["n_words"] == 30
    assert 0.75 <= got[2, 1]["similarity"] < 1
    assert {r["doc_id"] for r in decontamination.clean(more, bench).collect()} == {3, 6, 7, 8}
    assert decontamination.find(clashing, bench).count() == decontamination.find(docs, bench).count()
    assert decontamination.clean(clashing, bench).columns == clashing.columns
    assert decontamination.find(empty, bench).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_against_all_windows():
    items = [(k, prose(k, 12 + k)) for k in range(12)]
    index = decontamination.Index(items, 0.75)
    for seed in range(6):
        parts = []
        for k in range(6):
            w = items[(seed + k) % 12][1].split(" ")
            parts += prose(50 + seed * 7 + k, 15).split(" ") + [x if (i * 7 + seed) % 17 else "zzz" for i, x in enumerate(w)][: len(w) - k % 3]
        words = decontamination.Words([" ".join(parts).encode()])
        got = {h[0]: h[1] for h in index.hits(words.hash)}
        want = {}
        for k, text in items:
            w = text.split(" ")
            bag = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            for s in range(len(parts) - len(w) + 1):
                win = Counter(tuple(parts[s + i : s + i + 5]) for i in range(len(w) - 4))
                low = sum((bag & win).values())
                sim = low / (sum(bag.values()) + sum(win.values()) - low)
                if sim >= 0.75:
                    want[k] = max(want.get(k, 0), sim)
        assert got == pytest.approx(want)


# ---------------------------------------------------------------- sharding


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(sharding.hilbert_index(cells, bits))
        assert sorted(sharding.hilbert_index(cells, bits).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark, docs, clashing, empty):
    for table in (docs, clashing):
        got = sharding.assign(table, 8).collect()
        assert len(got) == len(rows())
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        counts = [len(by[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    # Groups of equal texts: together in the order of shards and slots, and in one shard but for the cuts.
    order = [(r["size"], r["text_crc32"]) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert len([1 for a, b in zip(order, order[1:], strict=False) if a != b]) + 1 == len(set(order))
    apart = Counter(k for k, _ in {((r["size"], r["text_crc32"]), r["shard"]) for r in got})
    assert sum(1 for n in apart.values() if n > 1) < 8
    assert sharding.assign(empty, 8).count() == 0
    few = sharding.assign(docs.limit(3), 8)
    assert sorted(r["shard"] for r in few.collect()) == [0, 1, 2]


def test_shards_are_pruned(docs, tmp_path):
    out = sharding.assign(docs, 8)
    stats = sharding.shard_stats(out, ["size", "source"])
    found = {r["shard"] for r in sharding.prune(stats, size=(0, 200)).collect()}
    assert {r["shard"] for r in out.filter("size <= 200").collect()} <= found
    sharding.write_shards(out, f"{tmp_path}/s")
    assert docs.sparkSession.read.parquet(f"{tmp_path}/s").count() == len(rows())


# ---------------------------------------------------------------- tokens


def test_token_store_round_trip(spark, docs, clashing, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    odd = [(500, "a <|endoftext|> b", "en", ""), (501, "naïve café 漢字  x\x1c y  z", "en", ""), (502, "it's  we'll\n\n\n  don't 'x", "en", ""), (503, " ", "en", "")]
    table = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    path = f"file://{tmp_path}/store"
    tokenstore.write(table.withColumns({c: F.lit(7) for c in clashing.columns if c not in table.columns}), path, tokenizer)
    lib = Tokenizer.from_file(tokenizer)
    plain = [(d, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in [*rows(), *odd]]
    got = [(r["doc_id"], r["start"], list(r["ids"])) for r in tokenstore.documents(spark, path).collect()]
    assert sorted((repr(d), i) for d, _, i in got) == sorted((repr(d), i) for d, i in plain)
    at = 0
    for d, start, ids in sorted(got, key=lambda x: x[1]):
        assert start == at
        at += len(ids)
    ids_in_order = [d for d, s, _ in sorted(got, key=lambda x: x[1])]
    assert ids_in_order == sorted(ids_in_order, key=lambda d: (d is not None, d))
    sums = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.digests(spark, path).collect()}
    assert sums == {(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for _, s, i in got}
    assert tokenstore.verify(spark, path).count() == 0
    parts = spark.read.parquet(f"{path}/parts")
    chunks = parts.filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    tokenstore.write(empty, f"file://{tmp_path}/empty", tokenizer)
    assert tokenstore.digests(spark, f"file://{tmp_path}/empty").count() == 0


def test_a_damaged_chunk_is_found(spark, docs, tmp_path):
    import public_tokenizers

    path = f"file://{tmp_path}/store"
    tokenstore.write(docs.limit(5), path, public_tokenizers.path("byte_bpe_50k.json"))
    parts = spark.read.parquet(f"{path}/parts").filter("kind = 'chunk'").toPandas()
    body = bytes(parts["body"][0])
    parts.at[0, "body"] = body[:-1] + bytes([body[-1] ^ 1])
    with pytest.raises(tokenstore.Damaged):
        list(tokenstore._chunk_sums(iter([pa.RecordBatch.from_pandas(parts[["key", "body"]])]), 2))


def test_a_damaged_recipe_or_manifest_is_found(spark, docs, tmp_path):
    import public_tokenizers

    for what in ("recipes", "manifest", "start"):
        path = f"file://{tmp_path}/{what}"
        tokenstore.write(docs.limit(9), path, public_tokenizers.path("byte_bpe_50k.json"))
        root = tokenstore.corpus_root(spark, path)
        assert len(root) == 32 and tokenstore.digests(spark, path).count() == 9
        table = "manifest" if what == "manifest" else "recipes"
        rows_ = spark.createDataFrame(spark.read.parquet(f"{path}/{table}").toPandas(), spark.read.parquet(f"{path}/{table}").schema)
        change = {"recipes": F.when(F.col("position") == 3, F.reverse("addresses")).otherwise(F.col("addresses")), "manifest": F.lit(b"x" * 32), "start": F.col("start") + 1}[what]
        column = {"recipes": "addresses", "manifest": "root", "start": "start"}[what]
        rows_.withColumn(column, change).write.mode("overwrite").parquet(f"{path}/{table}")
        assert tokenstore.verify(spark, path).count() > 0
        with pytest.raises(tokenstore.Damaged):
            tokenstore.digests(spark, path)


def test_the_manifest_has_one_root(spark, docs, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenstore, "LEAVES", 4)
    path = f"file://{tmp_path}/store"
    tokenstore.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    levels = Counter(r["level"] for r in tokenstore._manifest(spark, path).collect())
    assert levels[max(levels)] == 1 and len(levels) > 2
    assert tokenstore.verify(spark, path).count() == 0


def test_ids_of_another_type_are_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        tokenstore.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), f"file://{tmp_path}/s", "none")


def test_encoder_against_the_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, enc, r = Tokenizer.from_file(path), tokenstore.Encoder(path), random.Random(5)
    enc.PLACES = 6  # pieces push each other out
    enc.forget()
    bits = ["'s", "'re", "'ll", " '", "'", " ", "  ", "\n", "\t", "a", "é", "ß", "9", "²", "!", "<|", "<|endoftext|>", "it", "\r\n", "漢", "\xa0", "ɏ", "ɐ", "\0", " word", "x" * 28, " 's", "s", "×", "\x7f"]
    for _ in range(400):
        texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(3)]
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_of_a_stream_do_not_depend_on_its_neighbours():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 50000, n).astype("<u2") for n in (1, 0, 5000, 31, 800)] + [np.zeros(20000, "<u2")]
    together = tokenstore.cuts(streams)
    for s, e in zip(streams, together, strict=True):
        assert tokenstore.cuts([s])[0].tolist() == e.tolist()
        assert (e[-1] if len(e) else 0) == len(s) and (np.diff(e, prepend=0) <= tokenstore.MOST).all()


def test_checksums_combine():
    rng = np.random.default_rng(1)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 30)]
    after = np.cumsum([len(p) for p in parts][::-1])[::-1] - np.array([len(p) for p in parts])
    moved = tokenstore.crc_after(np.array([zlib.crc32(p) for p in parts], np.uint64), after)
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


def test_merkle_root_depends_on_every_leaf():
    leaves = [bytes([i]) * 32 for i in range(7)]
    root = tokenstore.merkle_root(leaves)
    assert len({tokenstore.merkle_root(leaves[:i] + [b"x" * 32] + leaves[i + 1 :]) for i in range(7)} | {root}) == 8


# ---------------------------------------------------------------- toxicity


def plain_segments(scores):
    """Maximal segments by the definition: the best segment, then those of what is left and right of it."""
    def best(a, b):
        top, where = 0, None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += scores[j]
                if s > top or (s == top and where and i == where[0] and j + 1 < where[1]):
                    top, where = s, (i, j + 1)
        if where is None:
            return []
        i, j = where
        return best(a, i) + [(i, j, top)] + best(j, b)

    return best(0, len(scores))


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = [float(x) for x in rng.integers(-5, 5, rng.integers(0, 25)) + rng.random() * 0.01]
        got = toxicity.maximal_segments(s)
        want = plain_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_toxicity(spark, docs, clashing, empty):
    data, marks = [], []
    for i in range(400):
        text = prose(3000 + i, 40)
        if i % 8 == 0:
            text = text[:60] + " grobian lout " + text[60:] + " grobian"
        data.append((i, text, "en", "s"))
        marks.append((i, int(i % 8 == 0)))
    table = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(table, labels.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(table, model).collect()}
    assert all((got[d] >= 0.5) == bool(y) for d, y in marks)
    assert 0 <= model.score(None)[0] < 0.5 and model.score("")[1] == []
    assert toxicity.score(clashing, model).count() == len(rows())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(table, labels.limit(0))
    assert none.score("grobian")[0] == 0.0
    assert toxicity.fit(table, labels.filter("toxic = 1")).score("x")[0] == 1.0
