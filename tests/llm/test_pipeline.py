"""The pipeline's stages on a small corpus."""

import re

from tests.llm.conftest import SCHEMA, prose, rows
from tests.llm.plain import brute_components


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    from llm import tokenstore

    item = prose(5000, 25)
    data = [*rows(), (600, prose(5001, 80) + " " + item + " " + prose(5002, 40), "en", "s1"), (601, "123 456 !!", "en", "s1")]
    schema = SCHEMA + ", n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in data], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = out
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
    lang = [tuple(r)[:4] for r in kept["language_id"].collect()]
    assert {(r[0], r[1]) for r in lang} == {(r[0], r[1]) for r in data if r[1] and re.search(r"[^\W\d_]", r[1])}
    # one row of each component
    components = brute_components(lang)
    leaders = {c for d, n, c, _ in components}
    left = [r["doc_id"] for r in kept["ngram_jaccard_join"].collect()]
    assert sorted(left) == sorted(leaders)
    assert set(left) - {r["doc_id"] for r in kept["benchmark_decontamination"].collect()} == {600}
    mixed = kept["source_mixing"]
    assert {r["doc_id"] for r in mixed.collect()} <= set(left)
    tokens = kept["token_store"]
    assert tokens.count() == mixed.count()
    assert tokens.agg({"n_tokens": "sum"}).first()[0] > mixed.count()
    assert p.run(spark, str(tmp_path)).count() == tokens.count()
    assert tokenstore.END_ID == 2


def test_stages_with_no_rows_and_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = SCHEMA + ", lang_pred string, score int, leader int, mix_size int, mix_part int, row int, id int, size int"
    data = [(*r, "own", 1, 2, 3, 4, 5, 6, 7) for r in rows()]
    for k, table in enumerate((spark.createDataFrame([], schema), spark.createDataFrame(data, schema))):
        table.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        for name, stage in p.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if k == 0:
                assert got == []
            if name != "token_store":
                assert out.columns == docs.columns
                assert all((r["lang_pred"], r["score"], r["leader"], r["mix_size"], r["mix_part"]) == ("own", 1, 2, 3, 4) for r in got)
            assert k == 0 or got


def test_repeated_ids_with_different_texts(spark, tmp_path):
    import corpus_pipeline as p

    base = prose(1, 60)
    data = [(1, base, "en", "a", 5), (2, prose(2, 60), "en", "a", 5), (2, base + " more", "en", "a", 5), (3, prose(3, 50), "de", "b", 7), (3, prose(3, 50), "de", "b", 6), (None, prose(4, 50), "en", "a", 5), (None, prose(4, 50) + " x", "en", "a", 5), (-5, prose(2, 60), "en", "c", 1), (9, None, "en", "a", 0), (9, "", "en", "a", 0)]
    docs = spark.createDataFrame(data, SCHEMA + ", n_chars long")
    got = sorted((repr(r["doc_id"]), (r["text"] or "")[:9], r["n_chars"]) for r in p.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    kept = {x for x in got if x[0] == "None"}
    assert len(kept) == 1 and sorted(x for x in got if x[0] != "None") == sorted([("1", base[:9], 5), ("-5", prose(2, 60)[:9], 1), ("3", prose(3, 50)[:9], 6), ("9", "", 0), ("9", "", 0)])


def test_parts_have_their_own_length(spark, tmp_path):
    import corpus_pipeline as p

    data = [(i, prose(i, 30 + i), "en", "abc"[i % 3], len(prose(i, 30 + i))) for i in range(40)]
    out = p.mix_sources(spark, spark.createDataFrame(data, SCHEMA + ", n_chars int"), str(tmp_path))
    assert out.schema["n_chars"].dataType.simpleString() == "int"
    rows_ = out.collect()
    assert rows_ and all(r["n_chars"] == len(r["text"]) for r in rows_) and any(r["text"] not in {d[1] for d in data} for r in rows_)
