"""The registered query of each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontamination, language, licenses, mixing, ngram_join, quality, sharding, suffix_dedup, tokenstore, toxicity
from llm.oracles import ORACLES  # noqa: F401
from llm.session import crc32_of_id, read


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 75 % of their 5-word shingles."""
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's checksum isn't 2 modulo 4."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.expr(f"{crc32_of_id('doc_id')} % 4 = 2"), F.lit(False))
    profiles = language.fit(docs.filter(~held_out))
    return language.identify(docs, profiles, keep=["doc_id"]).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 3 : 1 : 2 by source to 150 % of all words, twice at most."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    taken = F.col("mix_whole") * F.col("mix_size") + F.col("mix_part")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = read(spark, sf_dir, "documents")
    rows = quality.judge(docs, quality.fit(docs), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license that a document names."""
    return licenses.license_matches(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along a Hilbert curve over size, source and language."""
    rows = sharding.assign(read(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that start in an earlier one."""
    rows = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, stored by content, and read back."""
    import public_tokenizers

    path = tokenstore.store_path(spark)
    tokenstore.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenstore.digests(spark, path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows whose id's checksum isn't 0 modulo 5."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.expr(f"{crc32_of_id('doc_id')} % 5 = 0"), F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_starts").alias("n_spans"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_store": op9_token_store,
    "op10_toxicity": op10_toxicity,
}

