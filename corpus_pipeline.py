"""The corpus pipeline: language, near duplicates, benchmark leaks, source mix, token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import decontamination, language, mixing, ngram_join, tokenstore
from llm.session import read, ready, work_path, work_table

#: A text whose distance from the nearest profile is so near the largest possible isn't in any language learned.
LEAST_LANGUAGE_SCORE = 0.2


def shielded(docs: DataFrame, own) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of an operator's own names put aside, and the names to give back."""
    aside = {c: f"{c}__kept" for c in docs.columns if c in own}
    while set(aside.values()) & set(docs.columns):
        aside = {c: n + "_" for c, n in aside.items()}
    return docs.withColumnsRenamed(aside), {n: c for c, n in aside.items()}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can't be told (none, or unlike every profile) go; the others get the language found.

    Null and empty texts have no language and go; with no row to learn from all go.
    """
    ready(spark)
    profiles = language.fit(docs)
    safe, back = shielded(docs, ("lang_pred", "score"))
    named = language.identify(safe, profiles)
    kept = named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one stays: of those of least id the one whose text has the least hash.

    Rows without an id come after all others. Of rows with equal ids and texts the one whose other columns are least stays,
    and of wholly equal rows one. Texts without words link with nothing, so one row of each id and text of them stays. No
    rows give no rows; very long texts are compared whole; columns of any name are kept.
    """
    ready(spark)
    safe, back = shielded(docs, ("row_key", "leader"))
    # One key orders rows by id, then text: ids may repeat, with different texts.
    ident = F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))) if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.col("doc_id").cast("string")
    key = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.coalesce(F.lpad(ident, 16, "0"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.col("text").isNull().cast("string"))
    safe = safe.withColumn("row_key", key)
    rows = work_table(ngram_join.join(safe.select("row_key", "text"), id_col="row_key").select("row_key", "component_id"), "leaders")
    leaders = rows.filter("row_key = component_id").groupBy(F.col("row_key").alias("leader")).agg(F.count("*").alias("n"))
    kept = safe.join(leaders.filter("n = 1").select("leader"), F.expr("row_key = leader"), "left_semi").drop("row_key")
    again = safe.join(leaders.filter("n > 1").select("leader"), F.expr("row_key = leader"), "left_semi")
    one = again.groupBy("row_key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in kept.columns])).alias("r")).select("r.*")
    return kept.unionByName(one).withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go; all others stay, null and empty texts too, and rows that repeat.

    An empty benchmark drops none, no rows give no rows, very long texts are searched whole, columns of any name are kept.
    """
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a partial repetition is the text's first words, and n_chars counts those.

    Null texts and texts without words go; a null source is a source; rows that repeat are documents of their own, and of
    wholly equal ones (ties) any may be the partial one; no rows give no rows; columns of any name are kept.
    """
    ready(spark)
    safe, back = shielded(docs, mixing.OWN)
    chars = "n_chars" if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None
    return mixing.repeated(mixing.mix(safe), chars_col=chars).withColumnsRenamed(back).select(*docs.columns)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row in a content-addressed store, read back.

    Null and empty texts are the end id alone; rows that repeat are kept apart, ids that are equal or null stand together,
    null ones first; no rows give no rows; other columns aren't read. Ids must be integers.
    """
    import public_tokenizers

    ready(spark)
    path = work_path(spark, "tokens")
    tokenstore.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenstore.digests(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_store", store_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = work_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Profiles, links, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
