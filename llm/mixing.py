"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source wants the same multiple of its weight. A source whose share would exceed `max_epochs` passes over its own
words is clamped there, and what it can't take is dealt again among the others by weight, until none is above. The fixed
point of that clamp-and-reshare loop is found in one pass: with the sources in ascending order of cap / weight, the
clamped ones are a prefix, and a source belongs to it if its share of what the sources before it leave over exceeds its
cap.

A source's target then is met to the word: every document is taken `whole` times, and in a seeded order documents get one
further repetition until the target is reached; the document that crosses it is repeated in part, up to the word that
meets the target.

Only built-in functions are used. The order within a source, by a hash of id and text, is cut into hash buckets, whose sums
are small tables. A source's further repetition covers the buckets before the one in which its target is reached, and none
after; only the rows of that one bucket are put in order, so no text but theirs is shuffled, however large a source is.

Nulls and edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last; rows
with equal ids are separate documents; rows with equal ids and texts (ties) are taken in any order, which changes no count
of words; with no words at all every target is 0; an empty table gives an empty result; very long texts are counted and cut
whole. Input columns named like the five of the mix are replaced, other names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.session import work_table

BUCKETS = 1 << 14
#: So many sources are broadcast to the rows; more are joined, and texts shuffled for it.
FEW_SOURCES = 10_000
SPACE = r"[\x20\x09-\x0D]"
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_whole", "mix_part")
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=(3, 2), max_epochs: int = 2) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, weight, target.

    Sources by code point, null last, weigh `weights` in turn; together they get share[0] / share[1] of all sizes. The
    windows run over one row per source, never over documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    t = t.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share[0])) / F.lit(float(share[1])))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("capped", F.col("weight") * (F.col("goal") - before) > F.col("cap") * onward)
    rest = F.col("goal") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    among = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest / among)
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=(3, 2), max_epochs: int = 2, seed: str = "mix-1", keep=None) -> DataFrame:
    """The columns `keep` of docs (all by default), with mix_size, mix_source_size, mix_target, mix_whole and mix_part.

    mix_whole: how often the whole text is taken; mix_part: words taken in one further, partial repetition (the size
    itself for a whole one). Input columns of these five names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    key = F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        ident.alias("id"),
        F.coalesce(F.expr(f"regexp_count(`{text_col}`, r'{WORD}')"), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
    ).withColumn("b", F.shiftright("h", 60 - (BUCKETS - 1).bit_length()).cast("int"))

    per_bucket = sized.groupBy("source", "b").agg(F.sum("size").alias("b_size"))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("b_size").alias("source_size")), weights, share, max_epochs)
    goals = targets.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
    goals = goals.withColumn("extra", F.col("quota") - F.col("whole") * F.col("source_size"))
    # The bucket in which the further repetition ends: the one that holds its last word, if it has one.
    base = F.sum("b_size").over(Window.partitionBy("source").orderBy("b")) - F.col("b_size")
    edge = per_bucket.withColumn("base", base).alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source and p.base < g.extra and p.base + p.b_size >= g.extra"))
    edge = edge.select(F.col("p.source").alias("es"), F.col("p.b").alias("eb"), "base")
    info = goals.join(edge, F.expr("source <=> es"), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "extra", F.coalesce("eb", F.lit(-1)).alias("eb"), "base")
    info = work_table(info, "mix")  # a row a source
    joined = sized.join(F.broadcast(info) if info.count() <= FEW_SOURCES else info, F.expr("source <=> s"))
    clear = joined.filter("b != eb").withColumn("part", F.when(F.col("b") < F.col("eb"), F.col("size")).otherwise(0))
    within = Window.partitionBy("s").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    past = F.col("base") + F.sum("size").over(within) - F.col("size")
    split = joined.filter("b = eb").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - past)))
    return clear.unionByName(split).select(
        "row", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.col("whole").cast("long").alias("mix_whole"), F.col("part").cast("long").alias("mix_part"),
    ).select("row.*", *OWN)


def repeated(mixed: DataFrame, text_col="text", chars_col: str | None = None) -> DataFrame:
    """The rows of a mix as a corpus: each document as often as it is taken whole, and its first words for a partial repetition.

    chars_col: a column with the number of characters of the text; it gets that of the part.
    """
    columns = [c for c in mixed.columns if c not in OWN]
    full = "mix_full"
    while full in columns:
        full += "_"
    whole = F.col("mix_part") == F.col("mix_size")
    cut = F.when(~whole & (F.col("mix_part") > 0), 1).otherwise(0)
    times = F.expr("array_repeat(true, cast(mix_whole + case when mix_part = mix_size and mix_size > 0 then 1 else 0 end as int))")
    flags = F.concat(times, F.when(cut == 1, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    runs = mixed.withColumn(full, F.explode(flags))
    words = F.expr(f"array_join(slice(regexp_extract_all(`{text_col}`, r'{WORD}{SPACE}*', 0), 1, cast(mix_part as int)), '')")
    runs = runs.withColumn(text_col, F.when(F.col(full), F.col(text_col)).otherwise(words))
    if chars_col in columns:
        runs = runs.withColumn(chars_col, F.when(F.col(full), F.col(chars_col)).otherwise(F.length(text_col).cast(mixed.schema[chars_col].dataType)))
    return runs.select(*[F.col(f"`{c}`") for c in columns])
