"""Sharding along a Hilbert curve: shards whose metadata ranges are narrow in several dimensions at once.

Each dimension is quantised to `bits` bits (numbers by quantiles, strings by the place of their value among all values),
the cells are numbered along a Hilbert curve, rows are sorted by that number, and the sorted run is cut into shards of
equal row counts (one apart at most). Consecutive cells of the curve are neighbours, so a shard covers a compact region and
a filter on any of the dimensions opens few of them; `shard_stats` and `prune` keep and use the ranges.

Rows with equal texts form a group, which stands at the least place of its rows on the curve, whatever their other
dimensions; so a group lies in one shard unless a cut falls into it, which is the case for fewer groups than there are
shards. Rows are range-partitioned by the whole order, ids included, so a hot source, cell or text is spread over tasks.

Edge cases: a null dimension is the lowest cell; a null text has size 1 and the checksum of the empty text, and is in the
group of the empty texts; with fewer rows than shards the last shards stay empty; repeated rows (ties of the whole order) get
different slots; an empty table gives an empty result; very long texts are only measured and hashed; of the input only the
id, the text and the dimensions are read, so other columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.ordering import running
from llm.session import work_table

BITS = 4


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points given as rows of non-negative integers below 2**bits.

    Works on the transposed form of the index: undoes excess rotations from the highest bit down, then Gray-decodes.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cells(df: DataFrame, number_dims: list[str], string_dims: list[str], bits: int) -> DataFrame:
    """df with an integer column cell_<dim> for each dimension."""
    top = (1 << bits) - 1
    if number_dims:
        cuts = df.agg(*[F.percentile_approx(F.col(d).cast("double"), [k / (top + 1) for k in range(1, top + 1)], 1000).alias(d) for d in number_dims]).first()
        for d in number_dims:
            at = F.size(F.filter(F.array(*map(F.lit, sorted(cuts[d] or [0.0]))), lambda c, v=F.col(d): c < v))
            df = df.withColumn(f"cell_{d}", F.when(F.col(d).isNull(), 0).otherwise(at))
    for d in string_dims:
        ranked = running(df.select(F.col(d).alias("value")).distinct(), [F.col("value").asc_nulls_first()], name="values")
        n = F.broadcast(ranked.agg(F.count("*").alias("n")))  # one row
        cells = ranked.crossJoin(n).select("value", F.floor(F.col("position") * (top + 1) / F.col("n")).cast("int").alias(f"cell_{d}"))
        df = df.join(cells, F.col(d).eqNullSafe(F.col("value")), "left").drop("value")
    return df


def assign(docs: DataFrame, n_shards: int, *, id_col="doc_id", text_col="text", number_dims=("size",), string_dims=("source", "lang"), bits: int = BITS) -> DataFrame:
    """id, size, text_crc32, the dimensions, hilbert, shard and slot of every row.

    size is the UTF-8 length of the text plus one; it may be named as a dimension.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [d for d in (*number_dims, *string_dims) if d not in ("size", id_col)]
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *[F.col(d) for d in others])
    rows = _cells(rows, list(number_dims), list(string_dims), bits)
    names = [f"cell_{d}" for d in (*number_dims, *string_dims)]

    @F.pandas_udf("long")
    def index(cells: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in cells:
            yield pd.Series(hilbert_index(batch.to_numpy(np.int64), bits)) if len(batch) else pd.Series([], dtype="int64")

    rows = rows.withColumn("hilbert", index(F.struct(*names))).drop(*names)
    rows = work_table(rows, "curve")
    group = ["size", "text_crc32", "text_hash"]
    moved = rows.groupBy(*group).agg(F.min("hilbert").alias("least"), F.max("hilbert").alias("most")).filter("least < most").drop("most")
    rows = rows.join(moved, group, "left").withColumn("at", F.coalesce("least", "hilbert")).drop("least")
    placed = running(rows, [F.col("at"), *map(F.col, group), F.xxhash64(id_col), F.col(id_col)], name="shards").drop("at", "text_hash")
    total = placed.agg(F.count("*").alias("total"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    least, more = F.expr(f"total div {n_shards}"), F.expr(f"total % {n_shards}")
    edge = more * (least + 1)
    shard = F.when(F.col("position") < edge, F.expr(f"position div (total div {n_shards} + 1)")).otherwise(more + F.expr(f"(position - (total % {n_shards}) * (total div {n_shards} + 1)) div greatest(total div {n_shards}, 1)"))
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("position") - (F.col("shard") * least + F.least(F.col("shard"), more))
    return placed.withColumn("slot", slot.cast("long")).drop("pid", "place", "position", "total")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order."""
    assigned.repartition(F.col("shard")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_stats(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """Row count and the range of each dimension, by shard."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))])


def prune(stats: DataFrame, **ranges) -> DataFrame:
    """The shards that may hold rows with every dimension within its (low, high)."""
    for d, (low, high) in ranges.items():
        stats = stats.filter((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return stats.select("shard")
