"""Global positions and running totals without a single-task window.

Rows are range-partitioned by the order, so any key may hold any part of them, sorted within partitions, and written to
the shared folder with their partition and place. Partition totals are as many rows as there are partitions; adding up
the totals before a partition gives its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.session import partitions, work_table

_PLACE = (1 << 33) - 1


def running(df: DataFrame, order: list[Column], weights: dict[str, str] | None = None, name: str = "order") -> DataFrame:
    """df with `position` (from 0) and, for each name: column of weights, the sum of that column over all earlier rows.

    The order should be total but for rows that are alike. Extra columns pid and place are left for later joins.
    """
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place_id", F.monotonically_increasing_id())
    placed = work_table(placed.withColumns({"pid": F.shiftright("place_id", 33), "place": F.col("place_id").bitwiseAND(F.lit(_PLACE))}).drop("place_id"), name)
    weights = weights or {}
    totals = placed.groupBy("pid").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"sum_{k}") for k, c in weights.items()])
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = totals.select("pid", zero("rows").alias("off_rows"), *[zero(f"sum_{k}").alias(f"off_{k}") for k in weights])
    out = placed.join(offsets, "pid").withColumn("position", F.col("off_rows") + F.col("place"))
    inside = Window.partitionBy("pid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    for k, c in weights.items():
        out = out.withColumn(k, F.col(f"off_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("off_rows", *[f"off_{k}" for k in weights])
