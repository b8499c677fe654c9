"""Places and running sums over all rows, without a window that puts them into one task.

Rows are dealt out by ranges of the order, sorted within them and checkpointed with their range and place. One sum a range
is all that is added up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshspark.operators.graph import settled

_RANGE, _PLACE, _BEFORE = "_range", "_place", "_before_"


def running(df: DataFrame, by: list[str], sums: dict[str, str | None] | None = None) -> DataFrame:
    """df with, for each name: column of whole numbers, the sum of that column over all rows up to each; None gives a row's
    place from 0.

    Without sums it is `place`. Columns `by` should tell rows apart; rows that they don't tell apart come in any one order.
    """
    sums = {"place": None} if sums is None else sums
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(_PLACE, F.monotonically_increasing_id())
    dealt = settled(dealt.withColumn(_RANGE, F.shiftright(_PLACE, 33)))
    value = {k: F.lit(1) if c is None else F.col(c) for k, c in sums.items()}
    totals = dealt.groupBy(_RANGE).agg(*[F.sum(c).alias(k) for k, c in value.items()])
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(_RANGE), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(_BEFORE + k) for k in sums])
    within = Window.partitionBy(_RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), _RANGE)  # a row a partition
    upto = {k: F.col(_BEFORE + k) + F.sum(c).over(within) - (1 if sums[k] is None else 0) for k, c in value.items()}
    return out.withColumns(upto).drop(_RANGE, _PLACE, *[_BEFORE + k for k in sums])
