"""Statistics with the conventions of the geometry tools: means with lost degrees of freedom, upper medians, equalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshspark.operators.order import running


def upper_median(c) -> Column:
    """The element at n / 2 of the sorted values: the greater of the two middle ones. An aggregate."""
    return F.expr(f"sort_array(collect_list({c}))[cast(floor(count({c}) / 2) as int)]")


def exact_upper_median(df: DataFrame, column: str) -> DataFrame:
    """median of a whole column, without gathering it: rank by running counts over distinct values."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return running(n, [column], {"upto": "n"}).crossJoin(F.broadcast(total)).filter("upto > floor(total / 2)").agg(F.min(column).alias("median"))


def mean(c, dof: int = 0) -> Column:
    return F.sum(c) / (F.count(c) - dof)


def variance(c, dof: int = 0) -> Column:
    """(n sum x**2 - (sum x)**2) / (n (n - dof))"""
    x = F.col(c)
    n = F.count(x).cast("double")
    return (n * F.sum(x * x) - F.sum(x) * F.sum(x)) / (n * (n - dof))


def top2(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order), key)
    return df.withColumn("r", F.row_number().over(w)).filter("r <= 2")


def equalize(df: DataFrame, column: str, bins: int) -> DataFrame:
    """df with bin and level: the part of all values at or below the value's bin."""
    ends = F.broadcast(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).cast("int")
    binned = df.crossJoin(ends).withColumn("bin", b).drop("lo", "hi")
    n = binned.groupBy("bin").agg(F.count("*").alias("n"))
    cum = n.withColumn("c", F.sum("n").over(Window.orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a bin
    return binned.join(F.broadcast(cum.select("bin", (F.col("c") / F.col("total")).alias("level"))), "bin")


def sample(df: DataFrame, ident: str, n: int, seed: str = "sample-1") -> DataFrame:
    """n rows (all, if there are fewer) drawn without repetition: the least by a hash of seed and id, the same on every run."""
    return df.sort(F.md5(F.concat(F.lit(seed + ":"), F.col(ident).cast("string"))), ident).limit(n)


def quantile_bin(histogram: DataFrame, q: float) -> DataFrame:
    """One row, bin: the least bin of (bin, n) at which the running count reaches q of all. Bins are few."""
    order = Window.orderBy("bin")
    run = histogram.select("bin", F.sum("n").over(order).alias("run"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return run.filter(F.col("run") >= q * F.col("all")).agg(F.min("bin").alias("bin"))
