"""Graphs over vertices: components, floods, bounded shortest paths. Each round is written out, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshspark.shared import shared_dir


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """v, root: the least vertex that each vertex of edges(a, b) can reach.

    Labels take the least of their neighbours', then that label's own label, until none changes.
    """
    both = settled(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct())
    label = settled(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")))
    while True:
        near = both.join(label.select(F.col("v").alias("w"), F.col("root").alias("r")), "w").groupBy("v").agg(F.min("r").alias("r"))
        new = label.join(near, "v").select("v", F.least("root", "r").alias("new"), "root")
        jump = new.join(new.select(F.col("v").alias("new"), F.col("new").alias("far")), "new").select("v", F.least("new", "far").alias("new"), "root")
        jump = settled(jump)
        label = jump.select("v", F.col("new").alias("root"))
        if not jump.filter("new <> root").take(1):
            return label


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """v, hop: vertices within `most` steps of the seeds (v)."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct()
    seen = seeds.select("v").distinct().withColumn("hop", F.lit(0))
    for k in range(1, most + 1):
        front = seen.filter(F.col("hop") == k - 1).select("v")
        new = front.join(both, "v").select(F.col("w").alias("v")).distinct().join(seen, "v", "left_anti")
        seen = settled(seen.union(new.withColumn("hop", F.lit(k))))
    return seen


def flood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """v, label: labels spread from seeds(v, label) along edges step by step; where several arrive at once the least stays."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct()
    done = settled(seeds.groupBy("v").agg(F.min("label").alias("label")))
    front = done
    while front.take(1):
        reach = front.join(both, "v").groupBy(F.col("w").alias("v")).agg(F.min("label").alias("label"))
        front = settled(reach.join(done, "v", "left_anti").select("v", "label"))
        done = settled(done.union(front))
    return done


def distances(edges: DataFrame, seeds: DataFrame, cap: float) -> DataFrame:
    """v, d: shortest path lengths from seeds(v) over edges(a, b, len) both ways, up to the cap."""
    both = settled(edges.select(F.col("a").alias("v"), F.col("b").alias("w"), "len").union(edges.select("b", "a", "len")))
    best = seeds.select("v").distinct().withColumn("d", F.lit(0.0))
    moved = best
    while moved.take(1):
        step = moved.join(both, "v").select(F.col("w").alias("v"), (F.col("d") + F.col("len")).alias("d")).filter(F.col("d") <= cap)
        new = settled(best.union(step).groupBy("v").agg(F.min("d").alias("d")))
        moved = new.join(best.withColumnRenamed("d", "old"), "v", "left").filter("old is null or d < old").select("v", "d")
        best = new
    return best


def walk_loops(edges: DataFrame) -> DataFrame:
    """loop, pos, v: the vertices of closed loops of edges (a to b, one out of each vertex) in order from the least, which names it.

    By pointer doubling: after k rounds a vertex knows the least one within 2**k steps, and then how far after it it stands.
    """
    now = settled(edges.select("a", F.col("b").alias("to"), F.least("a", "b").alias("low")))
    while True:
        hop = now.select(F.col("a").alias("to"), F.col("to").alias("far"), F.col("low").alias("their"))
        new = settled(now.join(hop, "to").select("a", F.col("far").alias("to"), F.least("low", "their").alias("low"), (F.least("low", "their") < F.col("low")).alias("moved")))
        now = new.drop("moved")
        if not new.filter("moved").take(1):
            break
    low = settled(now.select(F.col("a").alias("v"), F.col("low").alias("loop")))
    # Steps back to the least vertex, whose own step is none.
    back = edges.join(low.withColumnRenamed("v", "b"), "b")
    far = settled(back.select(F.col("b").alias("v"), F.when(F.col("b") == F.col("loop"), F.col("b")).otherwise(F.col("a")).alias("to"), F.when(F.col("b") == F.col("loop"), 0).otherwise(1).alias("pos"), "loop"))
    while far.filter("to <> loop").take(1):
        hop = far.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("pos").alias("more"))
        far = settled(far.join(hop, "to").select("v", F.col("next").alias("to"), (F.col("pos") + F.col("more")).alias("pos"), "loop"))
    return far.select("loop", "pos", "v")
