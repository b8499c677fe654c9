"""Spatial joins planned as equi-joins on grid cells.

A distance predicate alone would be a nested-loop join. Here each side gets the integer cell of its point, one side is
copied to the 27 cells around its own (or a box to the cells it covers), and the equi-join on cells is followed by the exact
predicate. Joins are complete for distances up to the cell's side. kNN goes by the blocks of a k-d tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshspark.functions import geometry as g
from meshspark.operators import blocks
from meshspark.operators.graph import settled


def cell(df: DataFrame, side: float, names=("gx", "gy", "gz")) -> DataFrame:
    return df.withColumns({n: F.floor(F.col(c) / side) for n, c in zip(names, "xyz", strict=True)})


def around(df: DataFrame, side: float, reach: int = 1) -> DataFrame:
    """Each point once for each cell within `reach` cells of its own."""
    df = cell(df, side)
    for n in ("gx", "gy", "gz"):
        df = df.withColumn(n, F.explode(F.sequence(F.col(n) - reach, F.col(n) + reach)))
    return df


def within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """q, id, d2: points (id, x, y, z) within the radius of queries (q, x, y, z)."""
    qs = around(queries.select("q", "x", "y", "z"), radius).select("q", *[F.col(c).alias("q" + c) for c in "xyz"], "gx", "gy", "gz")
    ps = cell(points.select("id", "x", "y", "z"), radius)
    near = qs.join(ps, ["gx", "gy", "gz"]).select("q", "id", g.dist2(g.vec("q"), g.vec()).alias("d2"))
    return near.filter(F.col("d2") <= radius * radius)


def knn(queries: DataFrame, points: DataFrame, k: int, side: float | None = None) -> DataFrame:
    """q, rank, id, d2: the k nearest points of each query, ties by least id; fewer if there are fewer points.

    Searched block by block (`blocks`), so neither distribution nor copies make more pairs; `side` is not needed any more.
    """
    found = blocks.nearest_in_blocks(queries, points, k, settled)
    w = Window.partitionBy("q").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "id", "d2")


def knn_by(queries: DataFrame, points: DataFrame, k: int, by: str) -> DataFrame:
    """q, block, id, d2: for each query the k nearest points of each value of `by`, the values numbered as block."""
    found = blocks.nearest_in_blocks(queries, points, k, settled, by)
    w = Window.partitionBy("q", "part").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", F.col("part").alias("block"), "id", "d2")


def nearest(queries: DataFrame, points: DataFrame, side: float | None = None) -> DataFrame:
    """q, id, d2: the nearest point, of several the one of least id."""
    return knn(queries, points, 1, side).select("q", "id", "d2")


def boxes(df: DataFrame, low: tuple[str, str, str], high: tuple[str, str, str], side: float) -> DataFrame:
    """Each row once for each cell its box covers."""
    for n, lo, hi in zip(("gx", "gy", "gz"), low, high, strict=True):
        df = df.withColumn(n, F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))))
    return df


def overlaps(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """l, r: boxes (l or r, lox .. hiz) that meet, borders included."""
    cols = [n + c for n in ("lo", "hi") for c in "xyz"]
    x = boxes(left.select("l", *[F.col(c).alias("l" + c) for c in cols]), ("llox", "lloy", "lloz"), ("lhix", "lhiy", "lhiz"), side)
    y = boxes(right.select("r", *[F.col(c).alias("r" + c) for c in cols]), ("rlox", "rloy", "rloz"), ("rhix", "rhiy", "rhiz"), side)
    met = x.join(y, ["gx", "gy", "gz"])
    for c in "xyz":
        met = met.filter((F.col("llo" + c) <= F.col("rhi" + c)) & (F.col("rlo" + c) <= F.col("lhi" + c)))
    return met.select("l", "r").distinct()


def triangle_overlaps(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """l, r: triangles (l or r, ax .. cz) with points in common: boxes that meet, then the exact test."""
    sides = []
    for df, name in ((left, "l"), (right, "r")):
        ends = {end + c: f(*[p + c for p in "abc"]) for end, f in (("lo", F.least), ("hi", F.greatest)) for c in "xyz"}
        sides.append((df.select(name, *[v.alias(k) for k, v in ends.items()]), df.select(name, *[F.col(p + c).alias(name + p + c) for p in "abc" for c in "xyz"])))
    met = overlaps(sides[0][0], sides[1][0], side).join(sides[0][1], "l").join(sides[1][1], "r")
    one, two = ([g.vec(name + p) for p in "abc"] for name in "lr")
    return met.filter(g.triangles_meet(one, two)).select("l", "r")


def in_tets(points: DataFrame, tets: DataFrame, side: float) -> DataFrame:
    """id, t: the tetrahedra (t, ax .. dz) a point lies in; of several the one of least id."""
    for c in "xyz":
        tets = tets.withColumns({"lo" + c: F.least(*[p + c for p in "abcd"]), "hi" + c: F.greatest(*[p + c for p in "abcd"])})
    t = boxes(tets, ("lox", "loy", "loz"), ("hix", "hiy", "hiz"), side)
    p = cell(points, side)
    met = p.join(t, ["gx", "gy", "gz"]).filter(g.in_tet(g.vec(), *[g.vec(c) for c in "abcd"]))
    return met.groupBy("id").agg(F.min("t").alias("t"))


def nearest_triangle(points: DataFrame, tris: DataFrame, side: float, rounds: int = 40) -> DataFrame:
    """id, f, d2: the nearest triangle (f, ax .. cz) of each point, of several the one of least f.

    Triangles are dealt to the cells their boxes cover, points look into the 27 cells around theirs; a point is closed when
    what it found lies within the side of a cell, and the rest go on with doubled cells.
    """
    corners = [g.vec(p) for p in "abc"]
    for c in "xyz":
        tris = tris.withColumns({"lo" + c: F.least(*[p + c for p in "abc"]), "hi" + c: F.greatest(*[p + c for p in "abc"])})
    ends = tris.agg(*[f(n + c).alias(n + c) for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).first()
    box = points.agg(*[f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    if ends["lox"] is None or box["lox"] is None:
        return points.select("id", F.lit(0).alias("f"), F.lit(0.0).alias("d2")).limit(0)
    extent = sum((max(box["hi" + c], ends["hi" + c]) - min(box["lo" + c], ends["lo" + c])) ** 2 for c in "xyz") ** 0.5
    done, left = None, points.select("id", "x", "y", "z")
    for _ in range(rounds):
        last = side > extent
        dealt = boxes(tris, ("lox", "loy", "loz"), ("hix", "hiy", "hiz"), side)
        met = around(left, side).join(dealt, ["gx", "gy", "gz"]).withColumn("d2", g.triangle_distance2(g.vec(), *corners))
        best = settled(met.groupBy("id").agg(F.min(F.struct("d2", "f")).alias("b")).select("id", "b.f", "b.d2"))
        closed = best if last else best.filter(F.col("d2") <= side * side)
        done = closed if done is None else done.unionByName(closed)
        left = settled(left.join(closed.select("id"), "id", "left_anti"))
        if last or not left.take(1):
            break
        side *= 2
    return done
