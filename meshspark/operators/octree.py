"""Octrees as Morton prefixes: a node is (depth, code); its children are the codes with three more bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshspark.functions import geometry as g
from meshspark.functions import scalars as sc
from meshspark.operators.linear import symmetric_eigen


def coded(points: DataFrame, low: tuple, side: float, depth: int) -> DataFrame:
    """points with m: the Morton code of their cell at a depth, cells beyond the box clamped to it."""
    n = 1 << depth
    cells = [sc.clamp(F.floor((F.col(c) - lo) * n / side), 0, n - 1) for c, lo in zip("xyz", low, strict=True)]
    return points.withColumn("m", g.morton(*cells, depth))


def leaves(points: DataFrame, depth: int, most: int) -> DataFrame:
    """depth, code, n of the nodes that hold at most so many points (m), or lie at the greatest depth."""
    out, left = None, points.select("m")
    for d in range(depth + 1):
        code = F.shiftright("m", 3 * (depth - d))
        n = left.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
        full = n if d == depth else n.filter(F.col("n") <= most)
        leaf = full.select(F.lit(d).alias("depth"), "code", "n")
        out = leaf if out is None else out.union(leaf)
        left = left.withColumn("code", code).join(full.select("code"), "code", "left_anti").select("m")
    return out


def replicated(boxes: DataFrame, ident: str, low: tuple, side: float, depth: int) -> DataFrame:
    """id, m: every cell of a depth that a box (lox .. hiz) meets; a triangle lies in several leaves."""
    n = 1 << depth
    for c, lo in zip("xyz", low, strict=True):
        ends = [sc.clamp(F.floor((F.col(e + c) - lo) * n / side), 0, n - 1) for e in ("lo", "hi")]
        boxes = boxes.withColumn("g" + c, F.explode(F.sequence(*ends)))
    return boxes.select(ident, g.morton(F.col("gx"), F.col("gy"), F.col("gz"), depth).alias("m"))


def occupancy(leaf: DataFrame) -> DataFrame:
    """One row: leaves, least, greatest and mean number of members, greatest depth."""
    return leaf.agg(F.count("*").alias("leaves"), F.min("n").alias("least"), F.max("n").alias("most"), (F.sum("n") / F.count("*")).alias("mean"), F.max("depth").alias("depth"))


def solidity(leaf: DataFrame) -> DataFrame:
    """depth, code, solidity: members over the greatest number of members."""
    top = leaf.agg(F.max("n").alias("top"))
    return leaf.crossJoin(F.broadcast(top)).select("depth", "code", (F.col("n") / F.col("top")).alias("solidity"))  # top: one row


def frames(points: DataFrame, least: int = 4) -> DataFrame:
    """m, n, ox, oy, oz, values, axes: mean and principal frame of the points of each leaf (m) of at least so many.

    values are variances, least first; axes are the unit vectors y, x, z in turn, y of the greatest variance, scaled by
    their variance over the least one, y towards the origin. Six sums a leaf are all that is shuffled.
    """
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    sums = points.groupBy("m").agg(F.count("*").alias("n"), *[F.avg(c).alias("o" + c) for c in "xyz"], *[F.covar_pop(p, q).alias("c" + p + q) for p, q in pairs])
    full = [F.col("c" + "".join(sorted(p + q))) for p in "xyz" for q in "xyz"]
    e = sums.filter(F.col("n") >= least).withColumn("e", symmetric_eigen(F.array(*full)))
    low = F.col("e.values")[0]
    column = lambda k: [F.col("e.vectors")[3 * i + k] for i in range(3)]
    y = [F.col("e.values")[2] / low * c for c in column(2)]
    away = sum((c * F.col("o" + k) for c, k in zip(y, "xyz", strict=True)), F.lit(0.0)) > 0
    axes = F.array(*[F.when(away, -c).otherwise(c) for c in y], *[F.col("e.values")[1] / low * c for c in column(1)], *column(0))
    return e.select("m", "n", "ox", "oy", "oz", F.col("e.values").alias("values"), F.when(low > 0, axes).alias("axes"))


def neighbours(nodes: DataFrame, depth: int) -> DataFrame:
    """code, axis, side, nbr: the node of the same depth across each face, where it exists."""
    n = 1 << depth
    xyz = [g.unmorton(F.col("code"), a, depth) for a in range(3)]
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"), (xyz[a] + s).alias("at"), g.morton(*[xyz[k] + (s if k == a else 0) for k in range(3)], depth).alias("nbr")) for a in range(3) for s in (-1, 1)])
    each = nodes.select("code", F.explode(F.filter(steps, lambda x: (x["at"] >= 0) & (x["at"] < n))).alias("e")).select("code", "e.axis", "e.side", "e.nbr")
    return each.join(nodes.select(F.col("code").alias("nbr")), "nbr", "left_semi").select("code", "axis", "side", "nbr")


def pick(tris: DataFrame, origin: tuple, direction: tuple) -> DataFrame:
    """f, t: the first triangle (ax .. cz) a ray hits."""
    o, d = (tuple(F.lit(float(x)) for x in v) for v in (origin, direction))
    hit = tris.select("f", g.ray_triangle(o, d, *[g.vec(p) for p in "abc"]).alias("t")).filter("t is not null")
    return hit.agg(F.min(F.struct("t", "f")).alias("b")).filter("b is not null").select("b.f", "b.t")


def visible_first(leaf: DataFrame, start: int, depth: int, budget: int) -> DataFrame:
    """code, layer, seen: leaves of one depth in layers of neighbours from a start, the least solid of a layer first, until
    their members reach the budget."""
    from meshspark.operators.graph import hops
    from meshspark.operators.order import running

    edges = neighbours(leaf, depth).select(F.col("code").alias("a"), F.col("nbr").alias("b"))
    seed = leaf.filter(F.col("code") == start).select(F.col("code").alias("v"))
    layers = hops(edges, seed, 3 << depth)
    order = layers.join(leaf.select(F.col("code").alias("v"), "n"), "v")
    return running(order, ["hop", "n", "v"], {"seen": "n"}).filter(F.col("seen") - F.col("n") < budget).select(F.col("v").alias("code"), F.col("hop").alias("layer"), "seen")
