"""Regular volumes as one row a voxel: stencils, zone maps, filters, materials, spline evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshspark.functions import geometry as g


def offsets(low: int, high: int) -> F.Column:
    """All steps (dx, dy, dz) from low to high as an array of structs."""
    r = range(low, high + 1)
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz")) for k in r for j in r for i in r])


def gather(vox: DataFrame, low: int, high: int, dims: tuple[int, int, int], at: DataFrame | None = None) -> DataFrame:
    """x, y, z, dx, dy, dz, value of the neighbours of each cell, beyond the border those on it.

    at: the cells (x, y, z); those of the volume by default.
    """
    cells = (at if at is not None else vox).select("x", "y", "z", F.explode(offsets(low, high)).alias("o"))
    for c, n in zip("xyz", dims, strict=True):
        cells = cells.withColumn("n" + c, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + F.col("o.d" + c))))
    side = vox.select(*[F.col(c).alias("n" + c) for c in "xyz"], "value")
    return cells.join(side, ["nx", "ny", "nz"]).select("x", "y", "z", "o.dx", "o.dy", "o.dz", "value")


def box_filter(vox: DataFrame, width: int, dims) -> DataFrame:
    """x, y, z, value: means over the (2 width + 1)**3 cells around each, border cells repeated."""
    near = gather(vox, -width, width, dims)
    return near.groupBy("x", "y", "z").agg((F.sum(F.round("value", 9)) / F.count("*")).alias("value"))


def cell_corners(vox: DataFrame) -> DataFrame:
    """x, y, z of cells with all eight corners, with their values c0 .. c7 (bit 0: x, bit 1: y, bit 2: z) and range."""
    o = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k & 1).alias("dx"), F.lit(k >> 1 & 1).alias("dy"), F.lit(k >> 2).alias("dz")) for k in range(8)])
    each = vox.select("x", "y", "z", "value", F.explode(o).alias("o")).select(*[(F.col(c) - F.col("o.d" + c)).alias(c) for c in "xyz"], F.col("o.k").alias("k"), "value")
    g = each.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), *[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"c{k}") for k in range(8)])
    return g.filter("n = 8").drop("n")


def spanning(vox: DataFrame, iso: float) -> DataFrame:
    """Cells whose corners lie on both sides of the value."""
    return cell_corners(vox).filter((F.col("low") < iso) & (F.col("high") >= iso))


def zone_map(vox: DataFrame, size: int) -> DataFrame:
    """bx, by, bz, low, high of each block."""
    b = [F.floor(F.col(c) / size).cast("int").alias("b" + c) for c in "xyz"]
    return vox.groupBy(*b).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def crossings(vox: DataFrame, iso: float) -> DataFrame:
    """x, y, z, axis, px, py, pz: grid edges that cross the value, with the linear crossing."""
    out = None
    for axis, c in enumerate("xyz"):
        other = vox.select(*[(F.col(k) - 1 if k == c else F.col(k)).alias(k) for k in "xyz"], F.col("value").alias("other"))
        e = vox.select("x", "y", "z", "value").join(other, ["x", "y", "z"]).filter((F.col("value") < iso) != (F.col("other") < iso))
        t = (iso - F.col("value")) / (F.col("other") - F.col("value"))
        e = e.select("x", "y", "z", F.lit(axis).alias("axis"), *[(F.col(k) + t if k == c else F.col(k).cast("double")).alias("p" + k) for k in "xyz"])
        out = e if out is None else out.unionByName(e)
    return out


def sweep(crossed: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """crossed edges (x, y, z, axis) with first and last: Morton codes of the first and last cell, in that order, at each.

    Visited in Morton order, cells may make an edge's vertex at its first cell and finalize it at its last. Codes grow with
    every coordinate, so these are the cells of least and greatest coordinates across the axis.
    """
    at = {k: F.col(c) for k, c in enumerate("xyz")}
    low = [F.when(F.col("axis") == k, at[k]).otherwise(F.greatest(at[k] - 1, F.lit(0))) for k in range(3)]
    high = [F.when(F.col("axis") == k, at[k]).otherwise(F.least(at[k], F.lit(dims[k] - 2))) for k in range(3)]
    bits = max(dims).bit_length()
    return crossed.withColumns({"first": g.morton(*low, bits), "last": g.morton(*high, bits)})


def spline_weights(t: float, kind: str = "catmull") -> list[float]:
    """Weights of the four neighbours at -1, 0, 1, 2 for a place t between 0 and 1."""
    if kind == "catmull":
        return [(-t**3 + 2 * t**2 - t) / 2, (3 * t**3 - 5 * t**2 + 2) / 2, (-3 * t**3 + 4 * t**2 + t) / 2, (t**3 - t**2) / 2]
    return [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]


def spline_values(vox: DataFrame, dims, t: tuple[float, float, float], kind: str = "catmull") -> DataFrame:
    """x, y, z, value: the tri-cubic value in each cell at one inner place."""
    inner = vox.filter(" and ".join(f"{c} < {n - 1}" for c, n in zip("xyz", dims, strict=True)))
    near = gather(vox, -1, 2, dims, inner)
    w = F.lit(1.0)
    for c, at in zip("xyz", t, strict=True):
        w = w * F.element_at(F.array(*map(F.lit, spline_weights(at, kind))), F.col("d" + c) + 2)
    return near.groupBy("x", "y", "z").agg(F.sum(F.round(w * F.col("value"), 10)).alias("value"))


def indicators(segm: DataFrame, materials: int) -> DataFrame:
    """x, y, z, mat, value: 1 where the cell is of the material, else 0."""
    mats = F.explode(F.array(*map(F.lit, range(materials))))
    return segm.select("x", "y", "z", F.col("mat").alias("own"), mats.alias("mat")).select("x", "y", "z", "mat", (F.col("own") == F.col("mat")).cast("double").alias("value"))


def material_fields(segm: DataFrame, materials: int, dims, width: int = 1) -> DataFrame:
    """x, y, z, mat, p: indicators after a box filter."""
    one = indicators(segm, materials)
    cells = one.select("x", "y", "z", "mat", F.explode(offsets(-width, width)).alias("o"))
    for c, n in zip("xyz", dims, strict=True):
        cells = cells.withColumn("n" + c, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + F.col("o.d" + c))))
    side = segm.select(*[F.col(c).alias("n" + c) for c in "xyz"], F.col("mat").alias("own"))
    near = cells.join(side, ["nx", "ny", "nz"])
    return near.groupBy("x", "y", "z", "mat").agg((F.sum((F.col("own") == F.col("mat")).cast("int")) / F.count("*")).alias("p"))


def dominant(fields: DataFrame) -> DataFrame:
    """x, y, z, mat: the material of greatest p, of equal ones the lowest."""
    best = F.max(F.struct(F.col("p"), (-F.col("mat")).alias("m")))
    return fields.groupBy("x", "y", "z").agg(best.alias("b")).select("x", "y", "z", (-F.col("b.m")).alias("mat"))


def against_others(fields: DataFrame) -> DataFrame:
    """x, y, z, mat, value: each material's p minus the greatest of the others."""
    w = Window.partitionBy("x", "y", "z").orderBy(F.desc("p"), "mat")
    r = fields.withColumn("r", F.row_number().over(w))
    top = r.groupBy("x", "y", "z").agg(F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p1"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("p2"))
    return r.join(top, ["x", "y", "z"]).select("x", "y", "z", "mat", (F.col("p") - F.when(F.col("r") == 1, F.col("p2")).otherwise(F.col("p1"))).alias("value"))


def export(vox: DataFrame, path: str, low, high, step: int, block: int) -> None:
    """Crop to [low, high), keep every step-th cell, write one folder a block."""
    kept = vox
    for c, a, b in zip("xyz", low, high, strict=True):
        kept = kept.filter((F.col(c) >= a) & (F.col(c) < b) & ((F.col(c) - a) % step == 0)).withColumn(c, ((F.col(c) - a) / step).cast("int"))
    blocks = [F.floor(F.col(c) / block).cast("int").alias("b" + c) for c in "xyz"]
    kept.select("*", *blocks).write.partitionBy("bx", "by", "bz").parquet(path)
