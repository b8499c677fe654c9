"""Surfaces in volumes and meshes: spline derivatives and curvature, mesh curvature, tetrahedral regression, booleans, seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshspark.functions import geometry as g
from meshspark.operators import graph, mesh, spatial, volume


def weight_derivatives(t: float, order: int) -> list[float]:
    """Weights of the four neighbours for the first or second derivative of the cubic through them."""
    if order == 0:
        return volume.spline_weights(t)
    if order == 1:
        return [(-3 * t**2 + 4 * t - 1) / 2, (9 * t**2 - 10 * t) / 2, (-9 * t**2 + 8 * t + 1) / 2, (3 * t**2 - 2 * t) / 2]
    return [-3 * t + 2, 9 * t - 5, -9 * t + 4, 3 * t - 1]


def spline_field(vox: DataFrame, dims, t: tuple[float, float, float]) -> DataFrame:
    """x, y, z, value, gx .. gz, hxx .. hzz at one inner place of each cell: one gather, ten weighted sums."""
    inner = vox.filter(" and ".join(f"{c} < {n - 1}" for c, n in zip("xyz", dims, strict=True)))
    near = volume.gather(vox, -1, 2, dims, inner)
    orders = {"value": (0, 0, 0), "gx": (1, 0, 0), "gy": (0, 1, 0), "gz": (0, 0, 1), "hxx": (2, 0, 0), "hxy": (1, 1, 0), "hxz": (1, 0, 1), "hyy": (0, 2, 0), "hyz": (0, 1, 1), "hzz": (0, 0, 2)}
    sums = []
    for name, order in orders.items():
        w = F.lit(1.0)
        for c, at, o in zip("xyz", t, order, strict=True):
            w = w * F.element_at(F.array(*map(F.lit, weight_derivatives(at, o))), F.col("d" + c) + 2)
        sums.append(F.sum(F.round(w * F.col("value"), 10)).alias(name))
    return near.groupBy("x", "y", "z").agg(*sums)


def iso_curvature(fields: DataFrame) -> DataFrame:
    """fields with mean and gauss: curvatures of the level surface through each place, null where the gradient vanishes."""
    gr = [F.col("g" + c) for c in "xyz"]
    h = {a + b: F.col("h" + min(a, b) + max(a, b)) for a in "xyz" for b in "xyz"}
    n2 = sum((x * x for x in gr), F.lit(0.0))
    ghg = sum((gr[i] * h[a + b] * gr[j] for i, a in enumerate("xyz") for j, b in enumerate("xyz")), F.lit(0.0))
    trace = h["xx"] + h["yy"] + h["zz"]
    adj = {}
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            r, c = [x for x in "xyz" if x != a], [x for x in "xyz" if x != b]
            adj[a + b] = (h[r[0] + c[0]] * h[r[1] + c[1]] - h[r[0] + c[1]] * h[r[1] + c[0]]) * (-1) ** (i + j)
    gag = sum((gr[i] * adj[a + b] * gr[j] for i, a in enumerate("xyz") for j, b in enumerate("xyz")), F.lit(0.0))
    return fields.withColumns({"mean": F.when(n2 > 0, (n2 * trace - ghg) / (2 * n2 * F.sqrt(n2))), "gauss": F.when(n2 > 0, gag / (n2 * n2))})


def mesh_curvature(tris: DataFrame, rings: int = 3) -> DataFrame:
    """v, k1, k2: principal curvatures from a quadric over the vertices within so many edges, k1 the smaller in magnitude."""
    points = mesh.incidence_points(tris)
    edges = mesh.one_ring(tris)
    reach = points.select("v", F.col("v").alias("w"))
    for _ in range(rings):
        reach = reach.union(reach.join(edges.select(F.col("v").alias("w"), "nbr"), "w").select("v", F.col("nbr").alias("w"))).distinct()
    n = mesh.vertex_normals(tris)
    rows = reach.join(points.select(F.col("v").alias("w"), *[F.col(c).alias("p" + c) for c in "xyz"]), "w").join(points, "v").join(n, "v")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        o, n = (first[[p + c for c in "xyz"]].to_numpy(float) for p in ("", "n"))
        if len(group) < 6:
            return pd.DataFrame({"v": [first["v"]], "k1": [np.nan], "k2": [np.nan]})
        d = group[["px", "py", "pz"]].to_numpy(float) - o
        for _ in range(10):  # turn the normal until the fit is flat at the vertex
            u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
            u /= np.linalg.norm(u)
            w = np.cross(n, u)
            a, b, h = d @ u, d @ w, d @ n
            c = np.linalg.lstsq(np.stack([a, b, a * a / 2, a * b, b * b / 2], 1), h, rcond=None)[0]
            if np.hypot(c[0], c[1]) < 1e-9:
                break
            n = n - c[0] * u - c[1] * w
            n /= np.linalg.norm(n)
        k = sorted(np.linalg.eigvalsh([[c[2], c[3]], [c[3], c[4]]]), key=abs)
        return pd.DataFrame({"v": [first["v"]], "k1": [k[0]], "k2": [k[1]]})

    return rows.groupBy("v").applyInPandas(fit, f"v {tris.schema['v0'].dataType.simpleString()}, k1 double, k2 double")


def scalar_regression(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """q, value, gx, gy, gz: a weighted quadratic in three variables through the scalars (s) of points around each query.

    Ten neighbours at least.
    """
    near = spatial.within(queries, points, radius).join(points.select("id", "s", *[F.col(c).alias("p" + c) for c in "xyz"]), "id").join(queries.select("q", "x", "y", "z"), "q")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < 10:
            return pd.DataFrame({c: [] for c in ("q", "value", "gx", "gy", "gz")})
        d = group[["px", "py", "pz"]].to_numpy(float) - group[["x", "y", "z"]].to_numpy(float)
        s2 = group["d2"].to_numpy(float) / radius**2
        w = np.maximum(0, 1 - s2) + 1e-9
        x, y, z = d.T
        m = np.stack([np.ones(len(d)), x, y, z, x * x, x * y, x * z, y * y, y * z, z * z], 1)
        c = np.linalg.lstsq(m * w[:, None], group["s"].to_numpy(float) * w, rcond=None)[0]
        return pd.DataFrame({"q": [group["q"].iloc[0]], "value": [c[0]], "gx": [c[1]], "gy": [c[2]], "gz": [c[3]]})

    return near.groupBy("q").applyInPandas(solve, f"q {queries.schema['q'].dataType.simpleString()}, value double, gx double, gy double, gz double")


def inside(points: DataFrame, tris: DataFrame, side: float) -> DataFrame:
    """id, inside: whether points lie in a closed mesh, by the parity of faces above them.

    Faces are dealt to the columns of cells that they cover, points to their own. A point's line is moved by a little along x and
    y so that it meets no edge.
    """
    ex, ey = 1e-7, 1.7e-7
    flat = tris
    for c in "xy":
        flat = flat.withColumns({"lo" + c: F.least(*[p + c for p in "abc"]), "hi" + c: F.greatest(*[p + c for p in "abc"])})
    for n, lo, hi in (("gx", "lox", "hix"), ("gy", "loy", "hiy")):
        flat = flat.withColumn(n, F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))))
    p = points.select("id", (F.col("x") + ex).alias("x"), (F.col("y") + ey).alias("y"), "z")
    p = p.withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    hit = p.join(flat, ["gx", "gy"]).filter(g.ray_triangle(g.vec(), up, *[g.vec(c) for c in "abc"]).isNotNull())
    odd = hit.groupBy("id").agg((F.count("*") % 2 == 1).alias("inside"))
    return points.select("id").join(odd, "id", "left").select("id", F.coalesce("inside", F.lit(False)).alias("inside"))


def boolean_faces(one: DataFrame, two: DataFrame, operation: str, side: float) -> DataFrame:
    """m, f, flipped: the faces of two closed meshes (f, ax .. cz) that a union, intersection or difference keeps whole.

    A face counts by its centre; faces whose boxes meet the other mesh are marked by `near`, to be cut.
    """
    out = None
    for m, own, other in ((0, one, two), (1, two, one)):
        centre = own.select(F.col("f").alias("id"), *[((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3).alias(c) for c in "xyz"])
        where = inside(centre, other, side)
        keep = {"union": "not inside", "intersection": "inside", "difference": "not inside" if m == 0 else "inside"}[operation]
        boxes = [t.select(F.col("f").alias(n), *[x for c in "xyz" for x in (F.least(*[p + c for p in "abc"]).alias("lo" + c), F.greatest(*[p + c for p in "abc"]).alias("hi" + c))]) for t, n in ((own, "l"), (other, "r"))]
        near = spatial.overlaps(boxes[0], boxes[1], side).select(F.col("l").alias("id")).distinct().withColumn("near", F.lit(True))
        rows = where.filter(keep).join(near, "id", "left").select(F.lit(m).alias("m"), F.col("id").alias("f"), F.lit(operation == "difference" and m == 1).alias("flipped"), F.coalesce("near", F.lit(False)).alias("near"))
        out = rows if out is None else out.unionByName(rows)
    return out


def seeds(tris: DataFrame, per_component: int = 10) -> DataFrame:
    """root, place, e0: evenly spaced faces of each component of a welded iso-surface (e0, e1, e2)."""
    label = graph.components(tris.select(F.col("e0").alias("a"), F.col("e1").alias("b")).union(tris.select("e1", "e2")))
    t = tris.join(label, F.col("e0") == F.col("v")).select("root", "e0", "e1", "e2")
    w = Window.partitionBy("root").orderBy("e0", "e1", "e2")
    n = t.groupBy("root").agg(F.count("*").alias("n"))
    r = t.withColumn("r", F.row_number().over(w) - 1).join(n, "root")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / per_component))
    return r.filter((F.col("r") % step == 0) & (F.floor(F.col("r") / step) < per_component)).select("root", F.floor(F.col("r") / step).alias("place"), "e0")


def merged_nearest(streams: DataFrame, k: int) -> DataFrame:
    """q, rank, id, d2 from candidates (q, id, d2) of many blocks: the best k of each block, then the best k of those."""
    first = Window.partitionBy("q", "block").orderBy("d2", "id")
    last = Window.partitionBy("q").orderBy("d2", "id")
    local = streams.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    return local.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("q", "rank", "id", "d2")


def icosahedron_directions() -> list[tuple[float, float, float]]:
    """The twelve corners of a regular icosahedron."""
    a, b = 1 / np.sqrt(1 + ((1 + 5**0.5) / 2) ** 2), 0.0
    b = a * (1 + 5**0.5) / 2
    return [tuple(float(x) for x in np.roll((0.0, s * a, t * b), k)) for k in range(3) for s in (-1, 1) for t in (-1, 1)]


def directional(queries: DataFrame, samples: DataFrame) -> DataFrame:
    """q, value: samples (d, x, y, z, s) of a function of direction blended for each direction (q, x, y, z).

    The three samples of greatest dot product, weighted by it. Samples are the corners of a fixed solid: a few rows.
    """
    s = samples.select("d", "s", *[F.col(c).alias("s" + c) for c in "xyz"])
    dots = queries.crossJoin(F.broadcast(s)).withColumn("dot", g.dot(g.vec(), g.vec("s")))
    top = dots.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot"), "d"))).filter("r <= 3")
    return top.groupBy("q").agg((F.sum(F.round(F.col("dot") * F.col("s"), 10)) / F.sum(F.round("dot", 10))).alias("value"))
