"""Queries over sweeps and fronts: tentative points, finalization, crease curves, leaf frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.functions import geometry as g
from meshspark.operators import mesh, octree, volume
from meshspark.plans.mesh_queries import NORMALS
from meshspark.plans.registry import query, r6, s6

# ---------------------------------------------------------------- G22

# Steps and normals of an edge's ends, by their ids.
_ENDS = "e AS (SELECT f, i, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, p.x AS px, p.y AS py, p.z AS pz, 0.4 + a % 7 / 5e0 AS s, 0.4 + b % 5 / 5e0 AS t, (a % 3 + b % 4 - 2) / 10e0 AS nx, 2e0 AS nz FROM edges JOIN surf_v p ON p.v = a JOIN surf_v q ON q.v = b)"
# The apex by its distance from both ends and from the plane: solved in the frame of the edge.
_FRAME = "l AS (SELECT *, ux * ux + uy * uy + uz * uz AS d2, sqrt(ux * ux + uy * uy + uz * uz) AS d FROM e), c AS (SELECT *, 0e0 * uz - nz * uy AS cx, nz * ux - nx * uz AS cy, nx * uy - 0e0 * ux AS cz, (d2 + s * s - t * t) / (2 * d2) AS k FROM l), k AS (SELECT *, CASE WHEN d > s + t OR s > d + t OR t > d + s THEN NULL ELSE sqrt(greatest(s * s - greatest(0e0, least(1e0, k)) ** 2 * d2, 0e0) / (cx * cx + cy * cy + cz * cz)) END AS h, CASE WHEN s * s < greatest(0e0, least(1e0, k)) ** 2 * d2 THEN NULL ELSE greatest(0e0, least(1e0, k)) END AS w FROM c)"


@query(f"WITH {_ENDS}, {_FRAME} SELECT f, i, {s6('px + w * ux + h * cx', 'x')}, {s6('py + w * uy + h * cy', 'y')}, {s6('pz + w * uz + h * cz', 'z')}, {s6('CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN nz / sqrt(nx * nx + nz * nz) END', 'nz')} FROM k", "edges", "surf_v")
def tentative_points(spark, sf):
    """Apexes over edges from two step lengths"""
    v = fx.surf_v(spark, sf)
    e = mesh.halfedges(fx.surf_f(spark, sf))
    for end, p in (("a", "p"), ("b", "q")):
        e = e.join(v.select(F.col("v").alias(end), *[F.col(c).alias(p + c) for c in "xyz"]), end)
    one, two = F.lit(0.4) + F.col("a") % 7 / 5.0, F.lit(0.4) + F.col("b") % 5 / 5.0
    n = ((F.col("a") % 3 - 1) / 10.0, F.lit(0.0), F.lit(1.0))
    m = ((F.col("b") % 4 - 1) / 10.0, F.lit(0.0), F.lit(1.0))
    at, up = g.apex(g.vec("p"), n, one, g.vec("q"), m, two)
    return e.select("f", "i", *[r6(c, k) for c, k in zip(at, "xyz", strict=True)], r6(up[2], "nz"))


# ---------------------------------------------------------------- T11, X3


@query(
    "WITH u AS (SELECT f, least(a, b) AS p, greatest(a, b) AS q, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY f) AS k FROM edges), every AS (SELECT DISTINCT a AS v FROM edges), s AS (SELECT v, f.f AS f, (SELECT count(*) FILTER (k % 2 = 1) - count(*) FILTER (k % 2 = 0) FROM u WHERE (u.p = v OR u.q = v) AND u.f <= f.f) AS live, (SELECT count(*) FROM u WHERE (u.p = v OR u.q = v) AND u.f <= f.f) AS n FROM every, surf_f f) SELECT v, CAST(min(f) FILTER (live = 0 AND n > 0) AS INT) AS done, max(live) AS peak FROM s GROUP BY v",
    "edges", "surf_f",
)
def finalized_vertices(spark, sf):
    """When a vertex has no edge on the front any more"""
    return mesh.finalized(fx.surf_f(spark, sf)).select(F.col("v").cast("int").alias("v"), F.col("done").cast("int").alias("done"), "peak")


def _code(x: str, y: str, z: str) -> str:
    return " + ".join(f"(({c}) >> {k} & 1) * {1 << (3 * k + axis)}" for k in range(4) for axis, c in enumerate((x, y, z)))


_CROSS = " UNION ALL ".join(
    f"SELECT v.x AS x, v.y AS y, v.z AS z, {axis} AS axis FROM vox v JOIN vox w ON {' AND '.join(f'w.{k} = v.{k}' + (' + 1' if k == c else '') for k in 'xyz')} WHERE (v.value < {fx.ISO}) <> (w.value < {fx.ISO})"
    for axis, c in enumerate("xyz")
)


@query(
    f"WITH c AS ({_CROSS}), cell AS (SELECT CAST(i AS BIGINT) % 7 AS cx, CAST(i AS BIGINT) // 7 % 7 AS cy, CAST(i AS BIGINT) // 49 AS cz FROM range(343) r(i)), m AS (SELECT c.*, {_code('cx', 'cy', 'cz')} AS code FROM c JOIN cell ON x - cx BETWEEN 0 AND CASE axis WHEN 0 THEN 0 ELSE 1 END AND y - cy BETWEEN 0 AND CASE axis WHEN 1 THEN 0 ELSE 1 END AND z - cz BETWEEN 0 AND CASE axis WHEN 2 THEN 0 ELSE 1 END) SELECT x, y, z, axis, min(code) AS first, max(code) AS last FROM m GROUP BY x, y, z, axis",
    "vox",
)
def cube_sweep(spark, sf):
    """The cells, in Morton order, that make and finalize the vertices of the cubes"""
    crossed = volume.crossings(fx.vox(spark, sf), fx.ISO).select("x", "y", "z", "axis")
    return volume.sweep(crossed, (fx.SIDE,) * 3)


# ---------------------------------------------------------------- X17


@query(
    f"WITH RECURSIVE n AS ({NORMALS}), e AS (SELECT e.a * 100 + e.b AS id, e.a, e.b FROM edges e JOIN edges o ON o.a = e.b AND o.b = e.a JOIN n x ON x.f = e.f JOIN n y ON y.f = o.f WHERE e.a < e.b AND x.nx * y.nx + x.ny * y.ny + x.nz * y.nz < 0.97), plain AS (SELECT v FROM (SELECT unnest([a, b]) AS v FROM e) GROUP BY v HAVING count(*) <= 2), l AS (SELECT s.id AS s, t.id AS t FROM e s JOIN e t ON s.id <> t.id JOIN plain ON (v = s.a OR v = s.b) AND (v = t.a OR v = t.b)), reach(id, at) AS (SELECT id, id FROM e UNION SELECT reach.id, l.t FROM reach JOIN l ON l.s = reach.at), c AS (SELECT id, min(at) AS curve, count(*) AS n FROM reach GROUP BY id) SELECT CAST(curve // 100 AS INT) AS curve_a, CAST(curve % 100 AS INT) AS curve_b, CAST(a AS INT) AS a, CAST(b AS INT) AS b, n FROM c JOIN e USING (id) WHERE n >= 2",
    "surf_t", "edges",
)
def crease_curves(spark, sf):
    """Creases as curves between kinks, small ones left out"""
    found = mesh.crease_curves(mesh.creases(fx.surf_t(spark, sf), 0.97), 2)
    return found.select(*[F.col(c).cast("int").alias(c) for c in ("curve_a", "curve_b", "a", "b")], "n")


# ---------------------------------------------------------------- A24

_SUMS = "s AS (SELECT CAST((x >= 0)::INT + 2 * (y >= 0)::INT + 4 * (z >= 0)::INT AS BIGINT) AS m, count(*) AS n, avg(x) AS ox, var_pop(x) AS a, var_pop(y) AS d, var_pop(z) AS f, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, z) AS e FROM pts GROUP BY 1 HAVING count(*) >= 4)"
_ROOTS = "q AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) AS p FROM s), h AS (SELECT *, acos(greatest(-1e0, least(1e0, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * p * p * p)))) / 3 AS t FROM q), w AS (SELECT m, n, ox, q + 2 * p * cos(t) AS high, q + 2 * p * cos(t + 2 * pi() / 3) AS low FROM h)"


@query(f"WITH {_SUMS}, {_ROOTS} SELECT m, n, {s6('ox', 'ox')}, {s6('low', 'low')}, {s6('high', 'high')}, round(high / low, 4) + 0e0 AS stretch FROM w", "pts")
def leaf_frames(spark, sf):
    """Variances along the principal axes of octree leaves, and how far the frame stretches"""
    f = octree.frames(octree.coded(fx.pts(spark, sf), (-8.0,) * 3, 16.0, 1))
    y = tuple(F.col("axes")[i] for i in range(3))
    return f.select("m", "n", r6("ox", "ox"), r6(F.col("values")[0], "low"), r6(F.col("values")[2], "high"), (F.round(g.norm(y), 4) + 0.0).alias("stretch"))
