"""Queries over octrees, curves, flips and nearest triangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.functions import geometry as g
from meshspark.operators import curves, front, iso, mesh, octree, surface, volume
from meshspark.plans.mesh_queries import AREA, _cross, _len
from meshspark.plans.registry import query, r6, s6
from meshspark.plans.space_queries import _NEAR

LOW, SIDE = (-2.0, -2.0, -2.0), 4.0
_CELL = ", ".join(f"CAST(greatest(0, least(7, floor(({c} + 2) * 8 / 4))) AS BIGINT) AS {c}" for c in "xyz")
_MORTON = " + ".join(f"((({c} >> {k}) & 1) << {3 * k + a})" for k in range(3) for a, c in enumerate("xyz"))
CELLS = f"k AS (SELECT CAST({_MORTON} AS BIGINT) AS code, count(*) AS n FROM (SELECT {_CELL} FROM pts) GROUP BY 1)"


def _cells(spark, sf):
    return octree.coded(fx.pts(spark, sf), LOW, SIDE, 3).groupBy(F.col("m").alias("code")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT count(*) AS leaves, min(n) AS least, max(n) AS most, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean, 3 AS depth FROM k", "pts")
def octree_occupancy(spark, sf):
    """Members of leaves"""
    o = octree.occupancy(_cells(spark, sf).withColumn("depth", F.lit(3)))
    return o.select("leaves", "least", "most", F.round("mean", 6).alias("mean"), "depth")


@query(f"WITH {CELLS} SELECT code, round(CAST(n AS DOUBLE) / (SELECT max(n) FROM k), 6) AS solidity FROM k", "pts")
def octree_solidity(spark, sf):
    """Members over the greatest number"""
    return octree.solidity(_cells(spark, sf).withColumn("depth", F.lit(3))).select("code", F.round("solidity", 6).alias("solidity"))


_UN = {c: " + ".join(f"(((code >> {3 * k + a}) & 1) << {k})" for k in range(3)) for a, c in enumerate("xyz")}


@query(f"WITH {CELLS}, u AS (SELECT code, {', '.join(f'{_UN[c]} AS {c}' for c in 'xyz')} FROM k) SELECT p.code, CAST(CASE WHEN p.x <> q.x THEN 0 WHEN p.y <> q.y THEN 1 ELSE 2 END AS INT) AS axis, CAST(q.x - p.x + q.y - p.y + q.z - p.z AS INT) AS side, q.code AS nbr FROM u p JOIN u q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1", "pts")
def octree_neighbours(spark, sf):
    """Leaves across each face"""
    return octree.neighbours(_cells(spark, sf), 3)


@query()
def visibility_front(spark, sf):
    """Leaves in layers from the middle until a budget of members"""
    return octree.visible_first(_cells(spark, sf), 448, 3, 300)


_TURNS = [f"(({q}x - {p}x) * (2.4::DOUBLE - {p}y) - ({q}y - {p}y) * (3.25::DOUBLE - {p}x))" for p, q in ("ab", "bc", "ca")]


@query(f"SELECT arg_max(f, az + bz + cz) AS f FROM surf_t WHERE {' AND '.join(f'{t} >= 0' for t in _TURNS)} OR {' AND '.join(f'{t} <= 0' for t in _TURNS)}", "surf_t")
def ray_pick(spark, sf):
    """The triangle under a point"""
    return octree.pick(fx.surf_t(spark, sf), (3.25, 2.4, 100.0), (0.0, 0.0, -1.0)).select("f")


@query(f"SELECT v, {', '.join(s6(f'sum(round(s{c}, 9))', 's' + c) for c in 'xyz')} FROM (" + " UNION ALL ".join(f"SELECT v{k} AS v, {', '.join(f'{x} AS s{c}' for c, x in zip('xyz', _cross(*p), strict=True))} FROM surf_t" for k, p in enumerate(("abc", "bca", "cab"))) + ") GROUP BY v", "surf_t")
def second_derivatives(spark, sf):
    """A22, T5 in batch: sums of cross products at vertices"""
    return mesh.second_derivatives(fx.surf_t(spark, sf)).select("v", *[r6("s" + c, "s" + c) for c in "xyz"])


@query(f"SELECT f, CAST(4 ** greatest(0, ceil(round(ln({AREA} / 0.1) / ln(4), 9))) AS BIGINT) AS n FROM surf_t", "surf_t")
def triangles_to_area(spark, sf):
    """Parts of triangles cut to an area"""
    return mesh.subdivide_to_area(fx.surf_t(spark, sf), 0.1).select("f", "n")


def _cosines(a, b, c):
    out = []
    for x, y, z in ((a, b, c), (b, c, a), (c, a, b)):
        d = " + ".join(f"({y}{k} - {x}{k}) * ({z}{k} - {x}{k})" for k in "xyz")
        out.append(f"(({d}) / ({_len(x, y)} * {_len(x, z)}))")
    return ", ".join(out)


def _ar(a, b, c):
    return f"(sqrt({' + '.join(f'{x} * {x}' for x in _cross(a, b, c))}) / 2)"


_QUAD = (
    "q AS (SELECT e.a AS p, e.b AS q, r.v AS r, s.v AS s, e.f AS f, o.f AS g, " + ", ".join(f"{n}v.{c} AS {n}{c}" for n in "pqrs" for c in "xyz")
    + " FROM edges e JOIN edges o ON o.a = e.b AND o.b = e.a AND e.f < o.f JOIN surf_f ff ON ff.f = e.f JOIN surf_f gg ON gg.f = o.f"
    " JOIN surf_v r ON r.v IN (ff.v0, ff.v1, ff.v2) AND r.v NOT IN (e.a, e.b) JOIN surf_v s ON s.v IN (gg.v0, gg.v1, gg.v2) AND s.v NOT IN (e.a, e.b)"
    " JOIN surf_v pv ON pv.v = e.a JOIN surf_v qv ON qv.v = e.b JOIN surf_v rv ON rv.v = r.v JOIN surf_v sv ON sv.v = s.v)"
)


@query(
    f"WITH {_QUAD}, n AS (SELECT *, greatest({_cosines('p', 'q', 'r')}, {_cosines('q', 'p', 's')}) - greatest({_cosines('r', 's', 'q')}, {_cosines('s', 'r', 'p')}) AS gain, {_ar('r', 's', 'q')} AS a1, {_ar('s', 'r', 'p')} AS a2, {_ar('p', 'q', 'r')} + {_ar('q', 'p', 's')} AS old FROM q) SELECT p, q, r, s, {s6('gain', 'gain')} FROM n WHERE a1 > 0 AND a2 > 0 AND gain > 1e-9 AND a1 + a2 <= 1.1 * old AND NOT EXISTS (SELECT 1 FROM edges z WHERE (z.a = n.r AND z.b = n.s) OR (z.a = n.s AND z.b = n.r))",
    "edges", "surf_v",
)
def flip_candidates(spark, sf):
    """Edges worth flipping"""
    return mesh.flip_candidates(fx.surf_f(spark), fx.surf_v(spark, sf)).select("p", "q", "r", "s", r6("gain", "gain"))


@query()
def flipped_mesh(spark, sf):
    """Faces after rounds of independent flips"""
    return mesh.flip_edges(fx.surf_f(spark), fx.surf_v(spark, sf))


@query("WITH q AS (SELECT *, lag(z) OVER (PARTITION BY y ORDER BY x) AS pz FROM surf_v) SELECT CAST(y AS INT) AS curve, CAST(x AS INT) AS pos, round(sum(round(CASE WHEN pz IS NULL THEN 0 ELSE sqrt(1 + (z - pz) * (z - pz)) END, 12)) OVER (PARTITION BY y ORDER BY x), 6) AS s FROM q", "surf_v")
def arc_lengths(spark, sf):
    """Lengths along the rows of the height field"""
    return curves.arc_lengths(_rows(spark, sf)).select("curve", "pos", F.round("s", 6).alias("s"))


def _rows(spark, sf):
    return fx.surf_v(spark, sf).select(F.col("y").cast("int").alias("curve"), F.col("x").cast("int").alias("pos"), "x", "y", "z")


@query()
def resampled_curves(spark, sf):
    """Rows of the height field in equal steps"""
    return curves.resample(_rows(spark, sf).withColumn("ideal", F.lit(0.5)))


@query()
def curve_curvature(spark, sf):
    """Curvature along the rows of the height field"""
    return curves.curvature(_rows(spark, sf), 2.5)


@query(" UNION ALL ".join(f"SELECT {k} AS axis, count(*) AS crossings FROM vox a JOIN vox b ON b.x = a.x + {int(k == 0)} AND b.y = a.y + {int(k == 1)} AND b.z = a.z + {int(k == 2)} WHERE (a.value < 4.00001) <> (b.value < 4.00001)" for k in range(3)), "vox")
def crossings_along_axes(spark, sf):
    """Crossings of grid edges along each axis"""
    return volume.crossings(fx.vox(spark, sf), fx.ISO).groupBy(F.col("axis").cast("int").alias("axis")).agg(F.count("*").alias("crossings"))


@query()
def marching_cubes_statistics(spark, sf):
    """A5: cells, triangles, area, and each weighted by one over the range of the corners"""
    cells = volume.cell_corners(fx.vox(spark, sf))
    t = iso.marching_cubes(cells, fx.ISO).join(cells.select("x", "y", "z", (F.col("high") - F.col("low")).alias("range")), ["x", "y", "z"])
    a = t.withColumn("area", g.area(*[g.vec(p) for p in "abc"]))
    per = a.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.first("range").alias("range"))
    w = 1 / F.col("range")
    return per.agg(F.count("*").alias("cells"), F.sum("n").alias("tris"), F.sum("area").alias("area"), F.sum(w).alias("w_cells"), F.sum(F.col("n") * w).alias("w_tris"), F.sum(F.col("area") * w).alias("w_area"))


@query("SELECT id, round((x + 2 * y - 2 * z - 0.75::DOUBLE) / 3, 6) + 0e0 AS d, round(sqrt((y - z) ** 2 + (z - x) ** 2 + (x - y) ** 2) / sqrt(3), 6) + 0e0 AS line FROM pts", "pts")
def plane_distance(spark, sf):
    """Signed distance of points to a plane, and distance to the line through 0 and (1, 1, 1)"""
    one = tuple(F.lit(1.0) for _ in "xyz")
    plane = g.plane((1.0, 2.0, -2.0), 0.75)
    return fx.pts(spark, sf).select("id", r6(g.plane_distance(g.vec(), plane), "d"), r6(g.line_distance(g.vec(), tuple(F.lit(0.0) for _ in "xyz"), one), "line"))


def _tri_d2(spark, sf):
    t = fx.surf_t(spark, sf)
    p = fx.pts(spark, sf).select("id", *[(3.5 + 1.5 * F.col(c)).alias(c) for c in "xyz"])
    return t, p


def _sql_seg(p, q):
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({' + '.join(f'({c} - {p}{c}) * ({q}{c} - {p}{c})' for c in 'xyz')}) / ({' + '.join(f'({q}{c} - {p}{c}) * ({q}{c} - {p}{c})' for c in 'xyz')})))"
    return f"({' + '.join(f'({c} - {p}{c} - {t} * ({q}{c} - {p}{c})) ** 2' for c in 'xyz')})"


@query(
    "WITH p AS (SELECT id, 3.5 + 1.5 * x AS x, 3.5 + 1.5 * y AS y, 3.5 + 1.5 * z AS z FROM pts), m AS (SELECT id, f, " + ", ".join(f"{n} AS n{c}" for c, n in zip("xyz", _cross("a", "b", "c"), strict=True)) + f", least({_sql_seg('a', 'b')}, {_sql_seg('b', 'c')}, {_sql_seg('c', 'a')}) AS e2, surf_t.*, x, y, z FROM p, surf_t), d AS (SELECT id, e2, nx * nx + ny * ny + nz * nz AS n2, (x - ax) * nx + (y - ay) * ny + (z - az) * nz AS h, "
    + " + ".join(f"({n}) * n{c}" for c, n in zip("xyz", [x.replace("by", "y").replace("bx", "x").replace("bz", "z") for x in _cross("a", "b", "c")], strict=True)) + " AS v, "
    + " + ".join(f"({n}) * n{c}" for c, n in zip("xyz", [x.replace("cy", "y").replace("cx", "x").replace("cz", "z") for x in _cross("a", "b", "c")], strict=True)) + " AS w FROM m) SELECT id, round(sqrt(min(CASE WHEN v >= 0 AND w >= 0 AND v + w <= n2 THEN h * h / n2 ELSE e2 END)), 5) + 0e0 AS d FROM d GROUP BY id",
    "pts", "surf_t",
)
def nearest_triangle(spark, sf):
    """Distance of points to the mesh, by candidate boxes of growing reach"""
    from meshspark.operators import spatial

    t, p = _tri_d2(spark, sf)
    return spatial.nearest_triangle(p, t, 2.0).select("id", (F.round(F.sqrt("d2"), 5) + 0.0).alias("d"))


@query()
def advancing_front(spark, sf):
    """Four blocks of the height field meshed by advancing fronts, with heights"""
    blocks = spark.createDataFrame([(2 * i + j, 3.5 * i, 3.5 * j, 3.5 * i + 3.5, 3.5 * j + 3.5) for i in range(2) for j in range(2)], "block int, x0 double, y0 double, x1 double, y1 double")
    return front.lift(front.mesh_blocks(blocks, 0.5), fx.surf_v(spark, sf))


@query("SELECT CAST(2 * i + j AS INT) AS block, round((i * 3.5 + 3.5 - i * 3.5) * (j * 3.5 + 3.5 - j * 3.5), 6)::DOUBLE AS area FROM range(2) a(i), range(2) b(j)")
def advancing_front_area(spark, sf):
    """The plane area that each block's front covers"""
    t = advancing_front(spark, sf)
    a = g.left_turn(*[F.col(p + c) for p in "abc" for c in "xy"]) / 2
    return t.groupBy("block").agg((F.round(F.sum(a), 6) + 0.0).alias("area"))


_AT = {"x": 0.25, "y": 0.5, "z": 0.75}


def _weights(*orders: int) -> str:
    """Product of the spline's weights along the axes, each of that derivative."""
    w = {c: surface.weight_derivatives(u, k) for (c, u), k in zip(_AT.items(), orders, strict=True)}
    return " * ".join(f"(CASE d{c} WHEN -1 THEN {x[0]!r} WHEN 0 THEN {x[1]!r} WHEN 1 THEN {x[2]!r} ELSE {x[3]!r} END)::DOUBLE" for c, x in w.items())


_GRADIENT = {"gx": (1, 0, 0), "gy": (0, 1, 0), "gz": (0, 0, 1), "value": (0, 0, 0)}


@query(f"WITH n AS ({_NEAR.format(w=1, m=4)}) SELECT x, y, z, {', '.join(f'round(sum(round({_weights(*k)} * value, 10)), 5) + 0e0 AS {n}' for n, k in _GRADIENT.items())} FROM n WHERE x < 7 AND y < 7 AND z < 7 GROUP BY x, y, z", "vox")
def spline_gradient(spark, sf):
    """Derivatives of the tri-cubic spline"""
    return surface.spline_field(fx.vox(spark, sf), (8, 8, 8), (0.25, 0.5, 0.75)).select("x", "y", "z", *[(F.round(c, 5) + 0.0).alias(c) for c in _GRADIENT])


@query()
def iso_curvatures(spark, sf):
    """Curvatures of the level surfaces in cells"""
    return surface.iso_curvature(surface.spline_field(fx.vox(spark, sf), (8, 8, 8), (0.25, 0.5, 0.75))).select("x", "y", "z", "value", "mean", "gauss")


@query()
def mesh_curvatures(spark, sf):
    """Curvatures of the height field from quadrics over three rings"""
    return surface.mesh_curvature(fx.surf_t(spark, sf))


@query()
def tet_regression(spark, sf):
    """Scalars and gradients at cell centres from weighted quadratics"""
    v = fx.tverts(spark, sf).select(F.col("v").alias("id"), "x", "y", "z", "s")
    q = v.filter("x < 7 and y < 7 and z < 7").select(F.col("id").alias("q"), *[(F.col(c) + 0.5).alias(c) for c in "xyz"])
    return surface.scalar_regression(q, v, 2.2)


@query()
def iso_seeds(spark, sf):
    """Ten evenly spaced faces of each component of the iso-surface"""
    t = iso.marching_cubes(volume.cell_corners(fx.vox(spark, sf)), fx.ISO)
    return surface.seeds(t.select("e0", "e1", "e2"))


@query("WITH d AS (SELECT q.id AS q, p.id AS id, p.label, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS d2 FROM pts q, pts p), r AS (SELECT q, id, d2, CAST(row_number() OVER (PARTITION BY q ORDER BY d2, id) AS INT) AS rank FROM d) SELECT q, rank, id, round(d2, 6) + 0e0 AS d2 FROM r WHERE rank <= 3", "pts")
def merged_nearest(spark, sf):
    """Nearest points of every point merged from block-wise streams, each block searched by the blocks of a k-d tree"""
    from meshspark.operators import spatial

    p = fx.pts(spark, sf)
    q = p.select(F.col("id").alias("q"), "x", "y", "z")
    s = spatial.knn_by(q, p, 3, "label")
    return surface.merged_nearest(s, 3).select("q", "rank", "id", r6("d2", "d2"))


_ICO = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE, {i + 1}.0::DOUBLE)" for i, (x, y, z) in enumerate(surface.icosahedron_directions()))


@query(f"WITH s(d, sx, sy, sz, s) AS (VALUES {_ICO}), u AS (SELECT id AS q, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM pts), t AS (SELECT q, x * sx + y * sy + z * sz AS dot, s, row_number() OVER (PARTITION BY q ORDER BY x * sx + y * sy + z * sz DESC, d) AS r FROM u, s) SELECT q, round(sum(round(dot * s, 10)) / sum(round(dot, 10)), 5) + 0e0 AS value FROM t WHERE r <= 3 GROUP BY q", "pts")
def directional_blend(spark, sf):
    """Values by direction from icosahedron samples"""
    n = g.norm(g.vec())
    q = fx.pts(spark, sf).select(F.col("id").alias("q"), *[(F.col(c) / n).alias(c) for c in "xyz"])
    s = spark.createDataFrame([(i, *d, float(i + 1)) for i, d in enumerate(surface.icosahedron_directions())], "d int, x double, y double, z double, s double")
    return surface.directional(q, s).select("q", (F.round("value", 5) + 0.0).alias("value"))
