"""Queries over boxes, planes, pairs of triangles, matrices, dual numbers, intervals, loops and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.functions import geometry as g
from meshspark.functions import scalars as sc
from meshspark.operators import graph, linear, mesh, spatial, stats
from meshspark.plans.registry import query, r6, s6
from meshspark.sources import writers as W
from meshspark.shared import fresh


def _lit(*xs: float):
    return tuple(F.lit(float(x)) for x in xs)


def _r5(c, name):
    return (F.round(c, 5) + F.lit(0.0)).alias(name)


def _s5(sql, name):
    return f"round({sql}, 5) + 0e0 AS {name}"


# ---------------------------------------------------------------- boxes, planes, lines

_BOX = "b AS (SELECT f, " + ", ".join(f"least(a{c}, b{c}, c{c}) AS lo{c}, greatest(a{c}, b{c}, c{c}) AS hi{c}" for c in "xyz") + " FROM surf_t)"


@query(f"WITH {_BOX} SELECT f, CASE WHEN hix < 2 OR lox > 5 OR hiy < 1.5 OR loy > 5.5 OR hiz < 3.9 OR loz > 4.1 THEN 'outside' WHEN lox >= 2 AND hix <= 5 AND loy >= 1.5 AND hiy <= 5.5 AND loz >= 3.9 AND hiz <= 4.1 THEN 'inside' ELSE 'intersect' END AS class, CAST(CASE WHEN hix - lox >= hiy - loy AND hix - lox >= hiz - loz THEN 0 WHEN hiy - loy >= hiz - loz THEN 1 ELSE 2 END AS INT) AS longest, round(greatest(hix, 5) - least(lox, 2), 6) + 0e0 AS joined, round(least(hiy, 5.5) - greatest(loy, 1.5) + 0.5, 6) + 0e0 AS met FROM b", "surf_t")
def box_classes(spark, sf):
    """Boxes of faces against a box: class, longest axis, union, intersection, enlargement"""
    t = fx.surf_t(spark, sf)
    own = tuple(F.least(*[p + c for p in "abc"]) for c in "xyz"), tuple(F.greatest(*[p + c for p in "abc"]) for c in "xyz")
    box = _lit(2, 1.5, 3.9), _lit(5, 5.5, 4.1)
    joined, met = g.box_union(own, box), g.box_enlarge(g.box_meet(own, box), 0.25)
    return t.select("f", g.box_class(*own, *box).alias("class"), g.box_axis(*own).cast("int").alias("longest"), r6(joined[1][0] - joined[0][0], "joined"), r6(met[1][1] - met[0][1], "met"))


_D = "(x + 2 * y - 2 * z - 0.75::DOUBLE) / 3"


@query(f"SELECT id, {s6(f'x - ({_D}) / 3', 'px')}, {s6(f'y - 2 * ({_D}) / 3', 'py')}, {s6(f'z + 2 * ({_D}) / 3', 'pz')}, {s6(f'-({_D})', 'flipped')}, CASE WHEN abs(x - z) > 1e-9 THEN round((0.25::DOUBLE - (x + 2 * y - 2 * z) / 3) / ((x - z) / 3), 4) + 0e0 END AS hit FROM pts", "pts")
def plane_operations(spark, sf):
    """Projection to a plane, the flipped plane, and where a line meets it"""
    at = g.plane((1.0, 2.0, -2.0), 0.75)
    p = g.plane_project(g.vec(), at)
    hit = g.plane_hit(g.vec(), (F.col("x") - F.col("z"), F.lit(0.0), F.lit(0.0)), at)
    return fx.pts(spark, sf).select("id", *[r6(c, "p" + n) for c, n in zip(p, "xyz", strict=True)], r6(g.plane_distance(g.vec(), g.plane_flip(at)), "flipped"), F.when(F.abs(F.col("x") - F.col("z")) > 1e-9, F.round(hit, 4) + 0.0).alias("hit"))


@query("SELECT id, round(CASE WHEN x * x + y * y > 0 THEN abs(y) / sqrt(x * x + y * y) END, 5) + 0e0 AS d FROM pts", "pts")
def line_distances(spark, sf):
    """Distance of the lines 0 to (x, y, z) moved along x by one, and the z axis"""
    one = F.lit(1.0)
    x, y, z = g.vec()
    start = (one, F.lit(0.0), F.lit(0.0))
    return fx.pts(spark, sf).select("id", _r5(g.line_line_distance(start, (one + x, y, z), _lit(0, 0, 0), _lit(0, 0, 1)), "d"))


_SLAB = {c: f"CASE WHEN {c} <> 0 THEN least((lo - o{c}) / {c}, (hi - o{c}) / {c}) WHEN o{c} BETWEEN lo AND hi THEN 0e0 ELSE 'infinity'::DOUBLE END AS e{c}, CASE WHEN {c} <> 0 THEN greatest((lo - o{c}) / {c}, (hi - o{c}) / {c}) ELSE 'infinity'::DOUBLE END AS l{c}" for c in "xyz"}


@query(f"WITH r AS (SELECT id, x, y, z, 3e0 AS ox, 2e0 AS oy, 1e0 AS oz, -0.5::DOUBLE AS lo, 0.5::DOUBLE AS hi FROM (SELECT id, x - 3 AS x, y - 2 AS y, z - 1 AS z FROM pts)), s AS (SELECT id, {', '.join(_SLAB.values())} FROM r) SELECT id, CASE WHEN greatest(0e0, ex, ey, ez) <= least(lx, ly, lz) AND greatest(0e0, ex, ey, ez) < 'infinity'::DOUBLE THEN round(greatest(0e0, ex, ey, ez), 6) + 0e0 END AS t FROM s", "pts")
def ray_boxes(spark, sf):
    """Where rays from (3, 2, 1) through the points enter the cube of side 1"""
    o = _lit(3, 2, 1)
    return fx.pts(spark, sf).select("id", r6(g.ray_box(o, g.sub(g.vec(), o), _lit(-0.5, -0.5, -0.5), _lit(0.5, 0.5, 0.5)), "t"))


_T = [f"(({q[0]} - {p[0]}) * (y - {p[1]}) - ({q[1]} - {p[1]}) * (x - {p[0]}))" for p, q in (((-1, -1), (1, -0.5)), ((1, -0.5), (0, 1.5)), ((0, 1.5), (-1, -1)))]


@query(f"SELECT id, ({' AND '.join(f'{t} >= 0' for t in _T)}) OR ({' AND '.join(f'{t} <= 0' for t in _T)}) AS inside FROM pts", "pts")
def in_plane_triangle(spark, sf):
    """Plane points in a triangle"""
    return fx.pts(spark, sf).select("id", g.in_triangle(F.col("x"), F.col("y"), *_lit(-1, -1, 1, -0.5, 0, 1.5)).alias("inside"))


@query("SELECT f, round((((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / (2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by)))), 6) + 0e0 AS x, round((((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / (2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by)))), 6) + 0e0 AS y FROM surf_t", "surf_t")
def circumcentres(spark, sf):
    """Circumcentres of faces in the plane"""
    x, y = g.circumcentre(*[F.col(p + c) for p in "abc" for c in "xy"])
    return fx.surf_t(spark, sf).select("f", r6(x, "x"), r6(y, "y"))


def _edge_hits(p: str, q: str, tri: str) -> str:
    """SQL: the segment between two corners crosses a triangle, by signs of volumes."""
    def volume(a, b, c, d):
        u, v, w = ([f"({y}{k} - {a}{k})" for k in "xyz"] for y in (b, c, d))
        return f"({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) + {u[1]} * ({v[2]} * {w[0]} - {v[0]} * {w[2]}) + {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]}))"

    a, b, c = (f"{tri}.{x}" for x in "abc")
    around = [volume(p, q, x, y) for x, y in ((a, b), (b, c), (c, a))]
    return f"({volume(a, b, c, p)} * {volume(a, b, c, q)} <= 0 AND (({' AND '.join(f'{v} >= 0' for v in around)}) OR ({' AND '.join(f'{v} <= 0' for v in around)})))"


_MOVED = "m AS (SELECT f, " + ", ".join(f"{p}{c} + {d}::DOUBLE AS {p}{c}" for p in "abc" for c, d in zip("xyz", (0.37, 0.21, 0.05), strict=True)) + " FROM surf_t)"
_HITS = " OR ".join([_edge_hits(f"s.{p}", f"s.{q}", "m") for p, q in ("ab", "bc", "ca")] + [_edge_hits(f"m.{p}", f"m.{q}", "s") for p, q in ("ab", "bc", "ca")])


@query(f"WITH {_MOVED} SELECT s.f AS l, m.f AS r FROM surf_t s JOIN m ON {_HITS}", "surf_t")
def triangle_overlaps(spark, sf):
    """Faces of the mesh and of a moved copy that cross, beyond their boxes"""
    t = fx.surf_t(spark, sf)
    corners = [p + c for p in "abc" for c in "xyz"]
    moved = t.select(F.col("f").alias("r"), *[(F.col(p + c) + d).alias(p + c) for p in "abc" for c, d in zip("xyz", (0.37, 0.21, 0.05), strict=True)])
    return spatial.triangle_overlaps(t.select(F.col("f").alias("l"), *corners), moved, 1.0)


# ---------------------------------------------------------------- turns, matrices

@query("WITH p AS (SELECT id, x, y, z, 0.5::DOUBLE * label AS t FROM pts) SELECT id, round(x * cos(t) - y * sin(t), 6) + 0e0 AS x, round(x * sin(t) + y * cos(t), 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM p", "pts")
def axis_turns(spark, sf):
    """Points turned about an axis by unit quaternions"""
    q = g.axis_quaternion(_lit(0, 0, 3), F.lit(0.5) * F.col("label"))
    return fx.pts(spark, sf).select("id", *[r6(c, n) for c, n in zip(g.quaternion_rotate(g.vec(), q), "xyz", strict=True)])


@query("SELECT id, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM pts", "pts")
def spherical_round_trip(spark, sf):
    """To spherical coordinates and back"""
    n = g.norm(g.vec())
    s = fx.pts(spark, sf).select("id", n.alias("r"), F.acos(F.col("z") / n).alias("t"), F.atan2("y", "x").alias("p"))
    return s.select("id", *[r6(c, k) for c, k in zip(g.from_spherical(F.col("r"), F.col("t"), F.col("p")), "xyz", strict=True)])


def _matrix(n: int = 4):
    """Diagonally strong matrices from the coordinates."""
    x, y, z = g.vec()
    parts = [x, y, z, x * y]
    return [F.lit(6.0 + i) + parts[i] if i == j else parts[(i + 2 * j) % 4] / (1 + i) for i in range(n) for j in range(n)]


@query("WITH e AS (SELECT unnest(range(4)) AS i) SELECT p.id, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, CASE WHEN a.i = b.i THEN 1e0 ELSE 0e0 END AS value FROM pts p, e a, e b", "pts")
def matrix_inverses(spark, sf):
    """products of 4 x 4 matrices and their inverses"""
    m = _matrix()
    product = linear.matmul(m, linear.inverse([F.col(f"m{k}") for k in range(16)], 4), 4)
    rows = fx.pts(spark, sf).select("id", *"xyz", *[c.alias(f"m{k}") for k, c in enumerate(m)])
    cells = F.array(*[F.struct(F.lit(k // 4).alias("i"), F.lit(k % 4).alias("j"), (F.round(c, 6) + 0.0).alias("value")) for k, c in enumerate(product)])
    return rows.select("id", F.explode(cells).alias("c")).select("id", "c.*")


@query("SELECT id, round(d, 5) + 0e0 AS det, round(d, 5) + 0e0 AS turned FROM (SELECT id, (6 + x) * ((7 + y) * (8 + z) - (x / 2) * (x * y / 3)) - z * ((x * y / 2) * (8 + z) - (x / 2) * (z / 3)) + x * ((x * y / 2) * (x * y / 3) - (7 + y) * (z / 3)) AS d FROM (SELECT id, x, y, z FROM pts)) ", "pts")
def determinants(spark, sf):
    """determinants of 3 x 3 matrices and of their transposes"""
    x, y, z = g.vec()
    m = [6 + x, z, x, x * y / 2, 7 + y, x / 2, z / 3, x * y / 3, 8 + z]
    return fx.pts(spark, sf).select("id", _r5(linear.det(m, 3), "det"), _r5(linear.det(linear.transpose(m, 3), 3), "turned"))


@query("SELECT id, round(x / 4, 6) + 0e0 AS rx, round(y / 4, 6) + 0e0 AS ry, round(z / 4, 6) + 0e0 AS rz FROM pts", "pts")
def euler_round_trip(spark, sf):
    """angles to a rotation and back"""
    x, y, z = g.vec()
    m = linear.euler(x / 4, y / 4, z / 4)
    rows = fx.pts(spark, sf).select("id", *[c.alias(f"m{k}") for k, c in enumerate(m)])
    return rows.select("id", *[r6(c, n) for c, n in zip(linear.euler_angles([F.col(f"m{k}") for k in range(9)]), ("rx", "ry", "rz"), strict=True)])


_SYM = "m AS (SELECT id, 5 + x AS a, 6 + y AS d, 9 + z AS f, x / 2 AS b, y / 2 AS c, z / 2 AS e FROM pts), q AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) AS p FROM m), h AS (SELECT *, acos(greatest(-1e0, least(1e0, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * p * p * p)))) / 3 AS t FROM q)"


def _symmetric():
    x, y, z = g.vec()
    return F.array(5 + x, x / 2, y / 2, x / 2, 6 + y, z / 2, y / 2, z / 2, 9 + z)


@query(f"WITH {_SYM} SELECT id, {_s5('q + 2 * p * cos(t + 2 * pi() / 3)', 'low')}, {_s5('3 * q - (q + 2 * p * cos(t)) - (q + 2 * p * cos(t + 2 * pi() / 3))', 'mid')}, {_s5('q + 2 * p * cos(t)', 'high')}, {_s5('greatest(abs(q + 2 * p * cos(t)), abs(q + 2 * p * cos(t + 2 * pi() / 3)))', 'singular')} FROM h", "pts")
def symmetric_eigenvalues(spark, sf):
    """F8: eigenvalues and the greatest singular value of symmetric matrices"""
    rows = fx.pts(spark, sf).select("id", linear.symmetric_eigen(_symmetric()).alias("e"), linear.singular_values(_symmetric()).alias("s"))
    v = F.col("e.values")
    return rows.select("id", _r5(v[0], "low"), _r5(v[1], "mid"), _r5(v[2], "high"), _r5(F.col("s")[0], "singular"))


@query(f"WITH {_SYM} SELECT id, {_s5('sqrt(a)', 'l00')}, {_s5('b / sqrt(a)', 'l10')}, {_s5('c / sqrt(a)', 'l20')}, {_s5('sqrt(d - b * b / a)', 'l11')}, {_s5('(e - b * c / a) / sqrt(d - b * b / a)', 'l21')}, {_s5('a * 1 + b * 2 + c * 3', 'r0')} FROM m", "pts")
def cholesky_factors(spark, sf):
    """F8: lower factors, and solutions put back into their system"""
    rows = fx.pts(spark, sf)
    right = [F.col("m")[3 * i] * 1 + F.col("m")[3 * i + 1] * 2 + F.col("m")[3 * i + 2] * 3 for i in range(3)]
    rows = rows.select("id", _symmetric().alias("m")).select("id", "m", linear.cholesky("m").alias("l"), F.array(*right).alias("r"))
    rows = rows.select("id", "m", "l", linear.solve("m", "r").alias("s"))
    back = F.col("m")[0] * F.col("s")[0] + F.col("m")[1] * F.col("s")[1] + F.col("m")[2] * F.col("s")[2]
    return rows.select("id", *[_r5(F.col("l")[k], n) for k, n in ((0, "l00"), (3, "l10"), (6, "l20"), (4, "l11"), (7, "l21"))], _r5(back, "r0"))


@query(f"SELECT label, count(*) AS n, {_s5('regr_intercept(z, x)', 'c0')}, {_s5('regr_slope(z, x)', 'c1')} FROM pts GROUP BY label", "pts")
def line_fits(spark, sf):
    """polynomials of least squares in each group"""
    c = F.col("coefficients")
    return linear.polynomial_fit(fx.pts(spark, sf), ["label"], ["x"], "z", 1).select("label", "n", _r5(c[0], "c0"), _r5(c[1], "c1"))


@query("SELECT CAST(k AS INT) AS k, value + 0e0 AS value FROM (VALUES (0, 2.0::DOUBLE), (1, -1.0), (2, 0.5), (3, 0.25), (4, 0.0), (5, -3.0)) t(k, value)")
def surface_fit(spark, sf):
    """the coefficients of a plane polynomial of second degree found again from its values"""
    x, y = F.col("x"), F.col("y")
    p = fx.pts(spark, sf).withColumn("v", 2 - x + 0.5 * y + 0.25 * x * x - 3 * y * y).withColumn("all", F.lit(1))
    fit = linear.polynomial_fit(p, ["all"], ["x", "y"], "v", 2)
    return fit.select(F.posexplode("coefficients").alias("k", "value")).select("k", (F.round("value", 5) + 0.0).alias("value"))


_F = "sin(x * y) / exp(x) + sqrt(x * x + 1) + tan(x / 8) - cos(x) * (x * x + 2) ** 1.5"
_DF = "y * cos(x * y) / exp(x) - sin(x * y) / exp(x) + x / sqrt(x * x + 1) + (1 + tan(x / 8) ** 2) / 8 + sin(x) * (x * x + 2) ** 1.5 - cos(x) * 3 * x * sqrt(x * x + 2)"


@query(f"SELECT id, {_s5(_F, 'value')}, {_s5(_DF, 'slope')} FROM pts", "pts")
def forward_derivatives(spark, sf):
    """a function and its derivative along x by dual numbers"""
    x, y = linear.variable(F.col("x")), linear.constant(F.col("y"))
    two = linear.d_mul(x, x)
    f = linear.d_div(linear.d_sin(linear.d_mul(x, y)), linear.d_exp(x))
    f = linear.d_add(f, linear.d_sqrt(linear.d_add(two, linear.constant(1))))
    f = linear.d_add(f, linear.d_tan(linear.d_div(x, linear.constant(8))))
    f = linear.d_sub(f, linear.d_mul(linear.d_cos(x), linear.d_pow(linear.d_add(two, linear.constant(2)), 1.5)))
    return fx.pts(spark, sf).select("id", _r5(f[0], "value"), _r5(f[1], "slope"))


# ---------------------------------------------------------------- intervals, polynomials, random streams

_IV = "i AS (SELECT id, least(x, y) AS a, greatest(x, y) AS b, least(y, z) AS c, greatest(y, z) AS d FROM pts)"


@query(f"WITH {_IV} SELECT id, CASE WHEN c > 0 OR d < 0 THEN round(least(a / c, a / d, b / c, b / d), 4) + 0e0 END AS div_low, {s6('b * b * b', 'cube_high')}, CASE WHEN b >= 0 THEN round(sqrt(b), 6) + 0e0 END AS root_high, CASE WHEN a <= 0 AND b >= 0 THEN 0e0 ELSE round(least(a ** 4, b ** 4), 6) + 0e0 END AS fourth_low, CAST(CASE WHEN a > 0 THEN 1 WHEN b < 0 THEN -1 ELSE 0 END AS INT) AS sign, round(least(a ** 3 - 3 * a, b ** 3 - 3 * b, CASE WHEN a < 1 AND b > 1 THEN -2e0 ELSE 1e9 END), 5) + 0e0 AS cubic_low FROM i", "pts")
def interval_functions(spark, sf):
    """quotients, powers, roots, signs and cubics of intervals"""
    p = fx.pts(spark, sf)
    a = sc.interval(F.least("x", "y"), F.greatest("x", "y"))
    b = sc.interval(F.least("y", "z"), F.greatest("y", "z"))
    rows = p.select("id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    low = F.when((b["min"] > 0) | (b["max"] < 0), F.round(sc.i_div(a, b)["min"], 4) + 0.0)
    root = F.when(a["max"] >= 0, F.round(sc.i_sqrt(a)["max"], 6) + 0.0)
    return rows.select("id", low.alias("div_low"), r6(sc.i_cube(a)["max"], "cube_high"), root.alias("root_high"), r6(sc.i_power(a, 4)["min"], "fourth_low"), sc.i_sign(a).cast("int").alias("sign"), _r5(sc.i_poly(a, 0, -3, 0, 1)["min"], "cubic_low"))


_DIRECTIONS = ", ".join(f"({d}, {k}, {v})" for d in (1, 2, 3) for k, v in enumerate(linear.directions(d)[:10]))


@query(f"WITH v(d, k, v) AS (VALUES {_DIRECTIONS}) SELECT CAST(i AS BIGINT) AS i, CAST(d AS INT) AS d, bit_xor(CASE WHEN (xor(i, i >> 1) >> k) & 1 = 1 THEN v ELSE 0 END)::DOUBLE / {1 << linear.SOBOL_BITS} AS x FROM range(1000) r(i), v GROUP BY i, d")
def sobol_points(spark, sf):
    """a Sobol sequence"""
    i = spark.range(1000).select(F.col("id").alias("i"))
    return i.select("i", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), linear.sobol(F.col("i"), d).alias("x")) for d in (1, 2, 3)])).alias("p")).select("i", "p.*")


@query("SELECT id, label FROM pts ORDER BY md5('sample-1:' || CAST(id AS VARCHAR)), id LIMIT 100", "pts")
def random_sample(spark, sf):
    """A seeded sample without repetition"""
    return stats.sample(fx.pts(spark, sf), "id", 100).select("id", "label")


@query("WITH h AS (SELECT label AS bin, count(*) AS n FROM pts GROUP BY label), r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS total FROM h) SELECT q, min(bin) AS bin FROM r, (VALUES (0.25::DOUBLE), (0.5), (0.9)) t(q) WHERE run >= q * total GROUP BY q", "pts")
def quantile_bins(spark, sf):
    """The bins at which a histogram reaches quantiles"""
    h = fx.pts(spark, sf).groupBy(F.col("label").alias("bin")).agg(F.count("*").alias("n"))
    out = None
    for q in (0.25, 0.5, 0.9):
        one = stats.quantile_bin(h, q).select(F.lit(q).alias("q"), "bin")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- loops, images

@query("WITH RECURSIVE border AS (SELECT a, b FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.a = e.b AND o.b = e.a)), walk(loop, pos, v) AS (SELECT min(a), 0, min(a) FROM border UNION ALL SELECT loop, pos + 1, b FROM walk JOIN border ON a = v WHERE b <> loop) SELECT loop, pos, v FROM walk", "edges")
def border_loops(spark, sf):
    """The border walked from its least vertex"""
    return graph.walk_loops(mesh.border_edges(fx.surf_f(spark)).select("a", "b")).select(F.col("loop").cast("int").alias("loop"), F.col("pos").cast("int").alias("pos"), F.col("v").cast("int").alias("v"))


@query("SELECT x, y, CAST(floor(z * 20) AS INT) AS value FROM (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, z FROM surf_v)", "surf_v")
def image_ppm(spark, sf):
    """A grey image as text and back"""
    path = fresh(spark, "image")
    v = fx.surf_v(spark, sf).select(F.col("x").cast("int").alias("u"), F.col("y").cast("int").alias("v"), F.floor(F.col("z") * 20).cast("int").alias("value"))
    W.write_ppm(v, path, 255)
    lines = spark.read.text(f"{path}/part-*.txt", wholetext=True).select(F.split(F.regexp_replace("value", r"\s+$", ""), r"\s+").alias("w"))
    cells = lines.select(F.expr("cast(w[1] as int)").alias("width"), F.posexplode(F.expr("slice(w, 5, size(w) - 4)")).alias("k", "c")).filter("k % 3 = 0")
    return cells.select(F.expr("cast((k div 3) % width as int)").alias("x"), F.expr("cast((k div 3) div width as int)").alias("y"), F.col("c").cast("int").alias("value"))
