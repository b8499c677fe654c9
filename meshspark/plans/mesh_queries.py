"""Queries over the height field, its tetrahedra and its events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.functions import geometry as g
from meshspark.operators import iso, mesh
from meshspark.plans.registry import query, r6, s6

A, B, C, D = (g.Corner(p) for p in "abcd")


def _len(p: str, q: str) -> str:
    return f"sqrt(({p}x - {q}x) * ({p}x - {q}x) + ({p}y - {q}y) * ({p}y - {q}y) + ({p}z - {q}z) * ({p}z - {q}z))"


def _cross(p: str, q: str, r: str) -> list[str]:
    u, v = [f"({q}{c} - {p}{c})" for c in "xyz"], [f"({r}{c} - {p}{c})" for c in "xyz"]
    return [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _norm(v: list[str]) -> str:
    return f"sqrt({' + '.join(f'{x} * {x}' for x in v)})"


def _area(p: str, q: str, r: str) -> str:
    return f"({_norm(_cross(p, q, r))} / 2)"


def _volume(p: str, q: str, r: str, s: str) -> str:
    n = _cross(p, r, s)
    return "((" + " + ".join(f"({q}{c} - {p}{c}) * {x}" for c, x in zip("xyz", n, strict=True)) + ") / 6)"


AREA = _area("a", "b", "c")
BIG = f"({_len('a', 'b')} * {_len('b', 'c')} * {_len('c', 'a')} / (4 * {AREA}))"
SMALL = f"(2 * {AREA} / ({_len('a', 'b')} + {_len('b', 'c')} + {_len('c', 'a')}))"
V = _volume("a", "b", "c", "d")


@query(f"SELECT f, {s6(BIG, 'circumradius')}, {s6(SMALL, 'inradius')}, {s6(f'2 * {SMALL} / {BIG}', 'q')} FROM surf_t", "surf_t")
def triangle_quality(spark, sf):
    """Radii of triangles and their ratio"""
    return mesh.quality(fx.surf_t(spark, sf)).select("f", *[r6(c, c) for c in ("circumradius", "inradius", "q")])


@query(
    f"WITH q AS (SELECT greatest(0, least(99, CAST(floor(100 * round(2 * {SMALL} / {BIG}, 9)) AS INT))) AS bin FROM surf_t), n AS (SELECT bin, count(*) AS n FROM q GROUP BY bin), h AS (SELECT CAST(r.i AS INT) AS bin, coalesce(n, 0) AS n FROM range(100) r(i) LEFT JOIN n ON n.bin = r.i) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum FROM h",
    "surf_t",
)
def quality_histogram(spark, sf):
    """Histogram and cumulative counts of triangle quality"""
    q = mesh.quality(fx.surf_t(spark, sf)).select(F.round("q", 9).alias("q"))
    return mesh.histogram(q, "q", 100)


@query(
    f"SELECT t, {s6(f'CASE WHEN abs({V}) > 0 THEN (3 * abs({V}) / ({_area('a', 'b', 'c')} + {_area('a', 'b', 'd')} + {_area('a', 'c', 'd')} + {_area('b', 'c', 'd')})) / (sqrt((p + q + r) * (p + q - r) * (p - q + r) * (q + r - p)) / (24 * abs({V}))) ELSE 0 END', 'ratio')} FROM (SELECT *, {_len('a', 'b')} * {_len('c', 'd')} AS p, {_len('a', 'c')} * {_len('b', 'd')} AS q, {_len('a', 'd')} * {_len('b', 'c')} AS r FROM tet_c)",
    "tet_c",
)
def tet_radius_ratio(spark, sf):
    """Inradius over circumradius of tetrahedra"""
    return fx.tet_corners(spark, sf).select("t", r6(g.tet_radius_ratio(A, B, C, D), "ratio"))


@query(
    f"WITH p AS (SELECT *, (3 * ax + bx + cx) / 5 AS px, (3 * ay + by + cy) / 5 AS py, (3 * az + bz + cz) / 5 AS pz FROM surf_t) SELECT f, {s6(f'{_area('p', 'b', 'c')} / {AREA}', 'u')}, {s6(f'{_area('a', 'p', 'c')} / {AREA}', 'v')}, {s6(f'{_area('a', 'b', 'p')} / {AREA}', 'w')} FROM p",
    "surf_t",
)
def unsigned_barycentric(spark, sf):
    """Area ratios of a point within each triangle"""
    p = tuple((3 * a + b + c) / 5 for a, b, c in zip(A, B, C, strict=True))
    u = g.unsigned_barycentric(p, A, B, C)
    return fx.surf_t(spark, sf).select("f", *[r6(c, n) for c, n in zip(u, "uvw", strict=True)])


@query(
    f"WITH p AS (SELECT *, (4 * ax + 3 * bx + 2 * cx + dx) / 10 AS px, (4 * ay + 3 * by + 2 * cy + dy) / 10 AS py, (4 * az + 3 * bz + 2 * cz + dz) / 10 AS pz FROM tet_c) SELECT t, {s6(f'{_volume('p', 'b', 'c', 'd')} / {V} * sa + {_volume('a', 'p', 'c', 'd')} / {V} * sb + {_volume('a', 'b', 'p', 'd')} / {V} * sc + {_volume('a', 'b', 'c', 'p')} / {V} * sd', 's')} FROM p",
    "tet_c",
)
def tet_interpolation(spark, sf):
    """Barycentric interpolation of the scalar at a point of each tetrahedron"""
    p = tuple((4 * a + 3 * b + 2 * c + d) / 10 for a, b, c, d in zip(A, B, C, D, strict=True))
    w = g.tet_barycentric(p, A, B, C, D)
    s = sum((x * F.col(n + "s") for x, n in zip(w, "abcd", strict=True)), F.lit(0.0))
    return fx.tet_corners(spark, sf).select("t", r6(s, "s"))


@query(
    "SELECT f, least(ax, bx, cx) AS lox, greatest(ax, bx, cx) AS hix, least(ay, by, cy) AS loy, greatest(ay, by, cy) AS hiy, round(least(az, bz, cz), 6) AS loz, round(greatest(az, bz, cz), 6) AS hiz, CASE WHEN greatest(ax, bx, cx) - least(ax, bx, cx) >= greatest(ay, by, cy) - least(ay, by, cy) AND greatest(ax, bx, cx) - least(ax, bx, cx) >= greatest(az, bz, cz) - least(az, bz, cz) THEN 0 WHEN greatest(ay, by, cy) - least(ay, by, cy) >= greatest(az, bz, cz) - least(az, bz, cz) THEN 1 ELSE 2 END AS longest FROM surf_t",
    "surf_t",
)
def triangle_boxes(spark, sf):
    """Bounding boxes and longest axes of triangles"""
    lo, hi = ({c: f(*[p + c for p in "abc"]) for c in "xyz"} for f in (F.least, F.greatest))
    w = {c: hi[c] - lo[c] for c in "xyz"}
    axis = F.when((w["x"] >= w["y"]) & (w["x"] >= w["z"]), 0).when(w["y"] >= w["z"], 1).otherwise(2)
    cols = [x for c in "xyz" for x in ((lo[c], "lo" + c), (hi[c], "hi" + c))]
    return fx.surf_t(spark, sf).select("f", *[(F.round(v, 6) if n.endswith("z") else v).alias(n) for v, n in cols], axis.alias("longest"))


@query("SELECT e.f, e.i, e.a, e.b, coalesce(max(o.f), -1) AS nbr FROM edges e LEFT JOIN edges o ON o.a = e.b AND o.b = e.a GROUP BY e.f, e.i, e.a, e.b", "edges")
def halfedge_twins(spark, sf):
    """The face across each directed edge"""
    return mesh.twins(fx.surf_f(spark))


@query("SELECT v, count(*) AS n, min(nbr) AS low, max(nbr) AS high, CAST(sum(nbr) AS BIGINT) AS total FROM (SELECT a AS v, b AS nbr FROM edges UNION SELECT b, a FROM edges) GROUP BY v", "edges")
def one_rings(spark, sf):
    """Neighbours of each vertex"""
    return mesh.one_ring(fx.surf_f(spark)).groupBy("v").agg(F.count("*").alias("n"), F.min("nbr").alias("low"), F.max("nbr").alias("high"), F.sum("nbr").alias("total"))


@query("SELECT v, count(*) AS n, CAST(sum(f) AS BIGINT) AS total FROM (SELECT f, unnest([v0, v1, v2]) AS v FROM surf_f) GROUP BY v", "surf_f")
def vertex_faces(spark, sf):
    """Faces of each vertex"""
    return mesh.incidence(fx.surf_f(spark)).groupBy("v").agg(F.count("*").alias("n"), F.sum("f").alias("total"))


@query(
    "WITH k AS (SELECT t, list_sort([v1, v2, v3]) AS k FROM tets UNION ALL SELECT t, list_sort([v0, v2, v3]) FROM tets UNION ALL SELECT t, list_sort([v0, v1, v3]) FROM tets UNION ALL SELECT t, list_sort([v0, v1, v2]) FROM tets) SELECT k[1] AS a, k[2] AS b, k[3] AS c, min(t) AS t FROM k GROUP BY k HAVING count(*) = 1",
    "tets",
)
def tet_shell(spark, sf):
    """Faces that only one tetrahedron has"""
    return mesh.tet_shell(fx.tets(spark))


@query("SELECT x.f AS f, y.f AS g FROM surf_t x JOIN surf_t y ON x.ax = y.cx AND x.ay = y.cy AND x.az = y.cz", "surf_t")
def coordinate_match(spark, sf):
    """Faces of two meshes, the second turned over, whose first corners coincide"""
    t = fx.surf_t(spark, sf)
    other = t.select(F.col("f").alias("g"), *[F.col("c" + c).alias("a" + c) for c in "xyz"])
    return t.select("f", "ax", "ay", "az").join(other, ["ax", "ay", "az"]).select("f", "g")


@query(
    "SELECT s.f AS f, count(*) AS n FROM soup s JOIN soup o ON s.m = 0 AND o.m = 1 AND least(s.ax, s.bx, s.cx) <= greatest(o.ax, o.bx, o.cx) AND least(o.ax, o.bx, o.cx) <= greatest(s.ax, s.bx, s.cx) AND least(s.ay, s.by, s.cy) <= greatest(o.ay, o.by, o.cy) AND least(o.ay, o.by, o.cy) <= greatest(s.ay, s.by, s.cy) AND least(s.az, s.bz, s.cz) <= greatest(o.az, o.bz, o.cz) AND least(o.az, o.bz, o.cz) <= greatest(s.az, s.bz, s.cz) GROUP BY s.f",
    "soup",
)
def box_overlap_join(spark, sf):
    """Faces of two meshes whose boxes meet"""
    from meshspark.operators import spatial

    t = fx.soup_f(spark, sf)
    for c in "xyz":
        t = t.withColumns({"lo" + c: F.least(*[p + c for p in "abc"]), "hi" + c: F.greatest(*[p + c for p in "abc"])})
    met = spatial.overlaps(t.filter("m = 0").withColumnRenamed("f", "l"), t.filter("m = 1").withColumnRenamed("f", "r"), 1.0)
    return met.groupBy(F.col("l").alias("f")).agg(F.count("*").alias("n"))


_N = {c: f"({x} / {_norm(_cross('a', 'b', 'c'))})" for c, x in zip("xyz", _cross("a", "b", "c"), strict=True)}
NORMALS = f"SELECT f, v0, v1, v2, {', '.join(f'{_N[c]} AS n{c}' for c in 'xyz')} FROM surf_t"


@query(
    f"WITH n AS ({NORMALS}), d AS (SELECT e.a, e.b, x.nx * y.nx + x.ny * y.ny + x.nz * y.nz AS c FROM edges e JOIN edges o ON o.a = e.b AND o.b = e.a JOIN n x ON x.f = e.f JOIN n y ON y.f = o.f WHERE e.a < e.b) SELECT a, b, {s6('c', 'cosine')} FROM d WHERE c < 0.97",
    "surf_t", "edges",
)
def crease_edges(spark, sf):
    """P10: edges between faces whose normals differ"""
    return mesh.creases(fx.surf_t(spark, sf), 0.97).select("a", "b", r6("cosine", "cosine"))


@query(
    f"WITH n AS ({NORMALS}), d AS (SELECT e.a, e.b FROM edges e JOIN edges o ON o.a = e.b AND o.b = e.a JOIN n x ON x.f = e.f JOIN n y ON y.f = o.f WHERE e.a < e.b AND x.nx * y.nx + x.ny * y.ny + x.nz * y.nz < 0.97) SELECT v, count(*) AS n FROM (SELECT unnest([a, b]) AS v FROM d) GROUP BY v HAVING count(*) > 2",
    "surf_t", "edges",
)
def kink_vertices(spark, sf):
    """Vertices where more than two creases meet"""
    return mesh.kinks(mesh.creases(fx.surf_t(spark, sf), 0.97))


@query("SELECT f, i, a, b FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.a = e.b AND o.b = e.a)", "edges")
def border_edges(spark, sf):
    """Edges without a twin"""
    return mesh.border_edges(fx.surf_f(spark))


_IMR = f"(({_len('a', 'b')} ** 2 + {_len('b', 'c')} ** 2 + {_len('c', 'a')} ** 2) / (4 * sqrt(3) * {AREA}))"


@query(f"SELECT f, {s6(_IMR, 'imr')} FROM surf_t WHERE {_IMR} < 1.3", "surf_t")
def without_poor_elements(spark, sf):
    """Faces whose inverse mean ratio is below the cutoff"""
    return mesh.without_poor(fx.surf_t(spark, sf), 1.3).select("f", r6("imr", "imr"))


@query("SELECT f FROM (SELECT f, v0 // 2 AS a, v1 // 2 AS b, v2 // 2 AS c FROM surf_f) WHERE a <> b AND b <> c AND c <> a", "surf_f")
def not_degenerate(spark, sf):
    """Faces that keep three different ids when ids are halved"""
    h = fx.surf_f(spark).select("f", *[F.expr(f"cast({c} div 2 as int)").alias(c) for c in ("v0", "v1", "v2")])
    return h.filter(mesh.not_degenerate()).select("f")


def _cos(p: str, q: str, r: str) -> str:
    d = " + ".join(f"({q}{c} - {p}{c}) * ({r}{c} - {p}{c})" for c in "xyz")
    return f"greatest(-1.0, least(1.0, ({d}) / ({_len(p, q)} * {_len(p, r)})))"


@query(
    f"WITH c AS (SELECT unnest([{_cos('a', 'b', 'c')}, {_cos('b', 'c', 'a')}, {_cos('c', 'a', 'b')}]) AS c FROM surf_t), u AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM edges) SELECT (SELECT count(*) FROM surf_v) AS n_verts, (SELECT count(*) FROM u) AS n_edges, (SELECT count(*) FROM surf_f) AS n_faces, (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.a = e.b AND o.b = e.a)) AS n_border, (SELECT count(*) FROM surf_v) - (SELECT count(*) FROM u) + (SELECT count(*) FROM surf_f) AS euler, (SELECT round(degrees(acos(max(c))), 5) FROM c) AS least_angle, (SELECT round(degrees(acos(min(c))), 5) FROM c) AS greatest_angle, (SELECT round(degrees(acos(sum(round(c, 9)) / count(*))), 5) FROM c) AS mean_angle",
    "surf_t", "edges",
)
def mesh_info(spark, sf):
    """A4: counts, Euler characteristic and angles"""
    i = mesh.info(fx.surf_t(spark, sf), fx.surf_v(spark, sf))
    return i.select("n_verts", "n_edges", "n_faces", "n_border", "euler", *[F.round(c, 5).alias(c) for c in ("least_angle", "greatest_angle", "mean_angle")])


@query(
    f"WITH n AS ({NORMALS}), s AS (SELECT v, sum(round(nx, 9)) AS sx, sum(round(ny, 9)) AS sy, sum(round(nz, 9)) AS sz FROM (SELECT unnest([v0, v1, v2]) AS v, nx, ny, nz FROM n) GROUP BY v) SELECT v, {', '.join(s6(f's{c} / sqrt(sx * sx + sy * sy + sz * sz)', 'n' + c) for c in 'xyz')} FROM s",
    "surf_t",
)
def vertex_normals(spark, sf):
    """Unit sums of face normals"""
    return mesh.vertex_normals(fx.surf_t(spark, sf)).select("v", *[r6("n" + c, "n" + c) for c in "xyz"])


_U = dict(zip("xyz", _cross("a", "b", "c"), strict=True))


@query(
    f"WITH n AS (SELECT v0, v1, v2, {', '.join(f'{_U[c]} AS n{c}' for c in 'xyz')} FROM surf_t), s AS (SELECT v, sum(round(nx, 9)) AS sx, sum(round(ny, 9)) AS sy, sum(round(nz, 9)) AS sz FROM (SELECT unnest([v0, v1, v2]) AS v, nx, ny, nz FROM n) GROUP BY v) SELECT v, {', '.join(s6(f's{c} / sqrt(sx * sx + sy * sy + sz * sz)', 'n' + c) for c in 'xyz')} FROM s",
    "surf_t",
)
def vertex_normals_by_area(spark, sf):
    """Unit sums of face normals weighted by area"""
    return mesh.vertex_normals(fx.surf_t(spark, sf), weighted=True).select("v", *[r6("n" + c, "n" + c) for c in "xyz"])


_P = "WITH p AS (SELECT v, w, count(*) AS k FROM (SELECT unnest([v0, v1, v2, v3]) AS v, n FROM (SELECT v0, v1, v2, v3, [v0, v1, v2, v3] AS n FROM tets)) t, unnest(t.n) AS u(w) GROUP BY v, w)"


@query(f"{_P} SELECT p.v, {s6('sum(round(k * s, 9)) / CAST(sum(k) AS BIGINT)', 's')} FROM p JOIN tverts t ON t.v = p.w GROUP BY p.v", "tets", "tverts")
def smoothed_scalars(spark, sf):
    """Scalars averaged over tetrahedra around each vertex"""
    return mesh.smooth_scalars(fx.tets(spark), fx.tverts(spark, sf)).select("v", r6("s", "s"))


@query(
    "WITH b AS (SELECT min(x) AS lx, max(x) - min(x) AS wx, min(y) AS ly, max(y) - min(y) AS wy, min(z) AS lz, max(z) - min(z) AS wz FROM surf_v), c AS (SELECT v, x, y, z, CAST(floor((x - lx) * 3 / wx + 0.5) AS INT) + 4 * (CAST(floor((y - ly) * 3 / wy + 0.5) AS INT) + 4 * CAST(floor((z - lz) * 3 / wz + 0.5) AS INT)) AS cell FROM surf_v, b) SELECT 'v' AS kind, cell AS a, count(*) AS b, CAST(NULL AS INT) AS c, round(sum(round(x, 9)) / count(*), 6) + 0e0 AS x, round(sum(round(y, 9)) / count(*), 6) + 0e0 AS y, round(sum(round(z, 9)) / count(*), 6) + 0e0 AS z FROM c GROUP BY cell UNION ALL SELECT 'f', p.cell, q.cell, r.cell, NULL, NULL, NULL FROM surf_f JOIN c p ON p.v = v0 JOIN c q ON q.v = v1 JOIN c r ON r.v = v2 WHERE p.cell <> q.cell AND q.cell <> r.cell AND r.cell <> p.cell",
    "surf_v", "surf_f",
)
def cluster_simplification(spark, sf):
    """Vertex clustering"""
    v, f = mesh.cluster(fx.surf_f(spark), fx.surf_v(spark, sf), 2)
    none = F.lit(None).cast("double")
    one = v.select(F.lit("v").alias("kind"), F.col("cell").alias("a"), F.col("n").alias("b"), F.lit(None).cast("int").alias("c"), *[r6(c, c) for c in "xyz"])
    return one.unionByName(f.select(F.lit("f").alias("kind"), F.col("c0").alias("a"), F.col("c1").cast("long").alias("b"), F.col("c2").alias("c"), *[none.alias(c) for c in "xyz"]))


@query("SELECT max(greatest(v0, v1, v2) - least(v0, v1, v2)) AS span, count(*) AS n FROM surf_f", "surf_f")
def vertex_span(spark, sf):
    """Greatest range of vertex ids in a face"""
    return mesh.spans(fx.surf_f(spark)).agg(F.max("span").alias("span"), F.count("*").alias("n"))


@query("SELECT max(live) AS width FROM (SELECT CAST(sum(CASE kind WHEN 'v' THEN 1 ELSE -1 END) OVER (ORDER BY seq) AS BIGINT) AS live FROM mev WHERE kind <> 't')", "mev")
def front_width(spark, sf):
    """Peak number of live vertices in the event list"""
    return mesh.front_width(fx.mev(spark, sf))


@query(
    "WITH n AS (SELECT a AS v, b AS w FROM edges UNION SELECT b, a FROM edges) SELECT n.v AS v, round(sum(round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 9)) / count(*), 6) + 0e0 AS len FROM n JOIN surf_v p ON p.v = n.v JOIN surf_v q ON q.v = n.w GROUP BY n.v",
    "edges", "surf_v",
)
def mean_edge_length(spark, sf):
    """Mean edge length around each vertex"""
    return mesh.edge_length_means(fx.surf_t(spark, sf)).select("v", r6("len", "len"))


@query(
    "WITH e AS (SELECT least(a, b) AS p, greatest(a, b) AS q, f FROM edges), w AS (SELECT p, q, count(*) AS n, sum(round(t.x, 9)) AS wx, sum(round(t.y, 9)) AS wy, sum(round(t.z, 9)) AS wz FROM e JOIN surf_f USING (f) JOIN surf_v t ON t.v = CASE WHEN v0 NOT IN (p, q) THEN v0 WHEN v1 NOT IN (p, q) THEN v1 ELSE v2 END GROUP BY p, q), new AS (SELECT CAST(63 + row_number() OVER (ORDER BY p, q) AS INT) AS v, " + ", ".join(f"CASE n WHEN 1 THEN (a.{c} + b.{c}) / 2 ELSE (a.{c} + b.{c}) * 0.375 + w{c} * 0.125 END AS {c}" for c in "xyz") + " FROM w JOIN surf_v a ON a.v = p JOIN surf_v b ON b.v = q), ring AS (SELECT p AS v, q AS o, n FROM w UNION ALL SELECT q, p, n FROM w), s AS (SELECT ring.v, count(*) AS n, min(n) AS least, " + ", ".join(f"sum(round(o.{c}, 9)) AS s{c}, sum(CASE n WHEN 1 THEN round(o.{c}, 9) ELSE 0 END) AS e{c}" for c in "xyz") + " FROM ring JOIN surf_v o ON o.v = ring.o GROUP BY ring.v), old AS (SELECT v, " + ", ".join(f"CASE least WHEN 1 THEN {c} * 0.75 + e{c} * 0.125 ELSE {c} * (1 - n * b) + s{c} * b END AS {c}" for c in "xyz") + " FROM (SELECT s.*, x, y, z, CASE s.n WHEN 3 THEN 0.1875 ELSE 0.375 / s.n END AS b FROM s JOIN surf_v USING (v))) SELECT v, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, round(z, 5) + 0e0 AS z FROM (SELECT * FROM old UNION ALL SELECT * FROM new)",
    "edges", "surf_v",
)
def loop_subdivision(spark, sf):
    """Vertices after one round of subdivision"""
    v, _ = mesh.subdivide(fx.surf_f(spark), fx.surf_v(spark, sf))
    return v.select("v", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query(
    "WITH e AS (SELECT DISTINCT least(a, b) AS p, greatest(a, b) AS q FROM edges), m AS (SELECT p, q, CAST(63 + row_number() OVER (ORDER BY p, q) AS INT) AS v FROM e), t AS (SELECT f, v0, v1, v2, a.v AS m0, b.v AS m1, c.v AS m2 FROM surf_f JOIN m a ON a.p = least(v0, v1) AND a.q = greatest(v0, v1) JOIN m b ON b.p = least(v1, v2) AND b.q = greatest(v1, v2) JOIN m c ON c.p = least(v2, v0) AND c.q = greatest(v2, v0)) SELECT 4 * f AS f, v0, m0 AS v1, m2 AS v2 FROM t UNION ALL SELECT 4 * f + 1, m0, v1, m1 FROM t UNION ALL SELECT 4 * f + 2, m2, m1, v2 FROM t UNION ALL SELECT 4 * f + 3, m0, m1, m2 FROM t",
    "edges",
)
def loop_subdivision_faces(spark, sf):
    """Faces after one round of subdivision"""
    return mesh.subdivide(fx.surf_f(spark), fx.surf_v(spark, sf))[1]


@query("SELECT v, row_number() OVER (ORDER BY at) - 1 AS new FROM (SELECT v, min(at) AS at FROM (SELECT v0 AS v, 3 * f AS at FROM surf_f UNION ALL SELECT v1, 3 * f + 1 FROM surf_f UNION ALL SELECT v2, 3 * f + 2 FROM surf_f) GROUP BY v)", "surf_f")
def compact_ids(spark, sf):
    """Vertices numbered by first use"""
    return mesh.compact(fx.surf_f(spark)).select("v", F.col("new").cast("long").alias("new"))


@query("SELECT f, v0, v1, v2 FROM surf_f UNION ALL SELECT f + 98, v0 + 64, v1 + 64, v2 + 64 FROM surf_f", "surf_f")
def merged_meshes(spark, sf):
    """Two meshes put together"""
    f, v = fx.surf_f(spark), fx.surf_v(spark, sf)
    return mesh.merge([f, f], [v, v])[0]


@query("SELECT f, v0, v2 AS v1, v1 AS v2 FROM surf_f", "surf_f")
def flipped_faces(spark, sf):
    """Faces turned over"""
    return mesh.flip(fx.surf_f(spark))


@query("WITH n AS (SELECT a AS v, b AS w FROM edges UNION ALL SELECT b, a FROM edges) SELECT DISTINCT v FROM (SELECT v, w FROM n GROUP BY v, w HAVING count(*) % 2 = 1)", "edges")
def border_markers(spark, sf):
    """T3 in batch: vertices with a neighbour met an odd number of times"""
    return mesh.odd_neighbours(fx.surf_f(spark))


@query("WITH n AS (SELECT v, count(*) AS n FROM (SELECT a AS v, b AS w FROM edges UNION SELECT b, a FROM edges) GROUP BY v), t AS (SELECT v, count(*) AS k FROM (SELECT unnest([v0, v1, v2]) AS v FROM surf_f) GROUP BY v) SELECT v, n AS n_nbr, k AS n_tri FROM n JOIN t USING (v) WHERE n <> k", "edges")
def border_by_counts(spark, sf):
    """T10 in batch: vertices with unequal numbers of neighbours and triangles"""
    return mesh.unequal_counts(fx.surf_f(spark))


@query("SELECT f, v0, v1, v2, ax, round(az, 6) AS az, round(bz, 6) AS bz, round(cz, 6) AS cz FROM surf_t", "surf_t")
def dereferenced(spark, sf):
    """J13, T6 in batch: triangles with coordinates"""
    return fx.surf_t(spark, sf).select("f", "v0", "v1", "v2", "ax", *[F.round(c, 6).alias(c) for c in ("az", "bz", "cz")])


def _cut(p: str, q: str) -> list[str]:
    u = f"(({fx.ISO} - s{p}) / (s{q} - s{p}))"
    return [f"{p}{c} + {u} * ({q}{c} - {p}{c})" for c in "xyz"]


def _marching_sql() -> str:
    """One branch of a union for each sign pattern and triangle."""
    parts = []
    for m in range(1, 15):
        low = [p for i, p in enumerate("abcd") if m >> i & 1]
        high = [p for p in "abcd" if p not in low]
        e = lambda x, y: (min(x, y), max(x, y))
        if len(low) == 2:
            (p, q), (r, s) = low, high
            tris = [[e(p, r), e(p, s), e(q, s)], [e(p, r), e(q, s), e(q, r)]]
        else:
            one, rest = (low[0], high) if len(low) == 1 else (high[0], low)
            tris = [[e(one, r) for r in rest]]
        for k, t in enumerate(tris):
            cols = ", ".join(f"round({x}, 6) + 0e0 AS {n}{c}" for n, edge in zip("abc", t, strict=True) for c, x in zip("xyz", _cut(*edge), strict=True))
            parts.append(f"SELECT t, {k} AS k, {cols} FROM coded WHERE code = {m}")
    code = " + ".join(f"CASE WHEN s{p} < {fx.ISO} THEN {1 << i} ELSE 0 END" for i, p in enumerate("abcd"))
    return f"WITH coded AS (SELECT *, {code} AS code FROM tet_c) SELECT * FROM ({' UNION ALL '.join(parts)})"


@query(_marching_sql(), "tet_c")
def marching_tets(spark, sf):
    """The iso-surface of the tetrahedra"""
    t = iso.marching_tets(fx.tet_corners(spark, sf), fx.ISO)
    return t.select("t", "k", *[r6(p + c, p + c) for p in "abc" for c in "xyz"])


@query(
    f"WITH {_marching_sql().removeprefix('WITH ')}".replace("SELECT * FROM (SELECT t, 0", "SELECT count(*) AS n, count(DISTINCT t) AS tets, round(sum(round(" + AREA.replace("'", "") + ", 9)), 4) AS area FROM (SELECT t, 0", 1),
    "tet_c",
)
def marching_tets_summary(spark, sf):
    """Triangles, crossed tetrahedra and area"""
    t = iso.marching_tets(fx.tet_corners(spark, sf), fx.ISO).select("t", *[r6(p + c, p + c) for p in "abc" for c in "xyz"])
    return t.agg(F.count("*").alias("n"), F.countDistinct("t").alias("tets"), F.round(F.sum(F.round(g.area(A, B, C), 9)), 4).alias("area"))


@query(
    "WITH s AS (SELECT f, az AS s1, bz AS s2, cz AS s3, * FROM surf_t), c AS (SELECT *, CASE WHEN s1 < 4.00001 THEN 1 ELSE 0 END + CASE WHEN s2 < 4.00001 THEN 2 ELSE 0 END + CASE WHEN s3 < 4.00001 THEN 4 ELSE 0 END AS code FROM surf_t, (SELECT 1), LATERAL (SELECT az AS s1, bz AS s2, cz AS s3)) SELECT f, CASE WHEN code IN (1, 6) THEN 'a' WHEN code IN (2, 5) THEN 'b' ELSE 'c' END AS alone FROM c WHERE code BETWEEN 1 AND 6",
    "surf_t",
)
def marching_triangles(spark, sf):
    """Triangles of the height field that a level crosses, and the corner on its own side"""
    t = fx.surf_t(spark, sf).withColumns({p + "s": F.col(p + "z") for p in "abc"})
    s = iso.marching_triangles(t, 4.00001).select("f")
    code = sum(F.when(F.col(p + "z") < 4.00001, 1 << i).otherwise(0) for i, p in enumerate("abc"))
    return t.join(s, "f", "left_semi").select("f", F.when(code.isin(1, 6), "a").when(code.isin(2, 5), "b").otherwise("c").alias("alone"))


@query("SELECT q, count(*) AS n FROM (SELECT DISTINCT x + 1000 * y AS q, x, y, z FROM (SELECT ax AS x, ay AS y, az AS z FROM soup UNION ALL SELECT bx, by, bz FROM soup UNION ALL SELECT cx, cy, cz FROM soup)) GROUP BY q", "soup")
def distinct_points(spark, sf):
    """Points without duplicates"""
    t = fx.soup_f(spark, sf)
    p = t.select(F.explode(F.array(*[F.struct(*[F.col(n + c).alias(c) for c in "xyz"]) for n in "abc"])).alias("p")).select("p.*").dropDuplicates(["x", "y", "z"])
    return p.groupBy((F.col("x") + 1000 * F.col("y")).alias("q")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT kind, v, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r FROM mev) SELECT kind, min(n) AS n, CAST(sum(v * r) AS BIGINT) AS h FROM d GROUP BY kind", "mev")
def event_order(spark, sf):
    """Events in stream order, summed by kind"""
    e = fx.mev(spark, sf)
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("seq")))
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("r")).alias("h"))
