"""Queries over points, volumes, fields, graphs and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.functions import geometry as g
from meshspark.functions import scalars as sc
from meshspark.operators import blocks, field, graph, iso, mesh, mls, spatial, stats, volume
from meshspark.plans.registry import query, r6, s6

DIMS = (8, 8, 8)
D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"


# ---------------------------------------------------------------- points


def _queries(spark, sf):
    return fx.pts_big(spark, sf).select(F.col("id").alias("q"), "x", "y", "z")


@query(f"WITH q AS (SELECT * FROM pts_big), d AS (SELECT q.id AS q, p.id AS id, {D2} AS d2 FROM q JOIN pts_big p ON true), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY d2, id) AS INT) AS rank FROM d) SELECT q, rank, id, {s6('d2', 'd2')} FROM r WHERE rank <= 5", "pts_big")
def knn_join(spark, sf):
    """The five nearest points in order"""
    return spatial.knn(_queries(spark, sf), fx.pts_big(spark, sf), 5).select("q", "rank", "id", r6("d2", "d2"))


@query(f"WITH q AS (SELECT * FROM pts_big) SELECT q.id AS q, count(*) AS n, CAST(sum(p.id) AS BIGINT) AS total FROM q JOIN pts_big p ON {D2} <= 36 GROUP BY q.id", "pts_big")
def radius_join(spark, sf):
    """Points within a radius"""
    return blocks.ball_sums(_queries(spark, sf), fx.pts_big(spark, sf), 6.0)


@query(f"WITH q AS (SELECT id, x + 0.5 AS x, y + 0.5 AS y, z + 0.5 AS z FROM pts_big) SELECT q.id AS q, arg_min(p.id, ({D2}, p.id)) AS id FROM q JOIN pts_big p ON true GROUP BY q.id", "pts_big")
def nearest_point(spark, sf):
    """The nearest point"""
    q = _queries(spark, sf).select("q", *[(F.col(c) + 0.5).alias(c) for c in "xyz"])
    return spatial.nearest(q, fx.pts_big(spark, sf)).select("q", "id")


@query(f"WITH q AS (SELECT id, x, y, z FROM pts_big), d AS (SELECT q.id AS q, sqrt({D2}) AS d, row_number() OVER (PARTITION BY q.id ORDER BY {D2}, p.id) AS r FROM q JOIN pts_big p ON true) SELECT q AS id, {s6('d', 'radius')} FROM d WHERE r = 7", "pts_big")
def point_radii(spark, sf):
    """M1: distance to the sixth neighbour"""
    pts = fx.pts_big(spark, sf)
    q = _queries(spark, sf)
    return spatial.knn(q, pts, 7).filter("rank = 7").select(F.col("q").alias("id"), r6(F.sqrt("d2"), "radius"))


@query(f"WITH q AS (SELECT * FROM pts_big), n AS (SELECT q.id AS q, {D2} AS d2, p.x, p.y, p.z FROM q JOIN pts_big p ON {D2} < 144), w AS (SELECT *, (1 - 2 * (d2 / 144) + (d2 / 144) * (d2 / 144)) AS w FROM n) SELECT q, count(*) AS n, {', '.join(f'round(sum(round(w * {c}, 10)) / sum(round(w, 10)), 5) + 0e0 AS {c}' for c in 'xyz')} FROM w GROUP BY q", "pts_big")
def shepard_means(spark, sf):
    """M3, M4: weighted means"""
    s = mls.shepard(_queries(spark, sf), fx.pts_big(spark, sf), 12.0)
    return s.select("q", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH q AS (SELECT * FROM pts_big), n AS (SELECT q.id AS q, {D2} AS d2, p.x, p.y, p.z FROM q JOIN pts_big p ON {D2} < 144), w AS (SELECT *, (1 - 2 * (d2 / 144) + (d2 / 144) * (d2 / 144)) AS w FROM n), s AS (SELECT q, count(*) AS n, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * z) AS sz, sum(w * x * x) AS sxx, sum(w * x * z) AS sxz FROM w GROUP BY q) SELECT q, n, round(sx / w, 5) + 0e0 AS mx, round(sxx / w - sx / w * (sx / w), 4) + 0e0 AS cxx, round(sxz / w - sx / w * (sz / w), 4) + 0e0 AS cxz FROM s", "pts_big")
def weighted_moments(spark, sf):
    """M5, M6: moments for plane fits"""
    m = mls.moments(_queries(spark, sf), fx.pts_big(spark, sf), 12.0)
    return m.select("q", "n", (F.round("mx", 5) + 0.0).alias("mx"), (F.round("cxx", 4) + 0.0).alias("cxx"), (F.round("cxz", 4) + 0.0).alias("cxz"))


@query()
def plane_fits(spark, sf):
    """Plane normals at points"""
    return mls.normals(fx.pts_big(spark, sf), 12.0)


@query()
def projected_points(spark, sf):
    """Projection to a local quadric, curvatures and ideal lengths"""
    return mls.curvature_lengths(mls.project(_queries(spark, sf), fx.pts_big(spark, sf), 15.0), 0.5, 0.1, 5.0)


_STEP = "1 + (id % 97) / 10.0::DOUBLE"


@query(f"WITH f AS (SELECT *, {_STEP} AS step FROM pts_big) SELECT q.id AS id, round(q.step, 6) AS step FROM f q WHERE NOT EXISTS (SELECT 1 FROM f p WHERE p.step + 0.2 * sqrt({D2}) < q.step)", "pts_big")
def guidance_trim(spark, sf):
    """Field points that no other dominates"""
    f = fx.pts_big(spark, sf).withColumn("step", 1 + (F.col("id") % 97) / F.lit(10.0))
    return field.trim(f, 0.8).select("id", F.round("step", 6).alias("step"))


@query(f"WITH q AS (SELECT * FROM pts_big), f AS (SELECT *, {_STEP} AS ideal FROM pts_big) SELECT q.id AS q, round(greatest(0.5, least(4.0, min(0.2 * sqrt({D2}) + 0.8 * ideal))), 6) + 0e0 AS step FROM q JOIN f p ON true GROUP BY q.id", "pts_big")
def step_lengths(spark, sf):
    """A2: least step over the field"""
    q = fx.pts_big(spark, sf).select(F.col("id").alias("q"), "x", "y", "z")
    f = fx.pts_big(spark, sf).withColumn("ideal", 1 + (F.col("id") % 97) / F.lit(10.0))
    return field.step_lengths(q, f, 0.8, 0.5, 4.0).select("q", r6("step", "step"))


@query("WITH p AS (SELECT id, 3.5 + 0.9 * x AS x, 3.5 + 0.9 * y AS y, 3.5 + 0.9 * z AS z FROM pts), n AS (SELECT id, x, y, z, CAST(floor(x) AS INT) AS cx, CAST(floor(y) AS INT) AS cy, CAST(floor(z) AS INT) AS cz, x - floor(x) AS u, y - floor(y) AS v, z - floor(z) AS w FROM p WHERE x > 0 AND x < 7 AND y > 0 AND y < 7 AND z > 0 AND z < 7) SELECT id, 6 * (cx + 7 * cy + 49 * cz) + CASE WHEN u >= v AND v >= w THEN 0 WHEN u >= w AND w >= v THEN 1 WHEN v >= u AND u >= w THEN 2 WHEN v >= w AND w >= u THEN 3 WHEN w >= u AND u >= v THEN 4 ELSE 5 END AS t FROM n", "pts")
def points_in_tets(spark, sf):
    """The tetrahedron of each point"""
    p = fx.pts(spark, sf).select("id", *[(3.5 + 0.9 * F.col(c)).alias(c) for c in "xyz"])
    p = p.filter("x > 0 and x < 7 and y > 0 and y < 7 and z > 0 and z < 7")
    t = fx.tet_corners(spark, sf).select("t", *[n + c for n in "abcd" for c in "xyz"])
    return spatial.in_tets(p, t, 1.0)


@query("SELECT id, CAST(floor(x * 4) AS BIGINT) AS cx, round(x * 4 - floor(x * 4), 6) + 0e0 AS u FROM pts", "pts")
def cell_of_point(spark, sf):
    """Cells and inner places"""
    c = F.floor(F.col("x") * 4)
    return fx.pts(spark, sf).select("id", c.alias("cx"), r6(F.col("x") * 4 - c, "u"))


@query("WITH b AS (SELECT min(x) AS l, max(x) - min(x) AS w FROM pts) SELECT id, CAST(greatest(0, least(1023, floor((x - l) * 1022 / w + 0.5))) AS INT) AS q, round(l + greatest(0, least(1023, floor((x - l) * 1022 / w + 0.5))) * w / 1022, 6) + 0e0 AS back FROM pts, b", "pts")
def quantized(spark, sf):
    """Quantized coordinates and back"""
    p = fx.pts(spark, sf)
    b = F.broadcast(p.agg(F.min("x").alias("l"), (F.max("x") - F.min("x")).alias("w")))
    q = g.quantize(F.col("x"), F.col("l"), F.col("w"), 10)
    return p.crossJoin(b).select("id", q.alias("q"), r6(g.dequantize(q, F.col("l"), F.col("w"), 10), "back"))


_SPREAD = " + ".join(f"((({c}::BIGINT >> {k}) & 1) << {3 * k + a})" for k in range(4) for a, c in enumerate("xyz"))


@query(f"SELECT x, y, z, CAST({_SPREAD} AS BIGINT) AS m FROM vox", "vox")
def morton_codes(spark, sf):
    """Morton codes of cells"""
    return fx.vox(spark, sf).select("x", "y", "z", g.morton(F.col("x"), F.col("y"), F.col("z"), 4).alias("m"))


@query("SELECT x, y, z FROM vox", "vox")
def morton_round_trip(spark, sf):
    """Cells from their codes"""
    m = fx.vox(spark, sf).select(g.morton(F.col("x"), F.col("y"), F.col("z"), 4).alias("m"))
    return m.select(*[g.unmorton(F.col("m"), a, 4).cast("int").alias(c) for a, c in enumerate("xyz")])


@query("SELECT id, round(sqrt(x * x + y * y + z * z), 6) + 0e0 AS r, round(acos(z / sqrt(x * x + y * y + z * z)), 6) + 0e0 AS theta, round(atan2(y, x), 6) + 0e0 AS phi FROM pts", "pts")
def spherical(spark, sf):
    """Spherical coordinates"""
    n = g.norm(g.vec())
    return fx.pts(spark, sf).select("id", r6(n, "r"), r6(F.acos(F.col("z") / n), "theta"), r6(F.atan2("y", "x"), "phi"))


@query("SELECT id, round(0.8 * x - 0.6 * y + 1, 6) + 0e0 AS x, round(0.6 * x + 0.8 * y - 2, 6) + 0e0 AS y, round(2 * z, 6) + 0e0 AS z FROM pts", "pts")
def affine(spark, sf):
    """An affine map"""
    x, y, z = g.vec()
    return fx.pts(spark, sf).select("id", r6(0.8 * x - 0.6 * y + 1, "x"), r6(0.6 * x + 0.8 * y - 2, "y"), r6(2 * z, "z"))


@query("SELECT id, round(sqrt((x - t) * (x - t) + (y - t) * (y - t) + (z - t) * (z - t)), 6) + 0e0 AS d FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x + y + z) / 3)) AS t FROM pts)", "pts")
def segment_distance(spark, sf):
    """Distance to the segment from 0 to (1, 1, 1)"""
    zero, one = tuple(F.lit(0.0) for _ in "xyz"), tuple(F.lit(1.0) for _ in "xyz")
    return fx.pts(spark, sf).select("id", r6(g.segment_distance(g.vec(), zero, one), "d"))


@query("SELECT id, round(x - z * 0 , 6) + 0e0 AS x, round(abs(z - 0.25), 6) + 0e0 AS d, z > 0.25 AS above FROM pts", "pts")
def plane_tests(spark, sf):
    """Foot point on, distance to and side of a plane"""
    return fx.pts(spark, sf).select("id", r6("x", "x"), r6(F.abs(F.col("z") - 0.25), "d"), (F.col("z") > 0.25).alias("above"))


@query("SELECT id, CASE WHEN abs(x) <= 0.5 AND abs(y) <= 0.5 AND abs(z) <= 0.5 THEN 'in' ELSE 'out' END AS side FROM pts", "pts")
def box_contains(spark, sf):
    """P5: points in a box"""
    inside = F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) <= 0.5
    return fx.pts(spark, sf).select("id", F.when(inside, "in").otherwise("out").alias("side"))


@query("SELECT id, 2 * (y + 1) - 2 * (x + 1) > 0 AS left_turn FROM pts", "pts")
def left_turns(spark, sf):
    """Side of a plane line"""
    turn = g.left_turn(F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0), F.col("x"), F.col("y"))
    return fx.pts(spark, sf).select("id", (turn > 0).alias("left_turn"))


# ---------------------------------------------------------------- statistics


@query("SELECT label, count(*) AS n, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(sum(round(x, 9)) / count(*), 6) + 0e0 AS mean FROM pts GROUP BY label", "pts")
def boxes_and_centroids(spark, sf):
    """Ranges and means by label"""
    return fx.pts(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("lo"), F.round(F.max("x"), 6).alias("hi"), r6(F.sum(F.round("x", 9)) / F.count("*"), "mean"))


@query("SELECT label, list_sort(list(x))[count(*) // 2 + 1] AS median FROM pts GROUP BY label", "pts")
def upper_medians(spark, sf):
    """Upper medians"""
    return fx.pts(spark, sf).groupBy("label").agg(stats.upper_median("x").alias("median"))


@query("SELECT list_sort(list(x))[count(*) // 2 + 1] AS median FROM pts_big", "pts_big")
def global_upper_median(spark, sf):
    """The upper median of all, by running counts"""
    return stats.exact_upper_median(fx.pts_big(spark, sf), "x")


@query("SELECT label, round(CAST(sum(l) AS DOUBLE) / (count(*) - 1), 6) AS mean, round((count(*) * CAST(sum(l * l) AS DOUBLE) - CAST(sum(l) AS DOUBLE) * CAST(sum(l) AS DOUBLE)) / (count(*) * (count(*) - 1.0::DOUBLE)), 6) AS var FROM (SELECT l_linenumber AS label, CAST(l_quantity AS BIGINT) AS l FROM lineitem) GROUP BY label")
def means_and_variances(spark, sf):
    """A10: mean and variance with a lost degree of freedom"""
    t = fx.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("label"), F.col("l_quantity").cast("long").cast("double").alias("l"))
    return t.groupBy("label").agg(F.round(stats.mean(F.col("l"), 1), 6).alias("mean"), F.round(stats.variance("l", 1), 6).alias("var"))


@query("WITH h AS (SELECT CAST(greatest(0, least(19, floor((x + 2) * 20 / 4))) AS INT) AS bin, count(*) AS n FROM pts GROUP BY 1), e AS (SELECT CAST(i AS INT) AS bin FROM range(20) r(i)), f AS (SELECT e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN h ON h.bin = e.bin) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum FROM f", "pts")
def histogram(spark, sf):
    """A histogram with fixed ends"""
    return mesh.histogram(fx.pts(spark, sf), "x", 20, -2.0, 2.0)


@query("SELECT label, arg_max(id, (x, -id)) AS most, arg_min(id, (x, id)) AS least FROM pts GROUP BY label", "pts")
def extreme_places(spark, sf):
    """Where the greatest and least values are"""
    most = F.max(F.struct("x", (-F.col("id")).alias("i")))
    least = F.min(F.struct("x", "id"))
    return fx.pts(spark, sf).groupBy("label").agg((-most["i"]).alias("most"), least["id"].alias("least"))


@query("SELECT label, id, r FROM (SELECT label, id, CAST(row_number() OVER (PARTITION BY label ORDER BY x DESC, id) AS INT) AS r FROM pts) WHERE r <= 2", "pts")
def top_two(spark, sf):
    """The two greatest values of each label"""
    return stats.top2(fx.pts(spark, sf), ["label"], "x", "id").select("label", "id", "r")


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM img), i AS (SELECT u, v, CAST(greatest(0, least(31, floor((value - lo) * 32 / (hi - lo)))) AS INT) AS bin FROM img, b), h AS (SELECT bin, count(*) AS n FROM i GROUP BY bin), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / (SELECT count(*) FROM img)::DOUBLE AS level FROM h) SELECT u, v, bin, round(level, 6) AS level FROM i JOIN c USING (bin)", "img")
def equalized_image(spark, sf):
    """Histogram equalization"""
    return stats.equalize(fx.img(spark, sf), "value", 32).select("u", "v", "bin", F.round("level", 6).alias("level"))


@query("SELECT a.u AS u, round(a.value + 2 * b.value, 4) AS value FROM img a JOIN img b ON a.u = b.u AND a.v = 'click' AND b.v = 'view'", "img")
def image_arithmetic(spark, sf):
    """pixel-wise sums of two channels"""
    i = fx.img(spark, sf)
    a, b = i.filter("v = 'click'").select("u", "value"), i.filter("v = 'view'").select("u", F.col("value").alias("w"))
    return a.join(b, "u").select("u", F.round(F.col("value") + 2 * F.col("w"), 4).alias("value"))


# ---------------------------------------------------------------- volumes

_NEAR = "SELECT v.x, v.y, v.z, dx, dy, dz, n.value FROM vox v, (SELECT CAST(i - {w} AS INT) AS dx FROM range({m}) a(i)), (SELECT CAST(i - {w} AS INT) AS dy FROM range({m}) b(i)), (SELECT CAST(i - {w} AS INT) AS dz FROM range({m}) c(i)), vox n WHERE n.x = least(7, greatest(0, v.x + dx)) AND n.y = least(7, greatest(0, v.y + dy)) AND n.z = least(7, greatest(0, v.z + dz))"


@query(f"WITH n AS ({_NEAR.format(w=1, m=4)}) SELECT x, y, z, count(*) AS n, round(sum(round(value, 9)), 5) AS s FROM n GROUP BY x, y, z", "vox")
def neighbourhood_gather(spark, sf):
    """The 64 neighbours of each cell"""
    return volume.gather(fx.vox(spark, sf), -1, 2, DIMS).groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.round(F.sum(F.round("value", 9)), 5).alias("s"))


@query(f"WITH n AS ({_NEAR.format(w=1, m=3)}) SELECT x, y, z, {s6('sum(round(value, 9)) / count(*)', 'value')} FROM n GROUP BY x, y, z", "vox")
def box_filter(spark, sf):
    """Means over 27 cells"""
    return volume.box_filter(fx.vox(spark, sf), 1, DIMS).select("x", "y", "z", r6("value", "value"))


_CORNER8 = "SELECT a.x, a.y, a.z, " + ", ".join(f"c{k}.value AS c{k}" for k in range(8)) + " FROM vox a " + " ".join(f"JOIN vox c{k} ON c{k}.x = a.x + {k & 1} AND c{k}.y = a.y + {k >> 1 & 1} AND c{k}.z = a.z + {k >> 2}" for k in range(8))
_EIGHT = ", ".join(f"c{k}" for k in range(8))


@query(f"WITH c AS ({_CORNER8}) SELECT x, y, z, round(least({_EIGHT}), 6) AS low, round(greatest({_EIGHT}), 6) AS high FROM c WHERE least({_EIGHT}) < {fx.ISO} AND greatest({_EIGHT}) >= {fx.ISO}", "vox")
def spanning_cells(spark, sf):
    """Cells that span the value"""
    return volume.spanning(fx.vox(spark, sf), fx.ISO).select("x", "y", "z", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT x // 4 AS bx, y // 4 AS by, z // 4 AS bz, round(min(value), 6) AS low, round(max(value), 6) AS high FROM vox16 GROUP BY ALL", "vox16")
def zone_map(spark, sf):
    """Ranges of blocks"""
    return volume.zone_map(fx.vox16(spark, sf), 4).select("bx", "by", "bz", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH e AS (SELECT a.x, a.y, a.z, 0 AS axis, a.value AS p, b.value AS q FROM vox a JOIN vox b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z UNION ALL SELECT a.x, a.y, a.z, 1, a.value, b.value FROM vox a JOIN vox b ON b.x = a.x AND b.y = a.y + 1 AND b.z = a.z UNION ALL SELECT a.x, a.y, a.z, 2, a.value, b.value FROM vox a JOIN vox b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1) SELECT x, y, z, axis, round(({fx.ISO} - p) / (q - p), 6) AS t FROM e WHERE (p < {fx.ISO}) <> (q < {fx.ISO})", "vox")
def edge_crossings(spark, sf):
    """Grid edges that cross the value"""
    e = volume.crossings(fx.vox(spark, sf), fx.ISO)
    t = (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) + (F.col("pz") - F.col("z"))
    return e.select("x", "y", "z", "axis", F.round(t, 6).alias("t"))


@query()
def marching_cubes(spark, sf):
    """The iso-surface of the volume's cells, corners welded by edge id"""
    c = volume.cell_corners(fx.vox(spark, sf))
    t = iso.marching_cubes(c, fx.ISO)
    return t.select("x", "y", "z", "k", "e0", "e1", "e2", *[r6(p + a, p + a) for p in "abc" for a in "xyz"])


@query(f"WITH c AS ({_CORNER8}), k AS (SELECT {' + '.join(f'CASE WHEN c{i} < {fx.ISO} THEN {1 << i} ELSE 0 END' for i in range(8))} AS code FROM c) SELECT count(*) AS cells, count(DISTINCT code) AS codes FROM k WHERE code > 0 AND code < 255", "vox")
def marching_cubes_cells(spark, sf):
    """Crossed cells and sign patterns"""
    c = volume.cell_corners(fx.vox(spark, sf))
    code = sum(F.when(F.col(f"c{i}") < fx.ISO, 1 << i).otherwise(0) for i in range(8))
    return c.select(code.alias("code")).filter("code > 0 and code < 255").agg(F.count("*").alias("cells"), F.countDistinct("code").alias("codes"))


@query("SELECT count(*) AS n FROM vox16 WHERE value <> 0", "vox16")
def nonzero_voxels(spark, sf):
    """A6"""
    return fx.vox16(spark, sf).filter("value <> 0").agg(F.count("*").alias("n"))


_SPLINE = " * ".join(f"(CASE d{c} WHEN -1 THEN {w[0]!r} WHEN 0 THEN {w[1]!r} WHEN 1 THEN {w[2]!r} ELSE {w[3]!r} END)::DOUBLE" for c, w in zip("xyz", [volume.spline_weights(t) for t in (0.25, 0.5, 0.75)], strict=True))


@query(f"WITH n AS ({_NEAR.format(w=1, m=4)}) SELECT x, y, z, round(sum(round({_SPLINE} * value, 10)), 5) + 0e0 AS value FROM n WHERE x < 7 AND y < 7 AND z < 7 GROUP BY x, y, z", "vox")
def tricubic_values(spark, sf):
    """Tri-cubic spline values in cells"""
    s = volume.spline_values(fx.vox(spark, sf), DIMS, (0.25, 0.5, 0.75))
    return s.select("x", "y", "z", (F.round("value", 5) + 0.0).alias("value"))


_SEGNEAR = "SELECT v.x, v.y, v.z, n.mat AS own FROM segm v, (SELECT CAST(i - 1 AS INT) AS dx FROM range(3) a(i)), (SELECT CAST(i - 1 AS INT) AS dy FROM range(3) b(i)), (SELECT CAST(i - 1 AS INT) AS dz FROM range(3) c(i)), segm n WHERE n.x = least(7, greatest(0, v.x + dx)) AND n.y = least(7, greatest(0, v.y + dy)) AND n.z = least(7, greatest(0, v.z + dz))"
_FIELDS = f"n AS ({_SEGNEAR}), f AS (SELECT x, y, z, mat, CAST(count(*) FILTER (own = mat) AS DOUBLE) / count(*) AS p FROM n, (SELECT CAST(i AS INT) AS mat FROM range(3) r(i)) GROUP BY x, y, z, mat)"


@query(f"WITH {_FIELDS} SELECT x, y, z, mat, {s6('p', 'p')} FROM f", "segm")
def material_fields(spark, sf):
    """Smoothed material indicators"""
    return volume.material_fields(fx.segm(spark, sf), 3, DIMS).select("x", "y", "z", "mat", r6("p", "p"))


@query(f"WITH {_FIELDS} SELECT x, y, z, arg_max(mat, (p, -mat)) AS mat FROM f GROUP BY x, y, z", "segm")
def dominant_material(spark, sf):
    """The strongest material"""
    return volume.dominant(volume.material_fields(fx.segm(spark, sf), 3, DIMS))


@query(f"WITH {_FIELDS} SELECT a.x, a.y, a.z, a.mat, round(a.p - max(b.p), 6) + 0e0 AS value FROM f a JOIN f b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.mat <> b.mat GROUP BY a.x, a.y, a.z, a.mat, a.p", "segm")
def material_against_others(spark, sf):
    """Each material minus the strongest other"""
    f = volume.against_others(volume.material_fields(fx.segm(spark, sf), 3, DIMS))
    return f.select("x", "y", "z", "mat", r6("value", "value"))


@query("SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, round(value, 6) AS value FROM vox WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0", "vox")
def strided_volume(spark, sf):
    """Every other cell"""
    v = fx.vox(spark, sf).filter("x % 2 = 0 and y % 2 = 0 and z % 2 = 0")
    return v.select(*[F.expr(f"cast({c} div 2 as int)").alias(c) for c in "xyz"], F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- graphs

_LOW = "SELECT x + 8 * y + 64 * z AS v, x, y, z FROM vox WHERE value < 4"
_LINKS = "SELECT p.v AS a, q.v AS b FROM low p JOIN low q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1"


def _low_graph(spark, sf):
    """Cells below 4 and the edges between neighbours."""
    v = fx.vox(spark, sf).filter("value < 4").select((F.col("x") + 8 * F.col("y") + 64 * F.col("z")).alias("v"), "x", "y", "z")
    out = None
    for c, s in zip("xyz", (1, 8, 64), strict=True):
        e = v.filter(F.col(c) < 7).select(F.col("v").alias("a"), (F.col("v") + s).alias("b")).join(v.select(F.col("v").alias("b")), "b", "left_semi").select("a", "b")
        out = e if out is None else out.union(e)
    return v, out


@query(f"WITH RECURSIVE low AS ({_LOW}), e AS ({_LINKS}), r AS (SELECT DISTINCT a AS v, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v) SELECT v, min(root) AS root FROM r GROUP BY v", "vox")
def connected_components(spark, sf):
    """Components of the cells below a value"""
    return graph.components(_low_graph(spark, sf)[1])


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM edges UNION SELECT b, a FROM edges)), r AS (SELECT 0 AS v, 0 AS hop UNION SELECT e.b, r.hop + 1 FROM r JOIN e ON e.a = r.v WHERE r.hop < 4) SELECT v, min(hop) AS hop FROM r GROUP BY v", "edges")
def bounded_hops(spark, sf):
    """Vertices within four edges"""
    e = mesh.halfedges(fx.surf_f(spark)).select("a", "b")
    return graph.hops(e, spark.range(1).select(F.lit(0).alias("v")), 4)


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM edges UNION SELECT b, a FROM edges)), r AS (SELECT unnest([0, 63]) AS v, unnest([1, 2]) AS label, 0 AS hop UNION SELECT e.b, r.label, r.hop + 1 FROM r JOIN e ON e.a = r.v WHERE r.hop < 20) SELECT v, arg_min(label, (hop, label)) AS label FROM r GROUP BY v", "edges")
def label_flood(spark, sf):
    """C4: labels spread from two corners"""
    e = mesh.halfedges(fx.surf_f(spark)).select("a", "b")
    return graph.flood(e, spark.createDataFrame([(0, 1), (63, 2)], "v int, label int"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b, CASE WHEN abs(a - b) = 9 THEN 3 ELSE 2 END AS len FROM (SELECT a, b FROM edges UNION SELECT b, a FROM edges)), r AS (SELECT 0 AS v, 0 AS d UNION SELECT e.b, r.d + e.len FROM r JOIN e ON e.a = r.v WHERE r.d + e.len <= 12) SELECT v, CAST(min(d) AS DOUBLE) AS d FROM r GROUP BY v", "edges")
def bounded_distances(spark, sf):
    """Shortest paths up to a length"""
    e = mesh.halfedges(fx.surf_f(spark)).select("a", "b").withColumn("len", F.when(F.abs(F.col("a") - F.col("b")) == 9, 3.0).otherwise(2.0))
    return graph.distances(e, spark.range(1).select(F.lit(0).alias("v")), 12.0)


@query("SELECT f, i, a, b FROM edges WHERE (a < 32) <> (b < 32)", "edges")
def label_fronts(spark, sf):
    """Edges between vertices of different sides"""
    return mesh.halfedges(fx.surf_f(spark)).filter("(a < 32) <> (b < 32)").select("f", "i", "a", "b")


@query("WITH RECURSIVE e AS (SELECT a, b FROM edges x WHERE NOT EXISTS (SELECT 1 FROM edges y WHERE y.a = x.b AND y.b = x.a)), r AS (SELECT DISTINCT a AS v, a AS root FROM e UNION SELECT CASE WHEN e.a = r.v THEN e.b ELSE e.a END, r.root FROM r JOIN e ON e.a = r.v OR e.b = r.v), l AS (SELECT v, min(root) AS loop FROM r GROUP BY v) SELECT loop, count(*) AS n FROM l GROUP BY loop", "edges")
def border_loops(spark, sf):
    """Loops of border edges"""
    b = mesh.border_edges(fx.surf_f(spark)).select("a", "b")
    return graph.components(b).groupBy(F.col("root").alias("loop")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- octrees


@query("WITH c AS (SELECT CAST(greatest(0, least(7, floor((x + 2) * 2))) AS BIGINT) AS x, CAST(greatest(0, least(7, floor((y + 2) * 2))) AS BIGINT) AS y, CAST(greatest(0, least(7, floor((z + 2) * 2))) AS BIGINT) AS z FROM pts), m AS (SELECT " + " + ".join(f"((({c} >> {k}) & 1) << {3 * k + a})" for k in range(3) for a, c in enumerate("xyz")) + " AS m FROM c), n AS (SELECT d, CAST(m >> (3 * (3 - d)) AS BIGINT) AS code, count(*) AS n FROM m, (SELECT CAST(i AS INT) AS d FROM range(4) r(i)) GROUP BY 1, 2) SELECT d AS depth, code, n FROM n a WHERE (n <= 20 OR d = 3) AND NOT EXISTS (SELECT 1 FROM n p WHERE p.d < a.d AND p.n <= 20 AND (a.code >> (3 * (a.d - p.d))) = p.code)", "pts")
def octree_leaves(spark, sf):
    """Leaves of an octree that splits above twenty points"""
    p = fx.pts(spark, sf).select(*[sc.clamp(F.floor((F.col(c) + 2) * 2), 0, 7).alias(c) for c in "xyz"])
    m = p.select(g.morton(F.col("x"), F.col("y"), F.col("z"), 3).alias("m"))
    leaves = None
    for d in range(4):
        code = F.shiftright("m", 3 * (3 - d))
        n = m.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
        full = n if d == 3 else n.filter("n <= 20")
        leaf = full.select(F.lit(d).alias("depth"), "code", "n")
        leaves = leaf if leaves is None else leaves.union(leaf)
        m = m.withColumn("code", code).join(full.select("code"), "code", "left_anti").select("m")
    return leaves


# ---------------------------------------------------------------- scalars


@query("SELECT p_partkey AS id, greatest(10, least(40, p_size)) AS c, CASE WHEN p_size <= 0 THEN 0 ELSE length(bin(p_size)) END AS bits, CAST(2 ** length(bin(p_size)) AS BIGINT) AS up, CAST(p_size AS BIGINT) * (p_size - 1) * (p_size - 2) AS fall, CAST(p_size AS BIGINT) * (p_size - 1) * (p_size - 2) // 6 AS ch FROM part")
def integer_functions(spark, sf):
    """clamps, bit lengths, falling factorials, choose"""
    s = F.col("p_size")
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sc.clamp(s, 10, 40).alias("c"), sc.bit_length(s).alias("bits"), sc.round_up_to_power(s).alias("up"), sc.falling(s, 3).alias("fall"), sc.choose(s, 3).alias("ch"))


@query("SELECT id, round(1 + 2 * x + 3 * x * x + 4 * x * x * x, 5) + 0e0 AS p, round(CASE WHEN x * x < 1 THEN 1 - 2 * x * x + x * x * x * x ELSE 0 END, 6) + 0e0 AS w, CASE WHEN x * x - 4 * y < 0 THEN 0 ELSE 2 END AS roots FROM pts", "pts")
def polynomials(spark, sf):
    """Polynomials, decay, number of real roots"""
    x = F.col("x")
    roots = sc.quadratic_roots(F.lit(1.0), x, F.col("y"))
    return fx.pts(spark, sf).select("id", (F.round(sc.poly(x, 1, 2, 3, 4), 5) + 0.0).alias("p"), r6(mls.bounded4(x * x, 1.0), "w"), F.size(roots).alias("roots"))


@query("SELECT id, round(least(x, y) * 2 - 1, 6) + 0e0 AS a, round(greatest(x, y) * 2 + 1, 6) + 0e0 AS b, round(CASE WHEN least(x, y) <= 0 AND greatest(x, y) >= 0 THEN 0 ELSE least(x * x, y * y) END, 6) + 0e0 AS s, round(greatest(x * x, y * y), 6) + 0e0 AS t, greatest(x, y) < 0.1 OR least(x, y) > 0.1 AS out FROM pts", "pts")
def interval_arithmetic(spark, sf):
    """Sums, squares and exclusion by intervals"""
    i = sc.interval(F.least("x", "y"), F.greatest("x", "y"))
    twice = sc.i_add(sc.i_add(i, i), sc.interval(F.lit(-1.0), F.lit(1.0)))
    sq = sc.i_square(i)
    return fx.pts(spark, sf).select("id", r6(twice["min"], "a"), r6(twice["max"], "b"), r6(sq["min"], "s"), r6(sq["max"], "t"), sc.i_excludes(i, 0.1).alias("out"))


@query("SELECT p_partkey AS id, replace(p_name, ' ', '_') AS base, 'off' AS ext FROM part")
def file_names(spark, sf):
    """Base names and suffixes"""
    n = F.concat(F.lit("/data/x.y/"), F.translate("p_name", " ", "_"), F.lit(".off"))
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sc.base_name(n).alias("base"), sc.extension(n).alias("ext"))


@query("SELECT id, abs(x - y) < 0.05 AS equal, x < y - 0.05 AS less FROM pts", "pts")
def epsilon_comparisons(spark, sf):
    """Comparisons with a tolerance"""
    x, y = F.col("x"), F.col("y")
    return fx.pts(spark, sf).select("id", (F.abs(x - y) < 0.05).alias("equal"), (x < y - 0.05).alias("less"))


@query("SELECT id, label FROM pts WHERE label NOT IN (SELECT label FROM pts WHERE id < 3)", "pts")
def erased_points(spark, sf):
    """Rows without those listed"""
    p = fx.pts(spark, sf)
    return p.join(p.filter("id < 3").select("label"), "label", "left_anti").select("id", "label")


@query("SELECT label, id, CAST(row_number() OVER (PARTITION BY label ORDER BY y, id) AS INT) AS place FROM pts", "pts")
def sorted_views(spark, sf):
    """Points in the order of a coordinate"""
    return fx.pts(spark, sf).select("label", "id", F.row_number().over(Window.partitionBy("label").orderBy("y", "id")).alias("place"))
