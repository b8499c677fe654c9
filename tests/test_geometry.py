"""Analytic shapes: regular tetrahedra, cubes, spheres, planes; and kernels against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions import geometry as g
from meshspark.functions import scalars as sc
from meshspark.operators import field, graph, iso, mesh, mls, spatial, stats, volume


def tri(spark, rows):
    return spark.createDataFrame([(i, *range(3), *[float(x) for p in r for x in p]) for i, r in enumerate(rows)], "f int, v0 int, v1 int, v2 int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))


def cube(spark, shift=0.0, first=0):
    """Surface of a unit cube: 8 vertices, 12 faces, outward."""
    v = [(first + k, (k & 1) + shift, float(k >> 1 & 1), float(k >> 2)) for k in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    return spark.createDataFrame([(i, float(x), y, z) for i, x, y, z in v], "v int, x double, y double, z double"), spark.createDataFrame([(first + i, *[first + x for x in t]) for i, t in enumerate(f)], "f int, v0 int, v1 int, v2 int")


def with_corners(faces, verts):
    from meshspark.fixtures import corners

    return corners(faces, verts)


def test_triangles(spark):
    h = math.sqrt(3) / 2
    t = tri(spark, [[(0, 0, 0), (1, 0, 0), (0.5, h, 0)], [(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0, 0, 0), (3, 0, 0), (0, 4, 0)]])
    q = {r["f"]: r for r in mesh.quality(t).collect()}
    assert q[0]["q"] == pytest.approx(1) and q[1]["q"] == 0 and q[1]["circumradius"] == 1
    assert q[2]["circumradius"] == pytest.approx(2.5) and q[2]["inradius"] == pytest.approx(1)
    m = {r["f"]: r["imr"] for r in mesh.inverse_mean_ratio(t).collect()}
    assert m[0] == pytest.approx(1) and m[1] == 0
    assert {r["f"] for r in mesh.without_poor(t, 1.1).collect()} == {0, 1}


def test_distance_to_a_triangle(spark):
    t = tri(spark, [[(0, 0, 0), (1, 0, 0), (0, 1, 0)]])
    rng = np.random.default_rng(1)
    pts = rng.uniform(-1, 2, (40, 3))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "id int, x double, y double, z double")
    got = {r["id"]: r["d"] for r in t.crossJoin(p).select("id", g.triangle_distance2(g.vec(), *[g.vec(c) for c in "abc"]).alias("d")).collect()}
    u = np.linspace(0, 1, 201)
    grid = np.array([(a, b, 0) for a in u for b in u if a + b <= 1 + 1e-12])
    for i, x in enumerate(pts):
        assert got[i] == pytest.approx(((grid - x) ** 2).sum(axis=1).min(), abs=2e-2)


def test_rays(spark):
    t = tri(spark, [[(0, 0, 1), (1, 0, 1), (0, 1, 1)]])
    o, d = (F.lit(0.2), F.lit(0.2), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(2.0))
    hit = t.select(g.ray_triangle(o, d, *[g.vec(c) for c in "abc"]).alias("t")).first()["t"]
    assert hit == pytest.approx(0.5)


def test_tetrahedra(spark):
    s = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    row = [tuple(float(x) for p in s for x in p)]
    t = spark.createDataFrame(row, ", ".join(f"{p}{c} double" for p in "abcd" for c in "xyz"))
    p = [g.vec(c) for c in "abcd"]
    centre = tuple(F.lit(0.0) for _ in "xyz")
    r = t.select(g.tet_radius_ratio(*p).alias("r"), g.in_tet(centre, *p).alias("i"), *[b.alias(f"b{k}") for k, b in enumerate(g.tet_barycentric(centre, *p))]).first()
    assert r["r"] == pytest.approx(1 / 3) and r["i"] and [r[f"b{k}"] for k in range(4)] == pytest.approx([0.25] * 4)


def test_cube_mesh(spark):
    v, f = cube(spark)
    i = mesh.info(with_corners(f, v), v).first()
    assert (i["n_verts"], i["n_edges"], i["n_faces"], i["n_border"], i["euler"]) == (8, 18, 12, 0, 2)
    assert i["least_angle"] == pytest.approx(45) and i["greatest_angle"] == pytest.approx(90)
    n = {r["v"]: (r["nx"], r["ny"], r["nz"]) for r in mesh.vertex_normals(with_corners(f, v), weighted=True).collect()}
    assert all(x * (2 * (k >> a & 1) - 1) > 0 for k, nn in n.items() for a, x in enumerate(nn))
    assert mesh.creases(with_corners(f, v), 0.5).count() == 12 and mesh.kinks(mesh.creases(with_corners(f, v), 0.5)).count() == 8
    assert mesh.border_vertices(f).count() == 0
    v2, f2 = mesh.subdivide(f, v)
    assert (v2.count(), f2.count()) == (8 + 18, 48)
    assert mesh.border_edges(f2).count() == 0


def test_two_cubes(spark):
    v, f = cube(spark)
    w, h = cube(spark, 5.0)
    ff, vv = mesh.merge([f, h], [v, w])
    e = mesh.halfedges(ff).select("a", "b")
    c = graph.components(e)
    assert {(r["root"], r["count"]) for r in c.groupBy("root").count().collect()} == {(0, 8), (8, 8)}
    assert graph.flood(e, spark.createDataFrame([(0, 7)], "v int, label int")).count() == 8
    assert mesh.flip(mesh.flip(ff)).exceptAll(ff.select("f", "v0", "v1", "v2")).count() == 0


def grid(spark, n, f):
    rows = [(x, y, z, float(f(x, y, z))) for x in range(n) for y in range(n) for z in range(n)]
    return spark.createDataFrame(rows, "x int, y int, z int, value double")


def closed(tris):
    e = [(t[i], t[(i + 1) % 3]) for t in tris for i in range(3)]
    return len(e) == len(set(e)) and {(b, a) for a, b in e} == set(e)


def test_marching_cubes_of_a_sphere_and_a_torus(spark):
    r = 5.03
    sphere = grid(spark, 17, lambda x, y, z: math.sqrt((x - 8) ** 2 + (y - 8) ** 2 + (z - 8) ** 2) - r)
    torus = grid(spark, 17, lambda x, y, z: math.sqrt((math.sqrt((x - 8) ** 2 + (y - 8) ** 2) - 5.02) ** 2 + (z - 8) ** 2) - 2.03)
    for vox, euler, area, tolerance in ((sphere, 2, 4 * math.pi * r * r, 0.02), (torus, 0, 4 * math.pi**2 * 5.02 * 2.03, 0.03)):
        t = iso.marching_cubes(volume.cell_corners(vox), 0.0)
        rows = [(x["e0"], x["e1"], x["e2"]) for x in t.collect()]
        assert closed(rows)
        edges = {frozenset((a[i], a[(i + 1) % 3])) for a in rows for i in range(3)}
        assert len({v for a in rows for v in a}) - len(edges) + len(rows) == euler
        got = t.agg(F.sum(g.area(*[g.vec(p) for p in "abc"]))).first()[0]
        assert got == pytest.approx(area, rel=tolerance)


def test_every_cube_case_is_closed_inside_its_cell():
    for m, tris in enumerate(iso.cube_cases()):
        crossed = {i for i, (p, q) in enumerate(iso.EDGES) if (m >> p & 1) != (m >> q & 1)}
        assert {e for t in tris for e in t} == crossed


def test_marching_triangles(spark):
    t = tri(spark, [[(0, 0, 0), (1, 0, 0), (0, 1, 0)]]).withColumns({"as": F.lit(0.0), "bs": F.lit(1.0), "cs": F.lit(1.0)})
    r = iso.marching_triangles(t, 0.25).first()
    assert {(r["px"], r["py"]), (r["qx"], r["qy"])} == {(0.25, 0.0), (0.0, 0.25)}


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate((rng.normal(0, 1, (150, 3)), rng.normal(30, 0.1, (20, 3))))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], "id long, x double, y double, z double")
    q = p.select(F.col("id").alias("q"), "x", "y", "z")
    got = {(r["q"], r["rank"]): r["id"] for r in spatial.knn(q, p, 4, 0.05).collect()}
    d = ((a[:, None] - a[None]) ** 2).sum(-1)
    for i in range(len(a)):
        assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(len(a)), d[i]))[:4].tolist()
    assert spatial.knn(q, p.limit(2), 4, 0.5).count() == 2 * len(a)


def test_trim_is_order_free(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 10, (120, 3))
    s = rng.uniform(1, 4, 120)
    f = spark.createDataFrame([(i, *map(float, x), float(w)) for i, (x, w) in enumerate(zip(a, s, strict=True))], "id long, x double, y double, z double, step double")
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))
    want = {j for j in range(120) if not (s + 0.5 * d[:, j] < s[j]).any()}
    assert {r["id"] for r in field.trim(f, 0.5).collect()} == want


def test_planes_and_spheres(spark):
    flat = spark.createDataFrame([(i, i % 7 / 1.0, i // 7 / 1.0, 2.0) for i in range(49)], "id long, x double, y double, z double")
    n = mls.normals(flat, 2.5).collect()
    assert len(n) == 49 and all(r["nz"] == pytest.approx(1) for r in n)
    k = np.arange(2000) + 0.5
    phi, theta = np.arccos(1 - 2 * k / 2000), np.pi * (1 + 5**0.5) * k
    s = 3 * np.stack([np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)], 1)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "id long, x double, y double, z double")
    q = p.filter("id % 200 = 5").select(F.col("id").alias("q"), *[(F.col(c) * 1.02).alias(c) for c in "xyz"])
    for r in mls.project(q, p, 0.8).collect():
        assert math.sqrt(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2) == pytest.approx(3, rel=5e-3)
        assert abs(r["k1"]) == pytest.approx(1 / 3, rel=0.1) and abs(r["k2"]) == pytest.approx(1 / 3, rel=0.1)


def test_spline_weights():
    for kind in ("catmull", "b"):
        for t in (0.0, 0.3, 0.9):
            w = volume.spline_weights(t, kind)
            assert sum(w) == pytest.approx(1) and sum(x * k for x, k in zip(w, (-1, 0, 1, 2), strict=True)) == pytest.approx(t)


def test_scalars(spark):
    df = spark.createDataFrame([(8, "a/b.c/mesh.off"), (0, "x"), (5, "y.tar.gz")], "n int, p string")
    r = df.select(sc.bit_length(F.col("n")).alias("b"), sc.round_up_to_power(F.col("n")).alias("u"), sc.base_name(F.col("p")).alias("base"), sc.extension(F.col("p")).alias("ext")).collect()
    assert [tuple(x) for x in r] == [(4, 16, "mesh", "off"), (0, 1, "x", ""), (3, 8, "y.tar", "gz")]
    one = spark.range(1)
    roots = one.select(sc.quadratic_roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)).alias("r"), sc.quadratic_roots(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert roots["r"] == [1.0, 2.0] and roots["n"] == []
    i = sc.interval(F.lit(-1.0), F.lit(2.0))
    x = one.select(sc.i_mul(i, i).alias("m"), sc.i_square(i).alias("s"), sc.i_abs(i).alias("a"), sc.i_meet(i, sc.interval(F.lit(3.0), F.lit(4.0))).alias("none")).first()
    assert tuple(x["m"]) == (-2, 4) and tuple(x["s"]) == (0, 4) and tuple(x["a"]) == (0, 2) and x["none"] is None


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 1.0, 4.0, 2.0)], "x double")
    assert df.agg(stats.upper_median("x")).first()[0] == 4.0
    assert stats.exact_upper_median(df, "x").first()[0] == 4.0
    assert df.agg(stats.mean(F.col("x"), 1), stats.variance("x", 1)).first() == (4.0, pytest.approx(10 / 3))


def test_exported_blocks(spark, tmp_path):
    vox = grid(spark, 8, lambda x, y, z: x + 10 * y + 100 * z)
    volume.export(vox, f"{tmp_path}/out", (0, 2, 2), (8, 8, 8), 2, 2)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 4 * 3 * 3 and set(got.columns) == {"x", "y", "z", "value", "bx", "by", "bz"}
    assert got.filter("x = 1 and y = 0 and z = 2").first()["value"] == 2 + 20 + 600


def test_advancing_front_covers_and_fits():
    from meshspark.operators.front import Front, cut_segment

    rng = np.random.default_rng(4)
    for step in (0.3, 0.17):
        size = lambda p, s=step: s * (1 + 0.5 * p[0])
        outline = np.array([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], float)
        loop = np.concatenate([cut_segment(outline[i], outline[(i + 1) % 6], size) for i in range(6)])
        hole = np.array([(0.4, 0.4), (0.4, 0.6), (0.6, 0.6), (0.6, 0.4)]) + rng.uniform(0, 0.02, 2)
        points, tris = Front([loop, hole], size).run()
        a, b, c = (points[tris[:, k]] for k in range(3))
        twice = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        assert (twice > 0).all() and twice.sum() / 2 == pytest.approx(3 - 0.04)
        edges = [(int(t[i]), int(t[(i + 1) % 3])) for t in tris for i in range(3)]
        assert len(edges) == len(set(edges))
        border = {(x, y) for x, y in edges if (y, x) not in set(edges)}
        assert len(border) == len(loop) + 4
        assert len(points) - (len(edges) + len(border)) // 2 + len(tris) == 0  # a disc with a hole


def test_curves(spark):
    from meshspark.operators import curves

    n = 200
    ring = spark.createDataFrame([(0, i, 2 * math.cos(i / 50), 2 * math.sin(i / 50), 0.0, 0.1) for i in range(n)], "curve int, pos int, x double, y double, z double, ideal double")
    assert curves.arc_lengths(ring).agg(F.max("s")).first()[0] == pytest.approx(2 * 199 / 50, rel=1e-3)
    k = [r["k"] for r in curves.curvature(ring, 0.5).orderBy("pos").collect()]
    assert k[n // 2] == pytest.approx(0.5, rel=2e-2)
    out = curves.resample(ring)
    assert out.count() == round(2 * 199 / 50 / 0.1) + 1


def test_flips_only_improve(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 2.0, 0.5, 0.0), (3, 2.0, -0.5, 0.0)], "v int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 0, 3)], "f int, v0 int, v1 int, v2 int")
    assert mesh.flip_candidates(f, v).count() == 1
    out = mesh.flip_edges(f, v)
    assert {frozenset((r["v0"], r["v1"], r["v2"])) for r in out.collect()} == {frozenset((2, 3, 1)), frozenset((2, 3, 0))}


def test_spline_curvature_of_a_sphere(spark):
    from meshspark.operators import surface

    vox = grid(spark, 11, lambda x, y, z: math.sqrt((x - 5) ** 2 + (y - 5) ** 2 + (z - 5) ** 2))
    rows = surface.iso_curvature(surface.spline_field(vox, (11, 11, 11), (0.5, 0.5, 0.5))).filter("value > 3 and value < 5").collect()
    assert rows
    for r in rows:
        assert r["mean"] == pytest.approx(1 / r["value"], rel=0.25) and r["gauss"] == pytest.approx(1 / r["value"] ** 2, rel=0.5)


def test_booleans_of_cubes(spark):
    from meshspark.operators import surface

    a, b = (with_corners(f, v) for v, f in (cube(spark), cube(spark, 0.5)))
    far = with_corners(*cube(spark, 9.0)[::-1])
    assert surface.boolean_faces(a, far, "union", 1.0).count() == 24
    assert surface.boolean_faces(a, far, "intersection", 1.0).count() == 0
    assert surface.boolean_faces(a, far, "difference", 1.0).filter("m = 1").count() == 0
    got = surface.boolean_faces(a, b, "intersection", 1.0)
    assert got.count() > 0 and got.filter("near").count() == got.count()
    p = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 1.5, 0.5, 0.5), (2, 0.5, 0.5, -1.0)], "id int, x double, y double, z double")
    assert [r["inside"] for r in surface.inside(p, a, 0.3).orderBy("id").collect()] == [True, False, False]


def test_quadratics_are_reproduced(spark):
    from meshspark.operators import surface

    f = lambda x, y, z: 1 + x - 2 * y + 3 * z + x * y - z * z
    pts = spark.createDataFrame([(i, float(x), float(y), float(z), float(f(x, y, z))) for i, (x, y, z) in enumerate(np.ndindex(5, 5, 5))], "id int, x double, y double, z double, s double")
    q = spark.createDataFrame([(0, 2.2, 2.4, 1.9)], "q int, x double, y double, z double")
    r = surface.scalar_regression(q, pts, 2.0).first()
    assert r["value"] == pytest.approx(f(2.2, 2.4, 1.9)) and (r["gx"], r["gy"], r["gz"]) == pytest.approx((1 + 2.4, -2 + 2.2, 3 - 3.8))


def test_mesh_curvature_of_a_cylinder(spark):
    from meshspark.operators import surface

    n, m = 24, 12
    v = spark.createDataFrame([(i * m + j, 2 * math.cos(2 * math.pi * i / n), 2 * math.sin(2 * math.pi * i / n), 0.5 * j) for i in range(n) for j in range(m)], "v int, x double, y double, z double")
    quads = [(i * m + j, (i + 1) % n * m + j, (i + 1) % n * m + j + 1, i * m + j + 1) for i in range(n) for j in range(m - 1)]
    f = spark.createDataFrame([(k, *t) for k, t in enumerate(t for a, b, c, d in quads for t in ((a, b, c), (a, c, d)))], "f int, v0 int, v1 int, v2 int")
    rows = [r for r in surface.mesh_curvature(with_corners(f, v), 2).collect() if 3 <= r["v"] % m <= m - 4]
    assert all(abs(r["k1"]) < 0.02 and abs(r["k2"]) == pytest.approx(0.5, rel=0.1) for r in rows)
