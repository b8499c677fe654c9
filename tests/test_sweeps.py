"""Places over ranges, lines over splits, tentative points, finalization, crease curves and leaf frames against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions import geometry as g
from meshspark.operators import mesh, octree
from meshspark.operators.order import running
from meshspark.sources import text as T

CUBE = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


def faces(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "f int, v0 int, v1 int, v2 int")


def triangles(spark, rows, corners):
    flat = [(i, *r, *[float(c) for v in r for c in corners[v]]) for i, r in enumerate(rows)]
    return spark.createDataFrame(flat, "f int, v0 int, v1 int, v2 int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))


def test_running(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(-9, 10)) for k in r.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "k long, d long").repartition(7)
    got = {x["k"]: (x["place"], x["live"]) for x in running(df, ["k"], {"place": None, "live": "d"}).collect()}
    total, want = 0, {}
    for place, (k, d) in enumerate(sorted(rows)):
        total += d
        want[k] = place, total
    assert got == want
    empty = running(df.filter("k < 0"), ["k"])
    assert empty.columns == ["k", "d", "place"] and empty.count() == 0


def test_lines_of_many_splits(spark, tmp_path):
    n = 20_000
    (tmp_path / "a.off").write_text(f"OFF\n\n{n} 1 0\n" + "".join(f"{i} 0 {i % 7}\n" for i in range(n)) + "3 5 6 7\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
        assert spark.read.text(f"{tmp_path}/a.off").rdd.getNumPartitions() > 8
        v, f = T.read_off(spark, f"{tmp_path}/a.off")
        assert v.filter("x <> v or z <> v % 7").count() == 0 and v.count() == n
        assert [tuple(r) for r in f.collect()] == [(0, 5, 6, 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_apex(spark):
    r = random.Random(3)
    rows = [tuple(r.uniform(-1, 1) for _ in range(12)) + (r.uniform(0.1, 2), r.uniform(0.1, 2)) for _ in range(300)]
    names = [p + c for p in "pqnm" for c in "xyz"] + ["one", "two"]
    df = spark.createDataFrame(rows, names)
    at, up = g.apex(g.vec("p"), g.vec("n"), F.col("one"), g.vec("q"), g.vec("m"), F.col("two"))
    got = df.select(*names, *[c.alias("a" + k) for c, k in zip(at, "xyz", strict=True)], *[c.alias("u" + k) for c, k in zip(up, "xyz", strict=True)]).collect()
    some = 0
    for x in got:
        p, q, n, m, a, u = (np.array([x[v + c] for c in "xyz"], dtype=object) for v in "pqnmau")
        d = np.linalg.norm((q - p).astype(float))
        fits = d <= x["one"] + x["two"] and abs(x["one"] - x["two"]) <= d
        reach = x["one"] ** 2 >= max(0, min(d, (d * d + x["one"] ** 2 - x["two"] ** 2) / (2 * d))) ** 2
        assert (a[0] is not None) == (fits and reach)
        if a[0] is None:
            continue
        some += 1
        a, u, p, q = (v.astype(float) for v in (a, u, p, q))
        foot = (d * d + x["one"] ** 2 - x["two"] ** 2) / (2 * d)
        assert np.linalg.norm(a - p) == pytest.approx(x["one"])
        if 0 <= foot <= d:
            assert np.linalg.norm(a - q) == pytest.approx(x["two"])
        assert u == pytest.approx((n + m).astype(float) / np.linalg.norm((n + m).astype(float)))
        assert (a - p) @ np.cross(u, q - p) >= 0
    assert 50 < some < 300


def test_finalized(spark):
    for rows in (CUBE, CUBE[:7], CUBE[:1]):
        got = {r["v"]: (r["done"], r["peak"]) for r in mesh.finalized(faces(spark, rows)).collect()}
        used, want = {}, {}
        for f, t in enumerate(rows):
            for a, b in zip(t, (*t[1:], t[0]), strict=True):
                used[frozenset((a, b))] = used.get(frozenset((a, b)), 0) + 1
            for v in set(sum(rows[: f + 1], ())):
                live = sum(n % 2 for e, n in used.items() if v in e)
                done, peak = want.get(v, (None, 0))
                want[v] = (f if done is None and live == 0 else done), max(peak, live)
        assert got == want


def test_crease_curves(spark):
    """Corners of a cube are kinks, so each of its twelve edges is a curve; a roof's ridge is one curve of three edges."""
    box = mesh.creases(triangles(spark, CUBE, CORNERS), 0.5)
    assert mesh.crease_curves(box, 1).count() == 12
    assert mesh.crease_curves(box, 2).count() == 0
    at = [(x, y, -abs(y)) for y in (-1, 0, 1) for x in range(4)]
    roof = [t for row in (0, 4) for i in range(row, row + 3) for t in ((i, i + 1, i + 5), (i, i + 5, i + 4))]
    ridge = mesh.crease_curves(mesh.creases(triangles(spark, roof, at), 0.5), 3).collect()
    assert sorted((r["curve_a"], r["curve_b"], r["a"], r["b"], r["n"]) for r in ridge) == [(4, 5, 4, 5, 3), (4, 5, 5, 6, 3), (4, 5, 6, 7, 3)]
    assert mesh.crease_curves(box.filter("a < 0"), 1).count() == 0


def test_frames(spark):
    r = np.random.default_rng(2)
    at = {m: r.normal(size=(40, 3)) * [3, 1, 0.4] @ np.linalg.qr(r.normal(size=(3, 3)))[0] + m for m in (1, 2)}
    rows = [(m, *map(float, p)) for m, ps in at.items() for p in ps] + [(9, 0.0, 0.0, 0.0)] * 3 + [(8, float(i), 0.0, 0.0) for i in range(5)]
    got = {x["m"]: x for x in octree.frames(spark.createDataFrame(rows, "m long, x double, y double, z double")).collect()}
    assert set(got) == {1, 2, 8}
    for m, p in at.items():
        c = np.cov(p.T, bias=True)
        w = np.linalg.eigvalsh(c)
        axes = np.array(got[m]["axes"]).reshape(3, 3)
        assert got[m]["values"] == pytest.approx(list(w))
        assert np.linalg.norm(axes, axis=1) == pytest.approx([w[2] / w[0], w[1] / w[0], 1])
        for k, axis in enumerate(axes):
            assert c @ axis == pytest.approx(w[[2, 1, 0][k]] * axis)
        assert axes[0] @ p.mean(axis=0) <= 0
