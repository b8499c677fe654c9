"""Files written and read again, and files as their formats describe them."""

import gzip

import numpy as np

from meshspark import fixtures as fx
from meshspark.sources import text as T
from meshspark.sources import volume as V
from meshspark.sources import writers as W


def mesh(spark, sf):
    from pyspark.sql import functions as F

    v = fx.surf_v(spark, sf).select("v", "x", "y", F.round("z", 4).alias("z"))
    return v, fx.surf_f(spark)


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_meshes_round_trip(spark, sf, tmp_path):
    v, f = mesh(spark, sf)
    for style, read in (("m", T.read_m), ("obj", T.read_obj_mesh), ("sma", T.read_sma), ("off", T.read_off)):
        path = f"{tmp_path}/{style}"
        W.write_mesh(v, f, path, style)
        v2, f2 = read(spark, f"{path}/part-*.txt")
        same(v2, v)
        same(f2, f)


def test_other_mesh_writers(spark, sf, tmp_path):
    v, f = mesh(spark, sf)
    for style, first in (("vtk", "# vtk DataFile Version 3.0"), ("ply", "ply")):
        W.write_mesh(v, f, f"{tmp_path}/{style}", style)
        lines = [r[0] for r in spark.read.text(f"{tmp_path}/{style}").collect()]
        assert lines[0] == first
        assert sum(x.startswith("3 ") for x in lines) == 98


def test_gaps_comments_and_positions(spark, tmp_path):
    p = tmp_path / "a.m"
    p.write_text("# a mesh\nVertex 2 0 0 0 {normal=(0 0 1)}\nVertex 5 1 0 0\nVertex 9 9 9 9 {Opos=(0 1 0)}\nFace 7 2 5 9\n")
    v, f = T.read_m(spark, str(p))
    assert sorted(map(tuple, v.collect())) == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0)]
    assert [tuple(r) for r in f.collect()] == [(0, 0, 1, 2)]


def test_points(spark, tmp_path):
    p = tmp_path / "p.obj"
    p.write_text("v 1 2 3\nvn 0 0 1\nv 4 5 6\nvc 10 20 30\n")
    got = sorted(map(tuple, T.read_obj_points(spark, str(p)).collect()))
    assert got == [(0, 1, 2, 3, 0, 0, 1, 10, 20, 30), (1, 4, 5, 6, None, None, None, None, None, None)]
    (tmp_path / "p.asf").write_text("1 2 3 0 0 1 0.5\n")
    assert tuple(T.read_asf(spark, str(tmp_path / "p.asf")).first()) == (0, 1, 2, 3, 0, 0, 1, 0.5)
    pts = spark.createDataFrame([(0, 1.0, 2.0, 3.0, True), (1, 4.0, 5.0, 6.0, False)], "id int, x double, y double, z double, is_corner boolean")
    W.write_pc(pts, f"{tmp_path}/pc")
    same(T.read_pc(spark, f"{tmp_path}/pc/part-*.txt"), pts)
    (tmp_path / "l.txt").write_text("0.5\n0.25\n")
    assert [tuple(r) for r in T.read_lengths(spark, str(tmp_path / "l.txt")).collect()] == [(0, 0.5), (1, 0.25)]


def test_tetrahedra_are_turned(spark, tmp_path):
    (tmp_path / "t.offt").write_text("4 2\n0 0 0 7\n1 0 0\n0 1 0\n0 0 1 2\n0 1 2 3\n0 2 1 3\n")
    v, t = T.read_offt(spark, str(tmp_path / "t.offt"))
    assert [r["s"] for r in v.orderBy("v").collect()] == [7, 0, 0, 2]
    assert sorted(map(tuple, t.collect())) == [(0, 0, 1, 2, 3), (1, 0, 2, 3, 1)] or sorted(map(tuple, t.collect())) == [(0, 0, 1, 2, 3), (1, 0, 2, 3, 1)]


def test_streams(spark, sf, tmp_path):
    (tmp_path / "s.sma").write_text("# nverts 4\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\njunk\nv 1 1 0\nf -3 4 -2\nx 1\n")
    got = T.read_stream_sma(spark, str(tmp_path / "s.sma")).orderBy("seq").collect()
    assert [r["kind"] for r in got] == ["v", "v", "v", "t", "v", "t", "x"]
    assert (got[5]["t0"], got[5]["t1"], got[5]["t2"]) == (1, 3, 2) and (got[5]["f0"], got[5]["f1"], got[5]["f2"]) == (True, False, True)
    assert got[6]["v"] == 0
    events = fx.mev(spark, sf)
    W.write_stream(events, f"{tmp_path}/out")
    back = T.read_stream_sma(spark, f"{tmp_path}/out/part-*.txt")
    assert {r["kind"]: r["count"] for r in back.groupBy("kind").count().collect()} == {"v": 64, "t": 98, "x": 64}


def test_loops(spark, tmp_path):
    (tmp_path / "l.flf").write_text("3\n0 0 0 1\n1 0 0 0\n0 1 0 0\n1\n3\n0 0 0 1\n1 0 0 1\n2 0 0 1\n")
    p, loops = T.read_flf(spark, str(tmp_path / "l.flf"))
    assert [r["is_corner"] for r in p.orderBy("i").collect()] == [True, False, False]
    assert [(r["loop"], r["pos"], r["i"]) for r in loops.orderBy("pos").collect()] == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]


def test_volumes(spark, tmp_path):
    data = np.arange(24, dtype="<i2")
    (tmp_path / "a.raw.gz").write_bytes(gzip.compress(data.tobytes()))
    (tmp_path / "a.nhdr").write_text("NRRD0004\ntype: short\ndimension: 3\nsizes: 2 3 4\nspacings: 1 1 2\nencoding: gzip\nendian: little\nspace origin: (1,2,3)\ndata file: a.raw.gz\n")
    vox, h = V.read_nhdr(spark, f"{tmp_path}/a.nhdr")
    assert h["dims"] == [2, 3, 4] and h["origin"] == [1, 2, 3]
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in vox.collect()} == {(x, y, z): float(x + 2 * (y + 3 * z)) for x in range(2) for y in range(3) for z in range(4)}
    for bx in range(2):
        block = data.reshape(4, 3, 2)[:, :, bx : bx + 1].astype(">i2")
        (tmp_path / f"b{bx}.raw").write_bytes(block.tobytes())
        (tmp_path / f"b.{bx:03d}.000.000.nhdr").write_text(f"NRRD0004\ntype: short\nsizes: 1 3 4\nendian: big\ndata file: b{bx}.raw\n")
    (tmp_path / "b.nooc").write_text("sizes: 2 3 4\nblock size: 1 3 4\nspacings: 1 1 1\nblock prefix: b\nspace origin: (0,0,0)\n")
    blocked, _ = V.read_blocked(spark, f"{tmp_path}/b.nooc")
    same(blocked, vox)
    (tmp_path / "c.byte.vol").write_bytes(bytes(256 * 256 * 2))
    assert V.read_raw(spark, f"{tmp_path}/c.byte.vol").count() == 2 * 256 * 256
