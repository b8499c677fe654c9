"""Binary files built by hand or by the writers, read back."""

import struct

import numpy as np
import pandas as pd
import pytest

from meshspark import fixtures as fx
from meshspark.sources import binary as B
from meshspark.sources import writers as W


def test_point_sets(spark, tmp_path):
    rng = np.random.default_rng(1)
    table = pd.DataFrame(rng.normal(size=(25, 7)), columns=["x", "y", "z", "nx", "ny", "nz", "radius"])
    (tmp_path / "a.sst").write_bytes(B.sst_bytes(table, 10))
    got = B.read_surface(spark, f"{tmp_path}/a.sst").orderBy("id").toPandas()
    assert np.allclose(got[table.columns], table) and got["r"].isna().all()
    old = b" TSS" + struct.pack("<iI", 1, 2) + bytes([0, 0, 0]) + np.arange(6, dtype="<f8").tobytes()
    (tmp_path / "b.sst").write_bytes(old)
    assert [tuple(r)[:4] for r in B.read_sst(spark, f"{tmp_path}/b.sst").orderBy("id").collect()] == [(0, 0, 1, 2), (1, 3, 4, 5)]


def test_streaming_meshes(spark, tmp_path):
    elements = [("v", float(i), 0.0, 1.0) for i in range(40)] + [("t", 1, 2, -1), ("t", -40, 3, 4)]
    (tmp_path / "a.smb").write_bytes(B.smb_bytes(elements))
    got = B.read_smb(spark, f"{tmp_path}/a.smb").orderBy("seq").collect()
    assert len(got) == 42 and got[39]["x"] == 39.0
    assert (got[40]["t0"], got[40]["t1"], got[40]["t2"], got[40]["f2"]) == (0, 1, 39, True)
    assert (got[41]["t0"], got[41]["f0"], got[41]["f1"]) == (0, True, False)


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_polygons(spark, tmp_path, form):
    head = f"ply\nformat {form} 1.0\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n".encode()
    verts, faces = [(0, 0, 0, 9), (1, 0, 0, 9), (0, 1, 0, 9), (1, 1, 0, 9)], [(0, 1, 2), (1, 3, 2, 0)]
    e = ">" if "big" in form else "<"
    if form == "ascii":
        body = "\n".join([" ".join(map(str, v)) for v in verts] + [" ".join(map(str, (len(f), *f))) for f in faces]).encode()
    else:
        body = b"".join(struct.pack(e + "3fB", *v) for v in verts) + b"".join(struct.pack(e + f"B{len(f)}i", len(f), *f) for f in faces)
    (tmp_path / "a.ply").write_bytes(head + body)
    v, f = B.read_surface(spark, f"{tmp_path}/a.ply")
    assert sorted(map(tuple, v.collect())) == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 1, 0)]
    assert sorted(map(tuple, f.collect())) == [(0, 0, 1, 2), (1, 1, 3, 2)]


def test_writers_are_read_back(spark, sf, tmp_path):
    v, f = fx.surf_v(spark, sf), fx.surf_f(spark)
    for style, read in (("ply", B.read_ply), ("vtk", B.read_vtk)):
        W.write_mesh(v, f, f"{tmp_path}/{style}", style)
        v2, f2 = read(spark, f"{tmp_path}/{style}/part-*.txt")
        assert v2.exceptAll(v.selectExpr("cast(v as int) as v", "x", "y", "z")).count() == 0 and v2.count() == 64
        assert sorted(map(tuple, f2.collect())) == sorted(map(tuple, f.collect()))


def test_range_images(spark, tmp_path):
    body = b"# c\nRTPIv2 2 3\n" + struct.pack("<I", 1) + struct.pack("<3fi", 2.0, 0.0, 0.0, 7) + struct.pack("<I", 2) + struct.pack("<3fi", 1.0, np.pi / 2, 0.0, 8) + struct.pack("<3fi", 1.0, 0.0, np.pi / 2, 9)
    (tmp_path / "a.rtpi").write_bytes(body)
    got = B.range_points(B.read_rtpi(spark, f"{tmp_path}/a.rtpi")).orderBy("i").collect()
    want = [(2, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert all(r["x"] == pytest.approx(w[0], abs=1e-6) and r["y"] == pytest.approx(w[1], abs=1e-6) and r["z"] == pytest.approx(w[2], abs=1e-6) for r, w in zip(got, want, strict=True))


def test_nodes_and_elements(spark, tmp_path):
    (tmp_path / "a.node").write_text("# nodes\n3 2 0 0\n1 0 0\n2 1 0\n3 0 1\n")
    (tmp_path / "a.ele").write_text("1 3 0\n1 1 2 3\n")
    v, f = B.read_node_ele(spark, f"{tmp_path}/a.node", f"{tmp_path}/a.ele")
    assert v.count() == 3 and tuple(f.first()) == (0, 0, 1, 2)
    with pytest.raises(ValueError):
        B.read_surface(spark, "x.unknown")
