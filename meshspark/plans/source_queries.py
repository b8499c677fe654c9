"""Queries that write tables in a format and read them back, against the SQL of the tables themselves."""

from __future__ import annotations

import gzip
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.plans.registry import query, r6, s6
from meshspark.shared import fresh, put
from meshspark.sources import binary as B
from meshspark.sources import text as T
from meshspark.sources import volume as V
from meshspark.sources import writers as W

_CORNERS = [p + c for p in "abc" for c in "xyz"]
_MESH = f"SELECT f, v0, v1, v2, {', '.join(s6(c, c) for c in _CORNERS)} FROM surf_t"


def _corners(verts: DataFrame, faces: DataFrame) -> DataFrame:
    return fx.corners(faces, verts).select(*[F.col(c).cast("int").alias(c) for c in ("f", "v0", "v1", "v2")], *[r6(c, c) for c in _CORNERS])


def _written(spark: SparkSession, sf: str, style: str) -> str:
    path = fresh(spark, style)
    W.write_mesh(fx.surf_v(spark, sf), fx.surf_f(spark), path, style)
    return f"{path}/part-*.txt"


@query(_MESH, "surf_t")
def mesh_m(spark, sf):
    """A mesh as .m and back"""
    return _corners(*T.read_m(spark, _written(spark, sf, "m")))


@query(_MESH, "surf_t")
def mesh_off(spark, sf):
    """A mesh as .off and back"""
    return _corners(*T.read_off(spark, _written(spark, sf, "off")))


@query(_MESH, "surf_t")
def mesh_sma(spark, sf):
    """S3, K5: a mesh as .sma and back"""
    return _corners(*T.read_sma(spark, _written(spark, sf, "sma")))


@query(_MESH, "surf_t")
def mesh_obj(spark, sf):
    """A mesh as .obj and back"""
    return _corners(*T.read_obj_mesh(spark, _written(spark, sf, "obj")))


@query(_MESH, "surf_t")
def mesh_ply(spark, sf):
    """A mesh as .ply and back"""
    return _corners(*B.read_ply(spark, _written(spark, sf, "ply")))


@query(_MESH, "surf_t")
def mesh_vtk(spark, sf):
    """A mesh as .vtk and back"""
    return _corners(*B.read_vtk(spark, _written(spark, sf, "vtk")))


@query(_MESH, "surf_t")
def mesh_by_suffix(spark, sf):
    """A compressed file opened by the suffix before .gz"""
    path = fresh(spark, "mesh") + ".off.gz"
    lines = [r["line"] for part in W.mesh_lines(fx.surf_v(spark, sf), fx.surf_f(spark), "off") for r in part.sort("k").select("line").toLocalIterator()]
    put(spark, path, gzip.compress("\n".join(lines).encode()))
    return _corners(*B.read_surface(spark, path))


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS id, {', '.join(s6(c, c) for c in 'xyz')}, {', '.join(s6(c + ' / 2', 'n' + c) for c in 'xyz')} FROM pts", "pts")
def points_obj(spark, sf):
    """Points with normals as .obj and back"""
    path = fresh(spark, "points")
    p = fx.pts(spark, sf).withColumns({"n" + c: F.col(c) / 2 for c in "xyz"})
    W.write_points_all(p, path)
    return T.read_obj_points(spark, f"{path}/part-*.txt").select(F.col("id").cast("int").alias("id"), *[r6(c, c) for c in (*"xyz", "nx", "ny", "nz")])


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS id, {', '.join(s6(c, c) for c in 'xyz')}, label % 2 = 0 AS is_corner FROM pts", "pts")
def points_pc(spark, sf):
    """Points with corner flags as .pc and back"""
    path = fresh(spark, "points")
    W.write_pc(fx.pts(spark, sf).withColumn("is_corner", F.col("label") % 2 == 0), path)
    return T.read_pc(spark, f"{path}/part-*.txt").select(F.col("id").cast("int").alias("id"), *[r6(c, c) for c in "xyz"], "is_corner")


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS id, {', '.join(s6(c, c) for c in 'xyz')}, {', '.join(s6(f'-{c}', 'n' + c) for c in 'xyz')}, round(label / 4.0::DOUBLE, 6) AS radius FROM pts", "pts")
def points_asf(spark, sf):
    """Points with normals and radii of an .asf file"""
    path = fresh(spark, "points")
    p = fx.pts(spark, sf)
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"], *[(-F.col(c)).cast("string") for c in "xyz"], (F.col("label") / 4).cast("string"))
    p.sort("id").select(line.alias("line")).coalesce(1).write.text(path)
    return T.read_asf(spark, f"{path}/part-*.txt").select(F.col("id").cast("int").alias("id"), *[r6(c, c) for c in (*"xyz", "nx", "ny", "nz", "radius")])


@query("SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS id, round(1 + label / 8.0::DOUBLE, 6) AS ideal FROM pts", "pts")
def guidance_lengths(spark, sf):
    """Lengths of field points, one a line, and back"""
    path = fresh(spark, "lengths")
    W.write_lengths(fx.pts(spark, sf).select("id", (1 + F.col("label") / 8).alias("ideal")), path)
    return T.read_lengths(spark, f"{path}/part-*.txt").select(F.col("id").cast("int").alias("id"), r6("ideal", "ideal"))


@query("WITH l AS (SELECT id, label, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS i FROM pts), k AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS loop, CAST(row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS INT) AS pos, i FROM l) SELECT loop, pos, k.i, round(x, 6) + 0e0 AS x, round(-y, 6) + 0e0 AS ny, label % 2 = 0 AS is_corner FROM k JOIN (SELECT x, y, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS i FROM pts) p USING (i)", "pts")
def feature_loops(spark, sf):
    """Feature loops as .flf and back"""
    path = fresh(spark, "loops")
    p = fx.pts(spark, sf)
    points = p.select("id", *"xyz", (F.col("label") % 2 == 0).alias("is_corner"))
    W.write_flf(points, p.select(F.col("label").alias("loop"), F.col("id").alias("pos"), "id", *[(-F.col(c)).alias("n" + c) for c in "xyz"]), path)
    at, loops = T.read_flf(spark, f"{path}/part-*.txt")
    return loops.join(at.select("i", "x", "is_corner"), "i").select("loop", "pos", "i", r6("x", "x"), r6("ny", "ny"), "is_corner")


@query(f"SELECT t, v0, v1, least(v2, v3) AS low, greatest(v2, v3) AS high, {s6('s', 's')} FROM tets JOIN tverts ON tverts.v = v0", "tets", "tverts")
def tets_offt(spark, sf):
    """Tetrahedra with scalars of an .offt file, turned to positive volume"""
    path = fresh(spark, "tets")
    v, t = fx.tverts(spark, sf), fx.tets(spark)
    head = spark.createDataFrame([(0, f"{v.count()} {t.count()}")], "k long, line string")
    W._text([head, v.select(F.col("v").alias("k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyzs"]).alias("line")), t.select(F.col("t").alias("k"), F.concat_ws(" ", "v0", "v1", "v2", "v3").alias("line"))], path)
    v2, t2 = T.read_offt(spark, f"{path}/part-*.txt")
    out = t2.join(v2.select(F.col("v").alias("v0"), "s"), "v0")
    return out.select(F.col("t").cast("int").alias("t"), F.col("v0").cast("int").alias("v0"), F.col("v1").cast("int").alias("v1"), F.least("v2", "v3").cast("int").alias("low"), F.greatest("v2", "v3").cast("int").alias("high"), r6("s", "s"))


_VOX = "SELECT x, y, z, CAST(n % 30000 AS DOUBLE) AS value FROM vox"


def _samples(spark, sf, kind: str) -> np.ndarray:
    """A small volume in file order, x fastest."""
    rows = fx.vox(spark, sf).sort("z", "y", "x").select((F.col("n") % 30000).alias("n"))
    return np.array([r["n"] for r in rows.collect()], kind)  # 512 samples


@query(_VOX, "vox")
def volume_nhdr(spark, sf):
    """A volume with a header and compressed big-endian data"""
    path = fresh(spark, "volume")
    put(spark, f"{path}/a.raw.gz", gzip.compress(_samples(spark, sf, ">i2").tobytes()))
    put(spark, f"{path}/a.nhdr", b"NRRD0004\ntype: short\ndimension: 3\nsizes: 8 8 8\nspacings: 1 1 1\nencoding: gzip\nendian: big\ndata file: a.raw.gz\n")
    return V.read_nhdr(spark, f"{path}/a.nhdr")[0]


@query(_VOX, "vox")
def volume_blocks(spark, sf):
    """A volume in eight blocks, each with its header"""
    path = fresh(spark, "volume")
    data = _samples(spark, sf, "<i2").reshape(2, 4, 2, 4, 2, 4)
    for k in range(8):
        x, y, z = k & 1, k >> 1 & 1, k >> 2
        put(spark, f"{path}/b{k}.raw", np.ascontiguousarray(data[z, :, y, :, x, :]).tobytes())
        put(spark, f"{path}/b.{x:03d}.{y:03d}.{z:03d}.nhdr", f"NRRD0004\ntype: short\nsizes: 4 4 4\nendian: little\ndata file: b{k}.raw\n".encode())
    put(spark, f"{path}/b.nooc", b"sizes: 8 8 8\nblock size: 4 4 4\nspacings: 1 1 1\nblock prefix: b\nspace origin: (0,0,0)\n")
    return V.read_blocked(spark, f"{path}/b.nooc")[0]


@query("SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(0 AS INT) AS z, CAST((x * 3 + y * 7) % 251 AS DOUBLE) AS value FROM range(256) a(x), range(256) b(y)")
def volume_raw(spark, sf):
    """A raw slice of bytes"""
    path = fresh(spark, "volume") + ".byte.vol"
    put(spark, path, ((np.arange(256)[None, :] * 3 + np.arange(256)[:, None] * 7) % 251).astype("u1").tobytes())
    return V.read_raw(spark, path)


_EVENTS = "SELECT kind, count(*) AS n, CAST(sum(coalesce(t0, 0) + 2 * coalesce(t1, 0) + 3 * coalesce(t2, 0)) AS BIGINT) AS ids, round(sum(round(coalesce(z, 0), 4)), 3) + 0e0 AS z FROM e GROUP BY kind"
_NEW = "WITH o AS (SELECT v, row_number() OVER (ORDER BY seq) - 1 AS new FROM mev WHERE kind = 'v'), e AS (SELECT kind, n0.new AS t0, n1.new AS t1, n2.new AS t2, z FROM mev LEFT JOIN o n0 ON n0.v = t0 LEFT JOIN o n1 ON n1.v = t1 LEFT JOIN o n2 ON n2.v = t2) "


def _summed(events: DataFrame) -> DataFrame:
    ids = F.coalesce("t0", F.lit(0)) + 2 * F.coalesce("t1", F.lit(0)) + 3 * F.coalesce("t2", F.lit(0))
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.sum(ids).cast("long").alias("ids"), (F.round(F.sum(F.round(F.coalesce("z", F.lit(0.0)), 4)), 3) + 0.0).alias("z"))


@query(_NEW + _EVENTS, "mev")
def stream_sma(spark, sf):
    """A streaming mesh as text and back"""
    path = fresh(spark, "stream")
    W.write_stream(fx.mev(spark, sf), path)
    return _summed(T.read_stream_sma(spark, f"{path}/part-*.txt"))


@query(_NEW + _EVENTS.replace("FROM e", "FROM e WHERE kind <> 'x'").replace("z, 0), 4)), 3)", "z, 0), 4)), 2)"), "mev")
def stream_smb(spark, sf):
    """A binary streaming mesh and back"""
    path = fresh(spark, "stream") + ".smb"
    number, out = {}, []
    for r in fx.mev(spark, sf).sort("seq").toLocalIterator():
        if r["kind"] == "v":
            number[r["v"]] = len(number) + 1
            out.append(("v", r["x"], r["y"], r["z"]))
        elif r["kind"] == "t":
            out.append(("t", *(number[r[c]] for c in ("t0", "t1", "t2"))))
    put(spark, path, B.smb_bytes(out))
    return _summed(B.read_smb(spark, path)).withColumn("z", F.round("z", 2) + 0.0)


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS id, {', '.join(s6(c, c) for c in 'xyz')}, {s6('z - x', 'nx')}, round(label / 2.0::DOUBLE, 6) AS radius FROM pts", "pts")
def points_sst(spark, sf):
    """A binary point set in chunks and back"""
    path = fresh(spark, "points") + ".sst"
    p = fx.pts(spark, sf).sort("id").select(*"xyz", (F.col("z") - F.col("x")).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (F.col("label") / 2).alias("radius"))
    put(spark, path, B.sst_bytes(p.toPandas(), 100))
    return B.read_sst(spark, path).select("id", *[r6(c, c) for c in (*"xyz", "nx", "radius")])


@query("SELECT CAST(i AS BIGINT) AS i, round((1 + i % 5) * cos(i / 64.0::DOUBLE) * cos(i / 128.0::DOUBLE), 5) + 0e0 AS x, round((1 + i % 5) * sin(i / 64.0::DOUBLE) * cos(i / 128.0::DOUBLE), 5) + 0e0 AS y, round((1 + i % 5) * sin(i / 128.0::DOUBLE), 5) + 0e0 AS z FROM range(60) r(i)")
def range_image(spark, sf):
    """Strips of a range image as points"""
    path = fresh(spark, "range") + ".rtpi"
    strips = [b"RTPIv2 6 10\n"]
    for s in range(6):
        strips.append(struct.pack("<I", 10) + b"".join(struct.pack("<3fi", 1 + i % 5, i / 64, i / 128, i) for i in range(10 * s, 10 * s + 10)))
    put(spark, path, b"".join(strips))
    return B.range_points(B.read_rtpi(spark, path)).select(F.col("i").cast("long").alias("i"), *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])
