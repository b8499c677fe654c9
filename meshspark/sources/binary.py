"""Binary formats: point sets in chunks, streaming meshes in buffers, polygon files, range images; and cell and node files.

Each file is parsed by one task over its bytes with numpy; many files are as many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.sources.files import contents

from meshspark.sources.text import XYZ, _double, _numbered

#: Fixed values of the point-set format.
SST_COOKIE, SST_DOUBLE, SST_FLOAT = b" TSS", 1, 2
SST = "id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double, radius double"
EVENTS = "seq long, kind string, v int, x double, y double, z double, t0 int, t1 int, t2 int, f0 boolean, f1 boolean, f2 boolean"


def _parsed(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield parse(bytes(content))

    return contents(spark, path).select("content").mapInPandas(run, schema)


def _sst(content: bytes) -> pd.DataFrame:
    """Header: cookie, version 1 to 3, N, chunks (from 2 on), three flags, sample format (from 3 on); then for each chunk
    its size (from 2 on) and the arrays of points, normals, colours and radii."""
    if content[:4] != SST_COOKIE:
        raise ValueError("not a point set")
    version, n = struct.unpack_from("<iI", content, 4)
    at, chunks = 12, 1
    if version > 1:
        chunks, at = struct.unpack_from("<I", content, at)[0], at + 4
    flags, at = [bool(x) for x in content[at : at + 3]], at + 3
    kind = "<f8"
    if version > 2:
        kind, at = ("<f4" if struct.unpack_from("<i", content, at)[0] == SST_FLOAT else "<f8"), at + 4
    parts = []
    for _ in range(chunks):
        k = n
        if version > 1:
            k, at = struct.unpack_from("<I", content, at)[0], at + 4
        cols = []
        for has, width, sample in ((True, 3, kind), (flags[0], 3, kind), (flags[1], 3, "<f4"), (flags[2], 1, kind)):
            if has:
                a = np.frombuffer(content, sample, k * width, at).reshape(k, width).astype(float)
                at += k * width * np.dtype(sample).itemsize
            else:
                a = np.full((k, width), np.nan)
            cols.append(a)
        parts.append(np.concatenate(cols, axis=1))
    rows = np.concatenate(parts) if parts else np.zeros((0, 10))
    out = pd.DataFrame(rows, columns=["x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "radius"])
    out.insert(0, "id", np.arange(len(out)))
    return out


def read_sst(spark: SparkSession, path: str) -> DataFrame:
    """id, position, and normal, colour and radius where the file has them (else null)."""
    out = _parsed(spark, path, _sst, SST)
    return out.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in out.columns[1:]])


def sst_bytes(points: pd.DataFrame, chunk: int = 1 << 20) -> bytes:
    """A version 3 file of doubles with positions, and normals and radii where the table has them."""
    n, has_n, has_r = len(points), "nx" in points, "radius" in points
    out = [SST_COOKIE, struct.pack("<iII", 3, n, -(-n // chunk)), bytes([has_n, 0, has_r]), struct.pack("<i", SST_DOUBLE)]
    for k in range(0, n, chunk):
        part = points.iloc[k : k + chunk]
        out.append(struct.pack("<I", len(part)))
        for cols in (["x", "y", "z"], *[["nx", "ny", "nz"]] * has_n, *[["radius"]] * has_r):
            out.append(part[cols].to_numpy("<f8").tobytes())
    return b"".join(out)


def _smb(content: bytes) -> pd.DataFrame:
    """Version byte 0, byte order, two spare bytes, comments, counts, an optional box; then buffers of up to 32 elements of
    three words, behind a word whose bits tell vertices from triangles."""
    if not content or content[0] != 0:
        raise ValueError("not a binary streaming mesh")
    end = ">" if content[1] else "<"
    at = 4
    comments, at = struct.unpack_from(end + "i", content, at)[0], at + 4
    for _ in range(comments):
        at += 4 + struct.unpack_from(end + "i", content, at)[0]
    at += 8
    at += 1 + 24 * bool(content[at])
    out, v, seq = [], 0, 0
    first = None
    while at + 4 < len(content):
        bits, at = struct.unpack_from(end + "I", content, at)[0], at + 4
        body = content[at : at + 384]
        at += len(body)
        for k in range(len(body) // 12):
            if bits >> k & 1:
                first = "v" if first is None else first
                out.append((seq, "v", v, *(float(x) for x in struct.unpack_from(end + "3f", body, 12 * k)), None, None, None, None, None, None))
                v += 1
            else:
                first = "t" if first is None else first
                t = struct.unpack_from(end + "3i", body, 12 * k)
                out.append((seq, "t", None, None, None, None, *(v + i if i < 0 else i - 1 for i in t), *(i < 0 for i in t)))
            seq += 1
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("v", "t0", "t1", "t2")} | {c: "boolean" for c in ("f0", "f1", "f2")})


def read_smb(spark: SparkSession, path: str) -> DataFrame:
    """The event list of a binary streaming mesh: negative ids count back from the vertices so far and are final."""
    return _parsed(spark, path, _smb, EVENTS)


def smb_bytes(elements: list[tuple]) -> bytes:
    """A little-endian file of elements ("v", x, y, z) and ("t", a, b, c), ids as the format has them."""
    out = [bytes([0, 0, 0, 0]), struct.pack("<iii", 0, sum(e[0] == "v" for e in elements), sum(e[0] == "t" for e in elements)), b"\0"]
    for k in range(0, len(elements), 32):
        part = elements[k : k + 32]
        out.append(struct.pack("<I", sum((e[0] == "v") << i for i, e in enumerate(part))))
        out += [struct.pack("<3f" if e[0] == "v" else "<3i", *e[1:]) for e in part]
    return b"".join(out)


#: Number types of polygon files.
PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _ply(content: bytes) -> pd.DataFrame:
    """ASCII and both binary orders: vertex elements with x, y, z, face elements whose first list holds vertex ids."""
    cut = content.index(b"end_header")
    cut = content.index(b"\n", cut) + 1
    lines = [x.split() for x in content[:cut].decode("ascii", "replace").splitlines()]
    form = next(x[1] for x in lines if x and x[0] == "format")
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        if x and x[0] == "element":
            elements.append((x[1], int(x[2]), []))
        elif x and x[0] == "property":
            elements[-1][2].append(x[1:])
    body = content[cut:]
    words = iter(body.split()) if form == "ascii" else None
    end, at = (">" if "big" in form else "<"), 0

    def number(kind: str):
        nonlocal at
        if words is not None:
            w = next(words)
            return float(w) if kind[0] in ("f", "d") else int(w)
        d = np.dtype(end + PLY[kind])
        at += d.itemsize
        return np.frombuffer(body, d, 1, at - d.itemsize)[0].item()

    out = []
    for name, n, props in elements:
        for k in range(n):
            row, ids = {}, None
            for p in props:
                if p[0] == "list":
                    values = [number(p[2]) for _ in range(int(number(p[1])))]
                    ids = values if ids is None else ids
                else:
                    row[p[1]] = number(p[0])
            if name == "vertex":
                out.append(("v", k, row["x"], row["y"], row["z"], None, None, None))
            elif name == "face" and ids and len(ids) >= 3:
                out.append(("f", k, None, None, None, *ids[:3]))
    return pd.DataFrame(out, columns=["kind", "k", "x", "y", "z", "v0", "v1", "v2"]).astype({c: "Int64" for c in ("v0", "v1", "v2")})


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """verts(v, x, y, z) and faces(f, v0, v1, v2); larger polygons keep their first three ids."""
    rows = _parsed(spark, path, _ply, "kind string, k int, x double, y double, z double, v0 int, v1 int, v2 int")
    return rows.filter("kind = 'v'").select(F.col("k").alias("v"), *XYZ), rows.filter("kind = 'f'").select(F.col("k").alias("f"), "v0", "v1", "v2")


def read_rtpi(spark: SparkSession, path: str) -> DataFrame:
    """strip, pos, r, t, p, i of a range image: comments, `RTPIv2 strips most`, then strips of a count and (three floats, an
    int) records."""
    def parse(content: bytes) -> pd.DataFrame:
        at = 0
        while True:
            stop = content.index(b"\n", at)
            line, at = content[at:stop], stop + 1
            if not line.startswith(b"#"):
                break
        words = line.split()
        if words[0] != b"RTPIv2":
            raise ValueError("not a range image of version 2")
        record = np.dtype([("r", "<f4"), ("t", "<f4"), ("p", "<f4"), ("i", "<i4")])
        parts = []
        for s in range(int(words[1])):
            n = struct.unpack_from("<I", content, at)[0]
            a = np.frombuffer(content, record, n, at + 4)
            at += 4 + n * record.itemsize
            parts.append(pd.DataFrame({"strip": s, "pos": np.arange(n), **{c: a[c].astype(float) for c in "rtp"}, "i": a["i"]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("strip", "pos", "r", "t", "p", "i")})

    return _parsed(spark, path, parse, "strip int, pos int, r double, t double, p double, i int")


def range_points(rtpi: DataFrame) -> DataFrame:
    """strip, pos, x, y, z, i: range, angle around and angle up to a point."""
    flat = F.col("r") * F.cos("p")
    return rtpi.select("strip", "pos", (flat * F.cos("t")).alias("x"), (flat * F.sin("t")).alias("y"), (F.col("r") * F.sin("p")).alias("z"), "i")


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`POINTS n ..` and `CELLS m ..`: verts(v, x, y, z) and faces(f, v0, v1, v2), one record a line."""
    rows = _numbered(spark, path, comments=False).withColumn("k", F.col("k") + 1)
    heads = {r["w"][0]: (r["k"], int(r["w"][1])) for r in rows.filter("w[0] in ('POINTS', 'CELLS')").collect()}
    (p, n), (c, m) = heads["POINTS"], heads["CELLS"]
    v = rows.filter(f"k > {p} and k <= {p + n}").select((F.col("k") - p - 1).alias("v"), *[_double(i, x) for i, x in enumerate(XYZ)])
    f = rows.filter(f"k > {c} and k <= {c + m}").select((F.col("k") - c - 1).alias("f"), *[F.col("w")[i + 1].cast("int").alias(f"v{i}") for i in range(3)])
    return v, f


def read_node_ele(spark: SparkSession, node: str, ele: str) -> tuple[DataFrame, DataFrame]:
    """A `.node` and an `.ele` file: verts(v, x, y, z) (z 0 in the plane) and faces(f, v0, v1, v2), numbered from 0."""
    a = _numbered(spark, node).withColumn("k", F.col("k") + 1)
    head = [int(x) for x in a.filter("k = 1").first()["w"][:3]]
    b = _numbered(spark, ele).withColumn("k", F.col("k") + 1)
    n = int(b.filter("k = 1").first()["w"][0])
    first = int(a.filter("k = 2").first()["w"][0])
    z = _double(3, "z") if head[1] > 2 else F.lit(0.0).alias("z")
    v = a.filter(f"k >= 2 and k <= {head[0] + 1}").select((F.col("w")[0].cast("int") - first).alias("v"), _double(1, "x"), _double(2, "y"), z)
    f = b.filter(f"k >= 2 and k <= {n + 1}").select((F.col("k") - 2).alias("f"), *[(F.col("w")[i + 1].cast("int") - first).alias(f"v{i}") for i in range(3)])
    return v, f


def read_surface(spark: SparkSession, path: str):
    """A reader by suffix: meshes and tetrahedra as (verts, cells), point sets, volumes and streams as one table."""
    from meshspark.sources import text, volume

    by = {
        ".m": text.read_m, ".off": text.read_off, ".sma": text.read_sma, ".obj": text.read_obj_mesh, ".offt": text.read_offt, ".asf": text.read_asf, ".pc": text.read_pc, ".flf": text.read_flf,
        ".ply": read_ply, ".vtk": read_vtk, ".sst": read_sst, ".smb": read_smb, ".rtpi": read_rtpi, ".nhdr": volume.read_nhdr, ".nooc": volume.read_blocked, ".vol": volume.read_raw,
    }
    name = path.removesuffix(".gz")
    for suffix, reader in by.items():
        if name.endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")
