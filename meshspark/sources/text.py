"""Readers of text formats. Each returns DataFrames with the ids of the file, made dense where the format leaves gaps.

Lines get their number from their split of the file and their row in it, so large files are read by many tasks; only feature
loops, whose records run over lines, are read a file a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.operators.order import running
from meshspark.sources.files import contents

XYZ = ["x", "y", "z"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their fields split at white space, comments and blanks left out."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("line"))
    return t.filter("line <> ''").select("line", F.split("line", r"\s+").alias("w"))


def _numbered(spark: SparkSession, path: str, comments: bool = True, tags: tuple[str, ...] = ()) -> DataFrame:
    """n, k, line, w: lines of one file but blank ones, in order; n is the place of a line among all, k among those kept.

    For each tag, `n_tag` is the number of lines that begin with it up to this one. A file is read in splits: a line's place
    is that of its split and its row there.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    line = F.trim(F.regexp_replace("value", r"#.*$", "")) if comments else F.trim("value")
    rows = spark.read.text(path).select(line.alias("line"), *place).withColumn("w", F.split("line", r"\s+"))
    counts = {"kept": F.col("line") != "", **{"is_" + t: F.col("w")[0] == t for t in tags}}
    rows = rows.withColumns({k: c.cast("int") for k, c in counts.items()})
    rows = running(rows, ["file", "start", "row"], {"n": None, "k": "kept", **{"n_" + t: "is_" + t for t in tags}}).filter("kept = 1")
    return rows.select(F.col("n").cast("int").alias("n"), (F.col("k") - 1).cast("int").alias("k"), "line", "w", *[F.col("n_" + t).cast("int").alias("n_" + t) for t in tags])


def _double(i: int, name: str):
    return F.col("w")[i].cast("double").alias(name)


def read_m(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`Vertex i x y z {..}` and `Face i a b c`, ids from 1 and with gaps: dense verts(v, x, y, z) and faces(f, v0, v1, v2).

    An `Opos=(x y z)` between the braces is the position where it is given.
    """
    lines = _lines(spark, path)
    opos = r"Opos=\(\s*(\S+)\s+(\S+)\s+(\S+?)\s*\)"
    v = lines.filter("w[0] = 'Vertex'").select(F.col("w")[1].cast("int").alias("id"), *[
        F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(line, r'{opos}', {i + 1}), '') as double)"), F.expr(f"try_cast(w[{i + 2}] as double)")).alias(c) for i, c in enumerate(XYZ)
    ])
    v = running(v, ["id"], {"v": None}).withColumn("v", F.col("v").cast("int"))
    f = lines.filter("w[0] = 'Face'").select(F.col("w")[1].cast("int").alias("fid"), *[F.col("w")[i + 2].cast("int").alias(f"i{i}") for i in range(3)])
    f = running(f, ["fid"], {"f": None}).withColumn("f", F.col("f").cast("int"))
    for k in range(3):
        f = f.join(v.select(F.col("id").alias(f"i{k}"), F.col("v").alias(f"v{k}")), f"i{k}")
    return v.select("v", *XYZ), f.select("f", "v0", "v1", "v2")


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`OFF`, counts, coordinates, `3 a b c` from 0. Larger polygons keep their first three ids."""
    rows = _numbered(spark, path)
    nv, nf = (int(x) for x in rows.filter("k = 1").first()["w"][:2])
    v = rows.filter(f"k >= 2 and k < {2 + nv}").select((F.col("k") - 2).alias("v"), *[_double(i, c) for i, c in enumerate(XYZ)])
    f = rows.filter(f"k >= {2 + nv} and k < {2 + nv + nf}").select((F.col("k") - 2 - nv).alias("f"), *[F.col("w")[i + 1].cast("int").alias(f"v{i}") for i in range(3)])
    return v, f


def _tagged(rows: DataFrame, tag: str) -> DataFrame:
    """Lines of one tag, k their place among them."""
    return rows.filter(F.col("w")[0] == tag).withColumn("k", F.col("n_" + tag) - 1)


def read_sma(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`v x y z` and `f a b c` from 1."""
    rows = _numbered(spark, path, tags=("v", "f"))
    v = _tagged(rows, "v").select(F.col("k").alias("v"), *[_double(i + 1, c) for i, c in enumerate(XYZ)])
    f = _tagged(rows, "f").select(F.col("k").alias("f"), *[(F.split(F.col("w")[i + 1], "/")[0].cast("int") - 1).alias(f"v{i}") for i in range(3)])
    return v, f


#: Triangles of .obj files have the same lines, with `a/b/c` references.
read_obj_mesh = read_sma


def read_obj_points(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, nx, ny, nz, r, g, b of `v`, `vn` and `vc` lines; null where a kind is missing."""
    rows = _numbered(spark, path, tags=("v", "vn", "vc"))
    out = _tagged(rows, "v").select(F.col("k").alias("id"), *[_double(i + 1, c) for i, c in enumerate(XYZ)])
    n = _tagged(rows, "vn").select(F.col("k").alias("id"), *[_double(i + 1, "n" + c) for i, c in enumerate(XYZ)])
    c = _tagged(rows, "vc").select(F.col("k").alias("id"), *[F.col("w")[i + 1].cast("double").cast("int").alias(x) for i, x in enumerate("rgb")])
    return out.join(n, "id", "left").join(c, "id", "left")


def read_asf(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, nx, ny, nz, radius"""
    rows = running(_numbered(spark, path).filter("size(w) >= 7"), ["n"], {"id": None})
    return rows.select(F.col("id").cast("int").alias("id"), *[_double(i, c) for i, c in enumerate([*XYZ, "nx", "ny", "nz", "radius"])])


def read_pc(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, is_corner: a tag line, four comment lines, a list comment, the count, then the points."""
    rows = _numbered(spark, path, comments=False)
    n = int(rows.filter("n = 6").first()["w"][0])
    body = rows.filter(f"n > 6 and n <= {6 + n}")
    return body.select((F.col("n") - 7).alias("id"), *[_double(i, c) for i, c in enumerate(XYZ)], (F.col("w")[3].cast("int") != 0).alias("is_corner"))


def read_offt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`nv nt`, `x y z [s]`, `a b c d`: verts(v, x, y, z, s) with missing scalars 0, tets(t, v0 .. v3) of positive volume."""
    rows = _numbered(spark, path)
    nv, nt = (int(x) for x in rows.filter("k = 0").first()["w"][:2])
    v = rows.filter(f"k >= 1 and k <= {nv}").select((F.col("k") - 1).alias("v"), *[_double(i, c) for i, c in enumerate(XYZ)], F.coalesce(F.get("w", F.lit(3)).cast("double"), F.lit(0.0)).alias("s"))
    t = rows.filter(f"k > {nv} and k <= {nv + nt}").select((F.col("k") - 1 - nv).alias("t"), *[F.col("w")[i].cast("int").alias(f"v{i}") for i in range(4)])
    from meshspark.functions import geometry as g

    full = t
    for k, p in enumerate("abcd"):
        full = full.join(v.select(F.col("v").alias(f"v{k}"), *[F.col(c).alias(p + c) for c in XYZ]), f"v{k}")
    turned = g.signed_volume(*[g.vec(p) for p in "abcd"]) < 0
    return v, full.select("t", "v0", "v1", F.when(turned, F.col("v3")).otherwise(F.col("v2")).alias("v2"), F.when(turned, F.col("v2")).otherwise(F.col("v3")).alias("v3"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """id, ideal: one length a line"""
    return _numbered(spark, path).select(F.col("k").alias("id"), _double(0, "ideal"))


def read_stream_sma(spark: SparkSession, path: str) -> DataFrame:
    """seq, kind, v, x, y, z, t0, t1, t2, f0, f1, f2 of a streaming mesh.

    `v` lines number vertices from 0. An id of an `f` line is from 1, or negative: counted back from the vertices so far,
    and the vertex is final with this triangle. `x` lines name a final vertex. Other lines are skipped.
    """
    rows = _numbered(spark, path, tags=("v",)).filter("w[0] in ('v', 'f', 'x')").withColumnRenamed("n_v", "c")
    raw = [F.expr(f"try_cast(get(w, {i + 1}) as int)") for i in range(3)]
    kind = F.col("w")[0]
    ident = [F.when(r < 0, F.col("c") + r).otherwise(r - 1) for r in raw]
    return rows.select(
        F.col("n").cast("long").alias("seq"), F.when(kind == "f", "t").otherwise(kind).alias("kind"),
        F.when(kind == "v", F.col("c") - 1).when(kind == "x", ident[0]).cast("int").alias("v"),
        *[F.when(kind == "v", F.expr(f"try_cast(get(w, {i + 1}) as double)")).alias(c) for i, c in enumerate(XYZ)],
        *[F.when(kind == "f", ident[i]).cast("int").alias(f"t{i}") for i in range(3)],
        *[F.when(kind == "f", raw[i] < 0).alias(f"f{i}") for i in range(3)],
    )


def read_flf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Feature loops: points(i, x, y, z, is_corner) and loops(loop, pos, i, nx, ny, nz).

    A count and that many points, then a count of loops, each a count and that many `index nx ny nz` lines.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["t"]:
                words = iter([w for line in text.split("\n") for w in line.split("#")[0].split()])
                out = []
                for i in range(int(next(words))):
                    x, y, z, c = (next(words) for _ in range(4))
                    out.append(("p", i, 0, i, float(x), float(y), float(z), bool(int(c))))
                for k in range(int(next(words))):
                    for pos in range(int(next(words))):
                        i, x, y, z = (next(words) for _ in range(4))
                        out.append(("l", k, pos, int(i), float(x), float(y), float(z), False))
                yield pd.DataFrame(out, columns=["kind", "loop", "pos", "i", "x", "y", "z", "is_corner"])

    text = contents(spark, path).select(F.col("content").cast("string").alias("t"))
    rows = text.mapInPandas(parse, "kind string, loop int, pos int, i int, x double, y double, z double, is_corner boolean")
    points = rows.filter("kind = 'p'").select("i", *XYZ, "is_corner")
    return points, rows.filter("kind = 'l'").select("loop", "pos", "i", *[F.col(c).alias("n" + c) for c in XYZ])
