"""Writers of text formats. A mesh file is one ordered text, so its lines go to one part; partitioned output is Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshspark.operators.order import running


def _number(c: str):
    return F.col(c).cast("string")


def _text(parts: list[DataFrame], path: str) -> None:
    """Parts (k, line) one after another, each by k."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), F.col("k").cast("long").alias("k"), "line")
        out = p if out is None else out.unionByName(p)
    out.sort("part", "k").select("line").coalesce(1).write.text(path)


def mesh_lines(verts: DataFrame, faces: DataFrame, style: str) -> list[DataFrame]:
    xyz = [_number(c) for c in "xyz"]
    one = [(F.col(f"v{i}") + 1).cast("string") for i in range(3)]
    zero = [_number(f"v{i}") for i in range(3)]
    spark = verts.sparkSession
    if style == "m":
        v = F.concat_ws(" ", F.lit("Vertex"), (F.col("v") + 1).cast("string"), *xyz)
        f = F.concat_ws(" ", F.lit("Face"), (F.col("f") + 1).cast("string"), *one)
        return [verts.select(F.col("v").alias("k"), v.alias("line")), faces.select(F.col("f").alias("k"), f.alias("line"))]
    if style in ("obj", "sma"):  # faces from 1
        v, f = F.concat_ws(" ", F.lit("v"), *xyz), F.concat_ws(" ", F.lit("f"), *one)
        return [verts.select(F.col("v").alias("k"), v.alias("line")), faces.select(F.col("f").alias("k"), f.alias("line"))]
    if style == "off":
        counts = verts.agg(F.count("*").alias("nv")).crossJoin(faces.agg(F.count("*").alias("nf")))
        head = spark.createDataFrame([(0, "OFF")], "k long, line string")
        size = counts.select(F.lit(1).alias("k"), F.concat_ws(" ", "nv", "nf", F.lit("0")).alias("line"))
        v, f = F.concat_ws(" ", *xyz), F.concat_ws(" ", F.lit("3"), *zero)
        return [head, size, verts.select(F.col("v").alias("k"), v.alias("line")), faces.select(F.col("f").alias("k"), f.alias("line"))]
    if style == "vtk":
        counts = verts.agg(F.count("*").alias("nv")).first()[0], faces.count()
        head = "# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID"
        a = spark.createDataFrame([(0, head), (1, f"POINTS {counts[0]} double")], "k long, line string")
        b = spark.createDataFrame([(0, f"CELLS {counts[1]} {4 * counts[1]}")], "k long, line string")
        c = spark.createDataFrame([(0, f"CELL_TYPES {counts[1]}")], "k long, line string")
        return [a, verts.select(F.col("v").alias("k"), F.concat_ws(" ", *xyz).alias("line")), b, faces.select(F.col("f").alias("k"), F.concat_ws(" ", F.lit("3"), *zero).alias("line")), c, faces.select(F.col("f").alias("k"), F.lit("5").alias("line"))]
    if style == "ply":
        nv, nf = verts.count(), faces.count()
        head = f"ply\nformat ascii 1.0\nelement vertex {nv}\nproperty double x\nproperty double y\nproperty double z\nelement face {nf}\nproperty list uchar int vertex_indices\nend_header"
        a = spark.createDataFrame([(0, head)], "k long, line string")
        return [a, verts.select(F.col("v").alias("k"), F.concat_ws(" ", *xyz).alias("line")), faces.select(F.col("f").alias("k"), F.concat_ws(" ", F.lit("3"), *zero).alias("line"))]
    raise ValueError(style)


def write_mesh(verts: DataFrame, faces: DataFrame, path: str, style: str) -> None:
    """style: m, obj, sma, off, vtk or ply"""
    _text(mesh_lines(verts, faces, style), path)


def write_points(points: DataFrame, path: str) -> None:
    """`v` lines, and `vn` lines of normals of at least half a unit."""
    v = points.select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("v"), *[_number(c) for c in "xyz"]).alias("line"))
    parts = [v]
    if "nx" in points.columns:
        long = points.filter("nx * nx + ny * ny + nz * nz >= 0.25")
        parts.append(long.select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("vn"), *[_number("n" + c) for c in "xyz"]).alias("line")))
    _text(parts, path)


def write_points_all(points: DataFrame, path: str) -> None:
    """`v` lines, and a `vn` line for every point, so that both are in one order."""
    lines = [points.select(F.col("id").alias("k"), F.concat_ws(" ", F.lit(tag), *[_number(p + c) for c in "xyz"]).alias("line")) for tag, p in (("v", ""), ("vn", "n"))]
    _text(lines, path)


def write_lengths(lengths: DataFrame, path: str) -> None:
    """(id, ideal): one length a line, in order of the points."""
    _text([lengths.select(F.col("id").alias("k"), _number("ideal").alias("line"))], path)


def write_flf(points: DataFrame, loops: DataFrame, path: str) -> None:
    """points(id, x, y, z, is_corner) and loops(loop, pos, id, nx, ny, nz): counts, points with corner flags, and each loop's
    members as `index nx ny nz`."""
    spark = points.sparkSession
    order = running(points.select("id"), ["id"], {"k": None})
    flat = points.select(F.col("id").alias("k"), F.concat_ws(" ", *[_number(c) for c in "xyz"], F.col("is_corner").cast("int").cast("string")).alias("line"))
    line = F.concat_ws(" ", F.col("k").cast("string"), *[_number("n" + c) for c in "xyz"])
    rows = loops.join(order, "id").groupBy("loop").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("m"))
    body = rows.select(F.col("loop").alias("k"), F.concat_ws("\n", F.size("m").cast("string"), F.array_join("m.line", "\n")).alias("line"))
    counts = [spark.createDataFrame([(0, str(n))], "k long, line string") for n in (points.count(), rows.count())]
    _text([counts[0], flat, counts[1], body], path)


def write_stream(events: DataFrame, path: str) -> None:
    """An event list as a streaming mesh: `v`, `f` from 1 and `x` lines in order.

    Vertices are numbered by their events.
    """
    ids = running(events.filter("kind = 'v'").select("v", "seq"), ["seq"]).select("v", (F.col("place") + 1).alias("new"))
    e = events
    for c in ("t0", "t1", "t2"):
        e = e.join(ids.select(F.col("v").alias(c), F.col("new").alias("n" + c)), c, "left")
    e = e.join(ids.select(F.col("v").alias("v"), "new"), "v", "left")
    line = F.when(F.col("kind") == "v", F.concat_ws(" ", F.lit("v"), *[_number(c) for c in "xyz"])).when(F.col("kind") == "t", F.concat_ws(" ", F.lit("f"), "nt0", "nt1", "nt2")).otherwise(F.concat_ws(" ", F.lit("x"), "new"))
    _text([e.select(F.col("seq").alias("k"), line.alias("line"))], path)


def write_pc(points: DataFrame, path: str) -> None:
    """Points with a corner flag."""
    spark = points.sparkSession
    head = spark.createDataFrame([(0, "PC file\n# x y z corner\n#\n#\n#\n# points"), (1, str(points.count()))], "k long, line string")
    body = points.select(F.col("id").alias("k"), F.concat_ws(" ", *[_number(c) for c in "xyz"], F.col("is_corner").cast("int").cast("string")).alias("line"))
    _text([head, body], path)


def write_ppm(image: DataFrame, path: str, top: int) -> None:
    """(u, v, value) as a text image of grey pixels, a line of it a row v; missing pixels are black."""
    spark = image.sparkSession
    size = image.agg(F.max("u").alias("u"), F.max("v").alias("v")).first()
    width, height = (int(size["u"]) + 1, int(size["v"]) + 1) if size["u"] is not None else (0, 0)
    head = spark.createDataFrame([(0, f"P3\n{width} {height}\n{top}")], "k long, line string")
    rows = image.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("u", F.greatest(F.lit(0), F.least(F.lit(top), F.col("value").cast("int"))).alias("c")))).alias("m"))
    rows = spark.range(height).select(F.col("id").cast("int").alias("v")).join(rows, "v", "left")
    pixel = F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda u: F.repeat(F.concat(F.coalesce(F.try_element_at("m", u), F.lit(0)).cast("string"), F.lit(" ")), F.lit(3)))
    _text([head, rows.select(F.col("v").alias("k"), F.rtrim(F.array_join(pixel, "")).alias("line"))], path)
