"""Geometry tables derived from the driver's relational tables, the same in Spark and in SQL.

Every function takes (spark, sf_dir). Volumes are groups of lineitem rows, meshes are built over the volume, points are
the leading coordinates of embeddings or attributes of parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vertex steps of the six tetrahedra of a cell: each goes from corner 0 to corner 7 along the axes in one order.
KUHN = [(0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7)]
ISO = 4.00001
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, label"""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label")


def pts_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z: parts spread over a box of side 50, 100 and 100."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_size").cast("double").alias("x"),
        (F.pmod(key * 7919, F.lit(10007)) / F.lit(100.07)).alias("y"), (F.pmod(key * 104729, F.lit(10009)) / F.lit(100.09)).alias("z"),
    )


def _grid(spark: SparkSession, sf_dir: str, x: str, y: str, z: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.expr(f"cast({x} as int)").alias("x"), F.expr(f"cast({y} as int)").alias("y"), F.expr(f"cast({z} as int)").alias("z"), F.col("l_linenumber").cast("long").alias("v"))
    return t.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.sum("v").alias("s")).withColumn("value", F.col("s").cast("double") / F.col("n"))


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z in 0..7, n, s, value = s / n: dense"""
    return _grid(spark, sf_dir, "l_partkey % 8", "l_orderkey % 8", "cast(l_quantity as int) % 8")


def vox16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y in 0..15, z in 0..7, n, s, value: may lack cells"""
    return _grid(spark, sf_dir, "l_partkey % 16", "l_orderkey % 16", "l_linenumber % 8")


def surf_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v = x + 8 y, x, y, z: a height field over the volume's columns"""
    h = vox(spark, sf_dir).groupBy("x", "y").agg((F.sum("s").cast("double") / F.sum("n")).alias("z"))
    return h.select((F.col("x") + SIDE * F.col("y")).alias("v"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "z")


def surf_f(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """f, v0, v1, v2: two triangles for each square of the height field"""
    q = spark.range(49).select((F.col("id") % 7).cast("int").alias("x"), F.expr("cast(id div 7 as int)").alias("y"))
    a = F.col("x") + SIDE * F.col("y")
    f = 2 * (F.col("x") + 7 * F.col("y"))
    one = F.struct(f.alias("f"), a.alias("v0"), (a + 1).alias("v1"), (a + 9).alias("v2"))
    two = F.struct((f + 1).alias("f"), a.alias("v0"), (a + 9).alias("v1"), (a + 8).alias("v2"))
    return q.select(F.explode(F.array(one, two)).alias("t")).select("t.*")


def surf_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, v0, v1, v2 with corners ax .. cz"""
    return corners(surf_f(spark), surf_v(spark, sf_dir))


def corners(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: ax, ay, az, bx, .., cz."""
    for k, p in enumerate("abc"):
        v = verts.select(F.col("v").alias(f"v{k}"), *[F.col(c).alias(p + c) for c in "xyz"])
        faces = faces.join(v, f"v{k}")
    return faces.select("f", "v0", "v1", "v2", *[p + c for p in "abc" for c in "xyz"])


def tverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v = x + 8 y + 64 z, x, y, z, s: the volume's grid points with their value"""
    v = F.col("x") + SIDE * F.col("y") + SIDE * SIDE * F.col("z")
    return vox(spark, sf_dir).select(v.alias("v"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("value").alias("s"))


def tets(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """t, v0, v1, v2, v3: six tetrahedra for each cell"""
    c = spark.range(343).select(F.col("id"), (F.col("id") % 7).cast("int").alias("x"), F.expr("cast(id div 7 as int) % 7").alias("y"), F.expr("cast(id div 49 as int)").alias("z"))
    base = F.col("x") + SIDE * F.col("y") + SIDE * SIDE * F.col("z")
    corner = lambda k: base + (k & 1) + SIDE * (k >> 1 & 1) + SIDE * SIDE * (k >> 2 & 1)
    rows = F.array(*[F.struct((6 * F.col("id") + i).cast("int").alias("t"), *[corner(k).alias(f"v{j}") for j, k in enumerate(path)]) for i, path in enumerate(KUHN)])
    return c.select(F.explode(rows).alias("t")).select("t.*")


def tet_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, v0..v3 with corners ax .. dz and scalars as .. ds"""
    out, verts = tets(spark), tverts(spark, sf_dir)
    for k, p in enumerate("abcd"):
        out = out.join(verts.select(F.col("v").alias(f"v{k}"), *[F.col(c).alias(p + c) for c in "xyzs"]), f"v{k}")
    return out.select("t", "v0", "v1", "v2", "v3", *[p + c for p in "abcd" for c in "xyzs"])


def soup_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m, f with corners: the height field, and a copy shifted by one in x"""
    t = surf_t(spark, sf_dir)
    xs = [p + "x" for p in "abc"]
    two = t.withColumns({c: F.col(c) + 1 for c in xs})
    return t.withColumn("m", F.lit(0)).unionByName(two.withColumn("m", F.lit(1)))


def segm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, mat: a volume of three materials"""
    return vox(spark, sf_dir).select("x", "y", "z", F.expr("cast(floor(value * 10) as int) % 3").alias("mat"))


def mev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, kind, v, x, y, z, t0, t1, t2: the height field as events. Each vertex comes before its first triangle, and its
    finalize event after its last."""
    f, v = surf_f(spark), surf_v(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    use = f.select("f", F.explode(F.array("v0", "v1", "v2")).alias("v")).groupBy("v").agg(F.min("f").alias("first"), F.max("f").alias("last"))
    vert = v.join(use, "v").select((F.col("first").cast("long") * 1000 + F.col("v")).alias("seq"), F.lit("v").alias("kind"), "v", "x", "y", "z", *[none("int").alias(c) for c in ("t0", "t1", "t2")])
    tri = f.select((F.col("f").cast("long") * 1000 + 500).alias("seq"), F.lit("t").alias("kind"), F.col("f").alias("v"), *[none("double").alias(c) for c in "xyz"], F.col("v0").alias("t0"), F.col("v1").alias("t1"), F.col("v2").alias("t2"))
    fin = use.select((F.col("last").cast("long") * 1000 + 600 + F.col("v")).alias("seq"), F.lit("x").alias("kind"), "v", *[none("double").alias(c) for c in "xyz"], *[none("int").alias(c) for c in ("t0", "t1", "t2")])
    return vert.unionByName(tri).unionByName(fin)


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, value: events by user and type"""
    t = table(spark, sf_dir, "events").select(F.expr("cast(user_id % 64 as int)").alias("u"), F.col("event_type").alias("v"), F.expr("cast(round(value * 100) as bigint)").alias("c"))
    return t.groupBy("u", "v").agg(F.sum("c").alias("c")).withColumn("value", F.col("c") / F.lit(100.0))


#: The same tables as SQL common table expressions.
SQL = {
    "pts": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings",
    "pts_big": "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, ((p_partkey * 7919) % 10007) / 100.07::DOUBLE AS y, ((p_partkey * 104729) % 10009) / 100.09::DOUBLE AS z FROM part",
    "vox": "SELECT x, y, z, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v) AS DOUBLE) / count(*) AS value FROM (SELECT CAST(l_partkey % 8 AS INT) AS x, CAST(l_orderkey % 8 AS INT) AS y, CAST(l_quantity AS INT) % 8 AS z, CAST(l_linenumber AS BIGINT) AS v FROM lineitem) GROUP BY x, y, z",
    "vox16": "SELECT x, y, z, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v) AS DOUBLE) / count(*) AS value FROM (SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_orderkey % 16 AS INT) AS y, CAST(l_linenumber % 8 AS INT) AS z, CAST(l_linenumber AS BIGINT) AS v FROM lineitem) GROUP BY x, y, z",
    "surf_v": "SELECT x + 8 * y AS v, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS z FROM vox GROUP BY x, y",
    "surf_f": "SELECT CAST(2 * q + k AS INT) AS f, CAST(a AS INT) AS v0, CAST(CASE k WHEN 0 THEN a + 1 ELSE a + 9 END AS INT) AS v1, CAST(CASE k WHEN 0 THEN a + 9 ELSE a + 8 END AS INT) AS v2 FROM (SELECT q, q % 7 + 8 * (q // 7) AS a FROM range(49) r(q)), range(2) s(k)",
    "surf_t": "SELECT f, v0, v1, v2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM surf_f JOIN surf_v a ON a.v = v0 JOIN surf_v b ON b.v = v1 JOIN surf_v c ON c.v = v2",
    "tverts": "SELECT x + 8 * y + 64 * z AS v, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, value AS s FROM vox",
    "tets": "SELECT CAST(6 * c + k AS INT) AS t, CAST(b AS INT) AS v0, CAST(b + p[1] AS INT) AS v1, CAST(b + p[2] AS INT) AS v2, CAST(b + 73 AS INT) AS v3 FROM (SELECT c, c % 7 + 8 * (c // 7 % 7) + 64 * (c // 49) AS b FROM range(343) r(c)), (SELECT 0 AS k, [1, 9] AS p UNION ALL SELECT 1, [1, 65] UNION ALL SELECT 2, [8, 9] UNION ALL SELECT 3, [8, 72] UNION ALL SELECT 4, [64, 65] UNION ALL SELECT 5, [64, 72])",
    "tet_c": "SELECT t, v0, v1, v2, v3, a.x AS ax, a.y AS ay, a.z AS az, a.s AS sa, b.x AS bx, b.y AS by, b.z AS bz, b.s AS sb, c.x AS cx, c.y AS cy, c.z AS cz, c.s AS sc, d.x AS dx, d.y AS dy, d.z AS dz, d.s AS sd FROM tets JOIN tverts a ON a.v = v0 JOIN tverts b ON b.v = v1 JOIN tverts c ON c.v = v2 JOIN tverts d ON d.v = v3",
    "soup": "SELECT m, f, v0, v1, v2, ax + m AS ax, ay, az, bx + m AS bx, by, bz, cx + m AS cx, cy, cz FROM surf_t, (SELECT CAST(i AS INT) AS m FROM range(2) r(i))",
    "segm": "SELECT x, y, z, CAST(floor(value * 10) AS INT) % 3 AS mat FROM vox",
    "used": "SELECT v, min(f) AS first, max(f) AS last FROM (SELECT f, unnest([v0, v1, v2]) AS v FROM surf_f) GROUP BY v",
    "mev": "SELECT CAST(first AS BIGINT) * 1000 + v AS seq, 'v' AS kind, v, x, y, z, CAST(NULL AS INT) AS t0, CAST(NULL AS INT) AS t1, CAST(NULL AS INT) AS t2 FROM surf_v JOIN used USING (v) UNION ALL SELECT CAST(f AS BIGINT) * 1000 + 500, 't', f, NULL, NULL, NULL, v0, v1, v2 FROM surf_f UNION ALL SELECT CAST(last AS BIGINT) * 1000 + 600 + v, 'x', v, NULL, NULL, NULL, NULL, NULL, NULL FROM used",
    "img": "SELECT u, v, CAST(sum(c) AS BIGINT) AS c, CAST(sum(c) AS BIGINT) / 100.0::DOUBLE AS value FROM (SELECT CAST(user_id % 64 AS INT) AS u, event_type AS v, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY u, v",
    "edges": "SELECT f, i, a, b FROM (SELECT f, 0 AS i, v0 AS a, v1 AS b FROM surf_f UNION ALL SELECT f, 1, v1, v2 FROM surf_f UNION ALL SELECT f, 2, v2, v0 FROM surf_f)",
}
NEEDS = {"surf_v": ["vox"], "surf_t": ["surf_f", "surf_v"], "tverts": ["vox"], "tet_c": ["tets", "tverts"], "soup": ["surf_t"], "segm": ["vox"], "used": ["surf_f"], "mev": ["surf_v", "used"], "edges": ["surf_f"]}


def with_tables(body: str, *names: str) -> str:
    """SQL with the named derived tables, and what they need, before it. A body that begins with WITH goes on."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
    body = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    text = f"WITH {recursive}{head}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
    return re.sub(r"\b(by|at)\b", r'"\1"', text)  # column names that are words of SQL
