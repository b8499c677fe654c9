"""Queries that run the streaming filters over the event list to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.plans.mesh_queries import NORMALS
from meshspark.plans.registry import query, s6
from meshspark.shared import fresh
from meshspark.streaming import mesh_stream as ms

BATCHES = 4


def _run(spark, sf, name: str):
    """Two meshes, their events in four micro-batches."""
    path = fresh(spark, "stream")
    events = fx.mev(spark, sf).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    events = events.select("m", F.col("seq").cast("long").alias("seq"), "kind", "v", "x", "y", "z", "t0", "t1", "t2")
    step = 98_000 // BATCHES
    for k in range(BATCHES):
        last = F.lit(True) if k == BATCHES - 1 else F.col("seq") < (k + 1) * step
        events.filter((F.col("seq") >= k * step) & last).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return ms.drain(ms.apply(ms.source(spark, f"{path}/in"), name), f"{path}/{name}")


_TWO = "(SELECT CAST(i AS INT) AS m FROM range(2) r(i))"


@query(f"SELECT m, v0 AS t0, v1 AS t1, v2 AS t2, round(az, 6) AS az, round(bz, 6) AS bz, round(cz, 6) AS cz FROM surf_t, {_TWO}", "surf_t")
def stream_dereference(spark, sf):
    """Triangles of the stream with coordinates"""
    out = _run(spark, sf, "dereference")
    return out.select("m", "t0", "t1", "t2", *[F.round(F.col("a")[3 * k + 2], 6).alias(p + "z") for k, p in enumerate("abc")])


@query(
    f"WITH n AS ({NORMALS}), s AS (SELECT v, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM (SELECT unnest([v0, v1, v2]) AS v, nx, ny, nz FROM n) GROUP BY v) SELECT m, v, {', '.join(s6(f's{c} / sqrt(sx * sx + sy * sy + sz * sz)', 'n' + c) for c in 'xyz')} FROM s, {_TWO}",
    "surf_t",
)
def stream_normals(spark, sf):
    """Vertex normals of the stream"""
    out = _run(spark, sf, "normals")
    return out.select("m", "v", *[(F.round(F.col("a")[i], 6) + F.lit(0.0)).alias("n" + c) for i, c in enumerate("xyz")])


@query(f"WITH n AS (SELECT a AS v, b AS w FROM edges UNION ALL SELECT b, a FROM edges), o AS (SELECT DISTINCT v FROM (SELECT v, w FROM n GROUP BY v, w HAVING count(*) % 2 = 1)) SELECT m, v, CASE WHEN v IN (SELECT v FROM o) THEN 1 ELSE 0 END AS n FROM surf_v, {_TWO}", "edges", "surf_v")
def stream_borders(spark, sf):
    """Border vertices of the stream"""
    return _run(spark, sf, "borders").select("m", "v", "n")
