"""Streaming meshes: stateful filters whose state ends with each vertex's finalize event.

Events are (m, seq, kind, v, x, y, z, t0, t1, t2) with kinds v (vertex), t (triangle) and x (the vertex is final). Rows are
grouped by mesh (or block) m, in which seq gives the order; within a micro-batch events are handled in that order, and
batches come in order. State is a map from vertex to what the filter keeps of it; a finalize event removes the entry, so
state holds the live front only. An event that names a vertex that isn't live gives an error row instead of being lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "m int, seq long, kind string, v int, x double, y double, z double, t0 int, t1 int, t2 int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "m int, seq long, kind string, v int, t0 int, t1 int, t2 int, a array<double>, n int"
COLUMNS = ["m", "seq", "kind", "v", "t0", "t1", "t2", "a", "n"]


class _Filter(StatefulProcessor):
    """Keeps a map from vertex to numbers; subclasses say what events do to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "v int", "a array<double>, n array<int>")

    def get(self, v: int):
        return self.live.getValue((v,)) if self.live.containsKey((v,)) else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        for e in events.itertuples(index=False):
            if e.kind == "v":
                self.live.updateValue((int(e.v),), self.start(e))
                continue
            names = [int(e.v)] if e.kind == "x" else [int(e.t0), int(e.t1), int(e.t2)]
            found = [self.get(v) for v in names]
            if any(f is None for f in found):
                out.append((int(key[0]), int(e.seq), "error", names[0], None, None, None, None, None))
            elif e.kind == "t":
                out += self.triangle(int(key[0]), e, names, found)
            else:
                out += self.final(int(key[0]), e, names[0], found[0])
                self.live.removeKey((names[0],))
        yield pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in ("m", "seq", "v", "t0", "t1", "t2", "n")})

    def close(self) -> None:
        pass

    def start(self, e):
        return [float(e.x), float(e.y), float(e.z)], []

    def triangle(self, m, e, names, found):
        return []

    def final(self, m, e, v, found):
        return []


class Dereference(_Filter):
    """Triangles with the nine coordinates of their corners."""

    def triangle(self, m, e, names, found):
        return [(m, int(e.seq), "t", None, *names, [float(c) for f in found for c in f[0]], None)]


class Normals(_Filter):
    """At each vertex's end the unit sum of its triangles' unit normals."""

    def start(self, e):
        return [float(e.x), float(e.y), float(e.z), 0.0, 0.0, 0.0], []

    def triangle(self, m, e, names, found):
        a, b, c = (np.array(f[0][:3]) for f in found)
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size > 0:
            for v, f in zip(names, found, strict=True):
                self.live.updateValue((v,), ([*f[0][:3], *(np.array(f[0][3:]) + n / size).tolist()], []))
        return []

    def final(self, m, e, v, found):
        n = np.array(found[0][3:])
        size = np.linalg.norm(n)
        return [(m, int(e.seq), "n", v, None, None, None, (n / size).tolist() if size else None, None)]


class Borders(_Filter):
    """At each vertex's end whether a neighbour was met an odd number of times: the vertex is on the border."""

    def triangle(self, m, e, names, found):
        for v, f in zip(names, found, strict=True):
            odd = set(f[1]).symmetric_difference(x for x in names if x != v)
            self.live.updateValue((v,), (list(f[0]), sorted(odd)))
        return []

    def final(self, m, e, v, found):
        return [(m, int(e.seq), "b", v, None, None, None, None, int(bool(len(found[1]))))]


FILTERS = {"dereference": Dereference, "normals": Normals, "borders": Borders}


def apply(events: DataFrame, name: str) -> DataFrame:
    """A filter over a streaming DataFrame of events."""
    return events.groupBy("m").transformWithStateInPandas(FILTERS[name](), OUT, "Append", "None")


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events as a stream of Parquet files, so many a micro-batch, in the order of their times."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def without_poor(dereferenced: DataFrame, cutoff: float) -> DataFrame:
    """Triangles of a dereferenced stream whose inverse mean ratio is below the cutoff."""
    from meshspark.functions import geometry as g

    corners = [tuple(F.col("a")[3 * k + i] for i in range(3)) for k in range(3)]
    return dereferenced.filter("kind = 't'").withColumn("imr", g.inverse_mean_ratio(*corners)).filter(F.col("imr") < cutoff)


def clusters(events: DataFrame, low: tuple, span: tuple, bits: int) -> DataFrame:
    """Vertices of a stream averaged by grid cell; for complete output."""
    steps = (1 << bits) - 1
    q = [F.floor((F.col(c) - lo) * steps / w + 0.5).cast("int") for c, lo, w in zip("xyz", low, span, strict=True)]
    v = events.filter("kind = 'v'").withColumn("cell", q[0] + (q[1] + q[2] * (1 << bits)) * (1 << bits))
    return v.groupBy("cell").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there, and read what it wrote."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")
