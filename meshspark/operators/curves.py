"""Curves as (curve, pos, x, y, z): lengths, resampling, curvature, iso-line chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshspark.functions import geometry as g


def arc_lengths(points: DataFrame) -> DataFrame:
    """points with s: the length along the curve up to each."""
    w = Window.partitionBy("curve").orderBy("pos")
    last = tuple(F.lag(c).over(w) for c in "xyz")
    d = points.withColumn("d", F.coalesce(g.dist(g.vec(), last), F.lit(0.0)))
    return d.withColumn("s", F.sum(F.round("d", 12)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("d")


def resample(points: DataFrame, spacing: str = "ideal") -> DataFrame:
    """curve, pos, x, y, z: each curve cut into whole steps of about its spacing (a column, linear between points).

    A first pass counts the steps that the spacing asks for, a second one stretches them to fill the curve.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = group.sort_values("pos")
        xyz = p[["x", "y", "z"]].to_numpy(float)
        s = np.concatenate(([0.0], np.cumsum(np.linalg.norm(np.diff(xyz, axis=0), axis=1))))
        if s[-1] == 0:
            return pd.DataFrame({"curve": p["curve"].iloc[:1], "pos": [0], "x": xyz[:1, 0], "y": xyz[:1, 1], "z": xyz[:1, 2]})
        # Steps so far: the integral of one over the spacing, exact for constant spacing on a piece.
        h = p[spacing].to_numpy(float)
        count = np.concatenate(([0.0], np.cumsum(np.diff(s) * 2 / (h[1:] + h[:-1]))))
        n = max(1, round(count[-1]))
        at = np.interp(np.arange(n + 1) * count[-1] / n, count, s)
        return pd.DataFrame({"curve": p["curve"].iloc[0], "pos": np.arange(n + 1), **{c: np.interp(at, s, xyz[:, i]) for i, c in enumerate("xyz")}})

    kind = points.schema["curve"].dataType.simpleString()
    return points.groupBy("curve").applyInPandas(run, f"curve {kind}, pos long, x double, y double, z double")


def curvature(points: DataFrame, radius: float) -> DataFrame:
    """curve, pos, k: curvature from a weighted quadratic in arc length around each point."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = group.sort_values("pos")
        s, xyz = p["s"].to_numpy(float), p[["x", "y", "z"]].to_numpy(float)
        out = []
        for i in range(len(p)):
            near = np.abs(s - s[i]) <= radius
            t = s[near] - s[i]
            w = np.sqrt(np.maximum(0, 1 - (t / radius) ** 2) ** 2 + 1e-12)
            if near.sum() < 3:
                out.append(np.nan)
                continue
            c = np.linalg.lstsq(np.stack([np.ones_like(t), t, t * t / 2], 1) * w[:, None], xyz[near] * w[:, None], rcond=None)[0]
            out.append(np.linalg.norm(np.cross(c[1], c[2])) / max(np.linalg.norm(c[1]) ** 3, 1e-300))
        return pd.DataFrame({"curve": p["curve"], "pos": p["pos"], "k": out})

    kind = points.schema["curve"].dataType.simpleString()
    return arc_lengths(points).groupBy("curve").applyInPandas(run, f"curve {kind}, pos long, k double")


def chains(segments: DataFrame) -> DataFrame:
    """curve, n, length of the chains that segments (p, q: ids of ends, len) form."""
    from meshspark.operators.graph import components

    root = components(segments.select(F.col("p").alias("a"), F.col("q").alias("b")))
    return segments.join(root, F.col("p") == F.col("v")).groupBy(F.col("root").alias("curve")).agg(F.count("*").alias("n"), F.sum("len").alias("length"))
