"""Advancing-front meshing, a kernel per block.

A front is a set of directed edges with the open region on their left. The edge whose triangle promises to be best shaped
advances: towards a new vertex at the step length that the field asks for, or to a vertex of the front that is near the new
place, if the triangle is legal (turned left, no front edge crossed, no front vertex inside). Where neither is legal the edge
takes the best legal vertex of the whole front, which always exists, so every front closes. Blocks share the vertices on
their common borders, which are cut before by the same rule from either side; so blocks are meshed apart and fit together.

The plane is the domain; heights come from a surface afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAP = 0.75
CLEAR = 0.45


def _turn(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


class Front:
    """Vertices so far and the open edges."""

    def __init__(self, loops: list[np.ndarray], step: Callable[[np.ndarray], float]):
        self.points = np.concatenate(loops).astype(float)
        self.step = step
        self.edges: set[tuple[int, int]] = set()
        self.triangles: list[tuple[int, int, int]] = []
        self.heap: list[tuple[float, int, int]] = []
        at = 0
        for loop in loops:
            for i in range(len(loop)):
                self.open(at + i, at + (i + 1) % len(loop))
            at += len(loop)

    def open(self, a: int, b: int) -> None:
        """Add an edge, or close the opposite one."""
        if (b, a) in self.edges:
            self.edges.remove((b, a))
            return
        self.edges.add((a, b))
        length = float(np.linalg.norm(self.points[b] - self.points[a]))
        # Edges far from their ideal length come later.
        ideal = self.step((self.points[a] + self.points[b]) / 2)
        heapq.heappush(self.heap, (max(length / ideal, ideal / length), a, b))

    def crossed(self, p: np.ndarray, q: np.ndarray, skip: set[int]) -> bool:
        """Whether an open edge without a vertex in skip meets the segment."""
        e = np.array([x for x in self.edges if not (x[0] in skip or x[1] in skip)])
        if not len(e):
            return False
        a, b = self.points[e[:, 0]], self.points[e[:, 1]]
        one = _turn(p, q, a) * _turn(p, q, b)
        two = _turn(a, b, p) * _turn(a, b, q)
        return bool(((one <= 0) & (two <= 0)).any())

    def legal(self, a: int, b: int, c: np.ndarray, ident: int | None) -> bool:
        p, q = self.points[a], self.points[b]
        if _turn(p, q, c) <= 1e-12:
            return False
        live = np.array(sorted({v for e in self.edges for v in e} - {a, b, ident}))
        if len(live):
            x = self.points[live]
            if ((_turn(p, q, x) >= 0) & (_turn(q, c, x) >= 0) & (_turn(c, p, x) >= 0)).any():
                return False
        for u, w in ((a, b), (b, a)):
            if ident is not None and ((u, ident) in self.edges or (ident, u) in self.edges):
                continue
            if self.crossed(self.points[u], c, {u} if ident is None else {u, ident}):
                return False
            # Edges that share an end with the new one may still lie along it or fold over it.
            for v in {x for e in self.edges for x in e if u in e} - {u, w, ident}:
                d, f = self.points[v] - self.points[u], c - self.points[u]
                if abs(d[0] * f[1] - d[1] * f[0]) < 1e-12 * np.linalg.norm(d) * np.linalg.norm(f) and d @ f > 0:
                    return False
        return True

    def inside(self, c: np.ndarray) -> bool:
        """Whether a point lies in the open region: crossing number over open edges."""
        e = np.array(sorted(self.edges))
        a, b = self.points[e[:, 0]], self.points[e[:, 1]]
        up = (a[:, 1] > c[1]) != (b[:, 1] > c[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (c[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        return bool((up & (x > c[0])).sum() % 2)

    def clear(self, c: np.ndarray, radius: float) -> bool:
        """Whether no open edge lies within the radius."""
        e = np.array(sorted(self.edges))
        a, b = self.points[e[:, 0]], self.points[e[:, 1]]
        d = b - a
        t = np.clip(((c - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return bool((np.linalg.norm(a + d * t[:, None] - c, axis=1) > radius).all())

    def advance(self, a: int, b: int) -> None:
        p, q = self.points[a], self.points[b]
        mid, along = (p + q) / 2, q - p
        length = float(np.linalg.norm(along))
        ideal = min(max(self.step(mid), 0.6 * length), 2 * length)
        height = np.sqrt(max(ideal**2 - length**2 / 4, (0.35 * length) ** 2))
        apex = mid + np.array([-along[1], along[0]]) / length * height
        live = np.array(sorted({v for e in self.edges for v in e} - {a, b}))
        d = np.linalg.norm(self.points[live] - apex, axis=1)
        order = np.argsort(d, kind="stable")
        choice = None
        for k in order[d[order] <= SNAP * ideal]:
            if self.legal(a, b, self.points[live[k]], int(live[k])):
                choice = int(live[k])
                break
        if choice is None:
            if self.inside(apex) and self.clear(apex, CLEAR * ideal) and self.legal(a, b, apex, None):
                self.points = np.concatenate((self.points, apex[None]))
                choice = len(self.points) - 1
            else:
                # The widest angle over the edge: the vertex that a Delaunay triangulation would take.
                u, w = p - self.points[live], q - self.points[live]
                cosine = (u * w).sum(1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(w, axis=1), 1e-300)
                for k in np.argsort(cosine, kind="stable"):
                    if self.legal(a, b, self.points[live[k]], int(live[k])):
                        choice = int(live[k])
                        break
        if choice is None:
            raise ValueError("a front that isn't a set of simple loops")
        self.edges.remove((a, b))
        self.triangles.append((a, b, choice))
        self.open(a, choice)
        self.open(choice, b)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        while self.heap:
            _, a, b = heapq.heappop(self.heap)
            if (a, b) in self.edges:
                self.advance(a, b)
        return self.points, np.array(self.triangles, np.int64).reshape(-1, 3)


def cut_segment(p: np.ndarray, q: np.ndarray, step: Callable[[np.ndarray], float]) -> np.ndarray:
    """Points from p up to, not including, q in whole steps; the same from either end."""
    n = max(1, round(float(np.linalg.norm(q - p)) / step((p + q) / 2)))
    return p + (q - p) * (np.arange(n) / n)[:, None]


def mesh_blocks(blocks: DataFrame, step: float) -> DataFrame:
    """blocks(block, x0, y0, x1, y1) -> block, f, ax .. cy: each rectangle meshed apart; borders fit together."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        size = lambda _: step
        corner = np.array([(r["x0"], r["y0"]), (r["x1"], r["y0"]), (r["x1"], r["y1"]), (r["x0"], r["y1"])], float)
        loop = np.concatenate([cut_segment(corner[i], corner[(i + 1) % 4], size) for i in range(4)])
        points, tris = Front([loop], size).run()
        c = points[tris].reshape(len(tris), 6)
        return pd.DataFrame({"block": r["block"], "f": np.arange(len(tris)), **{n: c[:, i] for i, n in enumerate(["ax", "ay", "bx", "by", "cx", "cy"])}})

    return blocks.groupBy("block").applyInPandas(run, "block int, f int, ax double, ay double, bx double, by double, cx double, cy double")


def lift(tris: DataFrame, verts: DataFrame) -> DataFrame:
    """az, bz, cz by bilinear heights of a unit height field verts(x, y, z)."""
    h = verts.select(F.col("x").cast("int").alias("i"), F.col("y").cast("int").alias("j"), F.col("z").alias("h"))
    top = F.broadcast(h.agg(F.max("i").alias("mi"), F.max("j").alias("mj")))  # one row
    out = tris.crossJoin(top)
    for p in "abc":
        out = out.withColumns({p + "i": F.least(F.floor(F.col(p + "x")), F.col("mi") - 1).cast("int"), p + "j": F.least(F.floor(F.col(p + "y")), F.col("mj") - 1).cast("int")})
        for di in (0, 1):
            for dj in (0, 1):
                side = h.select((F.col("i") - di).alias(p + "i"), (F.col("j") - dj).alias(p + "j"), F.col("h").alias(f"{p}h{di}{dj}"))
                out = out.join(side, [p + "i", p + "j"])
        u, v = F.col(p + "x") - F.col(p + "i"), F.col(p + "y") - F.col(p + "j")
        z = F.col(p + "h00") * (1 - u) * (1 - v) + F.col(p + "h10") * u * (1 - v) + F.col(p + "h01") * (1 - u) * v + F.col(p + "h11") * u * v
        out = out.withColumn(p + "z", z)
    return out.select("block", "f", *[p + c for p in "abc" for c in "xyz"])

