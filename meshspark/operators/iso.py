"""Iso-surfaces: marching tetrahedra, marching cubes, marching triangles, as joins and projections."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corner pairs of the twelve edges of a cell; corners are numbered by bits x, y, z.
EDGES = [(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)]


def marching_tets(tets: DataFrame, iso: float) -> DataFrame:
    """t, k, ax .. cz: one or two triangles for each tetrahedron (t, ax .. dz, as .. ds) that the value crosses, unwelded."""
    names = "abcd"

    def cut(p: str, q: str):
        u = (iso - F.col(p + "s")) / (F.col(q + "s") - F.col(p + "s"))
        return [F.col(p + c) + u * (F.col(q + c) - F.col(p + c)) for c in "xyz"]

    def triangle(k: int, *edges: tuple[str, str]):
        cols = [F.lit(k).alias("k")]
        for name, (p, q) in zip("abc", edges, strict=True):
            cols += [v.alias(name + c) for c, v in zip("xyz", cut(p, q), strict=True)]
        return F.struct(*cols)

    code = sum(F.when(F.col(p + "s") < iso, 1 << i).otherwise(0) for i, p in enumerate(names))
    cases = F.when(F.lit(False), F.array(triangle(0, ("a", "b"), ("a", "c"), ("a", "d"))))
    for m in range(1, 15):
        low = [names[i] for i in range(4) if m >> i & 1]
        high = [p for p in names if p not in low]
        if len(low) == 1 or len(high) == 1:
            one, rest = (low[0], high) if len(low) == 1 else (high[0], low)
            tris = [triangle(0, *[(min(one, r), max(one, r)) for r in rest])]
        else:
            (p, q), (r, s) = low, high
            e = lambda x, y: (min(x, y), max(x, y))
            tris = [triangle(0, e(p, r), e(p, s), e(q, s)), triangle(1, e(p, r), e(q, s), e(q, r))]
        cases = cases.when(code == m, F.array(*tris))
    return tets.select("t", F.explode(cases).alias("m")).select("t", "m.*")


@cache
def cube_cases() -> list[list[tuple[int, int, int]]]:
    """For each of 256 sign patterns the triangles as edge numbers, normals towards greater values.

    Around a face of the cell, seen from outside, every run of low corners is entered over one edge and left over another;
    a step leads from the first to the second, so low corners of a face are cut off from each other. A crossed edge is
    entered on one of its two faces and left on the other, so the steps form loops, and a loop is cut into a fan. Neighbour
    cells see their common face alike, so the surface has no cracks.
    """
    faces = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    out = []
    for m in range(256):
        low = [bool(m >> i & 1) for i in range(8)]
        step = {}
        for face in faces:
            ring = [(face[i], face[(i + 1) % 4]) for i in range(4)]
            for i in range(4):
                if not low[ring[i][0]] and low[ring[i][1]]:
                    j = next(k % 4 for k in range(i + 1, i + 4) if not low[ring[k % 4][1]])
                    step[number[frozenset(ring[i])]] = number[frozenset(ring[j])]
        tris, seen = [], set()
        for start in sorted(step):
            loop, now = [], start
            while now not in seen:
                seen.add(now)
                loop.append(now)
                now = step[now]
            tris += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
        out.append(tris)
    return out


def marching_cubes(corners: DataFrame, iso: float) -> DataFrame:
    """x, y, z, k, e0, e1, e2, ax .. cz: triangles of each cell (x, y, z, c0 .. c7).

    e: id of the grid edge a corner lies on, 3 * (lower corner's number among its axis) coded as text-free long: equal for
    all cells that share the edge, so it welds corners.
    """
    spark = corners.sparkSession
    rows = [(m, k, *t) for m, ts in enumerate(cube_cases()) for k, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "m int, k int, e0 int, e1 int, e2 int")
    code = sum(F.when(F.col(f"c{i}") < iso, 1 << i).otherwise(0) for i in range(8))
    cells = corners.select("*", code.alias("m")).filter("m > 0 and m < 255")
    found = cells.join(F.broadcast(table), "m")  # a few rows for each of 256 cases
    crossing = []
    for p, q in EDGES:
        t = F.try_divide(iso - F.col(f"c{p}"), F.col(f"c{q}") - F.col(f"c{p}"))  # null on edges that aren't crossed
        step = [(q >> a & 1) - (p >> a & 1) for a in range(3)]
        place = [F.col(c) + float(p >> a & 1) + (t if step[a] else 0.0) for a, c in enumerate("xyz")]
        low = [F.col(c) + (p >> a & 1) for a, c in enumerate("xyz")]
        ident = (((low[2].cast("long") * 100_000 + low[1]) * 100_000 + low[0]) * 3) + step.index(1)
        crossing.append(F.struct(ident.alias("id"), *[v.alias(c) for v, c in zip(place, "xyz", strict=True)]))
    every = F.array(*crossing)
    picked = found.withColumn("all", every).select("x", "y", "z", "k", *[F.col("all")[F.col(f"e{j}")].alias(f"p{j}") for j in range(3)])
    return picked.select("x", "y", "z", "k", *[F.col(f"p{j}.id").alias(f"e{j}") for j in range(3)], *[F.col(f"p{j}.{c}").alias(p + c) for j, p in enumerate("abc") for c in "xyz"])


def marching_triangles(tris: DataFrame, iso: float) -> DataFrame:
    """f, px .. qz: the segment of each triangle (f, ax .. cz, as, bs, cs) at the value."""
    def cut(p: str, q: str):
        u = (iso - F.col(p + "s")) / (F.col(q + "s") - F.col(p + "s"))
        return [F.col(p + c) + u * (F.col(q + c) - F.col(p + c)) for c in "xyz"]

    cases = F.when(F.lit(False), F.struct(*[F.lit(0.0).alias(n + c) for n in "pq" for c in "xyz"]))
    code = sum(F.when(F.col(p + "s") < iso, 1 << i).otherwise(0) for i, p in enumerate("abc"))
    for m in range(1, 7):
        alone = next(p for i, p in enumerate("abc") if (m >> i & 1) != (bin(m).count("1") == 2))
        ends = [cut(min(alone, r), max(alone, r)) for r in "abc" if r != alone]
        cases = cases.when(code == m, F.struct(*[v.alias(n + c) for n, e in zip("pq", ends, strict=True) for v, c in zip(e, "xyz", strict=True)]))
    return tris.select("f", cases.alias("s")).filter("s is not null").select("f", "s.*")
