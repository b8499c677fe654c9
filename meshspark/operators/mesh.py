"""Triangle and tetrahedral meshes as relations: adjacency, borders, normals, quality, subdivision, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshspark.functions import geometry as g
from meshspark.operators.graph import components
from meshspark.operators.order import running

A, B, C = g.Corner("a"), g.Corner("b"), g.Corner("c")


def halfedges(faces: DataFrame) -> DataFrame:
    """f, i, a, b: the directed edge i of each face from its vertex i to the next."""
    edges = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b")) for i in range(3)])
    return faces.select("f", F.explode(edges).alias("e")).select("f", "e.i", "e.a", "e.b")


def twins(faces: DataFrame) -> DataFrame:
    """f, i, a, b, nbr: the face across each edge, -1 on the border. Of several the one of greatest id counts."""
    h = halfedges(faces)
    other = h.groupBy(F.col("b").alias("a"), F.col("a").alias("b")).agg(F.max("f").alias("nbr"))
    return h.join(other, ["a", "b"], "left").select("f", "i", "a", "b", F.coalesce("nbr", F.lit(-1)).alias("nbr"))


def incidence(faces: DataFrame) -> DataFrame:
    """v, f"""
    return faces.select(F.explode(F.array("v0", "v1", "v2")).alias("v"), "f")


def one_ring(faces: DataFrame) -> DataFrame:
    """v, nbr: vertices that share an edge with v."""
    h = halfedges(faces)
    return h.select(F.col("a").alias("v"), F.col("b").alias("nbr")).union(h.select("b", "a")).distinct()


def border_edges(faces: DataFrame) -> DataFrame:
    """f, i, a, b of edges without a twin."""
    h = halfedges(faces)
    rev = h.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return h.join(rev, ["a", "b"], "left_anti").select("f", "i", "a", "b")


def border_vertices(faces: DataFrame) -> DataFrame:
    b = border_edges(faces)
    return b.select(F.col("a").alias("v")).union(b.select("b")).distinct()


def odd_neighbours(faces: DataFrame) -> DataFrame:
    """v: vertices with a neighbour met an odd number of times, that is, on the border of a manifold mesh."""
    h = halfedges(faces)
    both = h.select(F.col("a").alias("v"), F.col("b").alias("nbr")).union(h.select("b", "a"))
    return both.groupBy("v", "nbr").count().filter("count % 2 = 1").select("v").distinct()


def unequal_counts(faces: DataFrame) -> DataFrame:
    """v, n_nbr, n_tri of vertices whose neighbours and triangles differ in number."""
    n = one_ring(faces).groupBy("v").agg(F.count("*").alias("n_nbr"))
    t = incidence(faces).groupBy("v").agg(F.count("*").alias("n_tri"))
    return n.join(t, "v").filter("n_nbr <> n_tri")


def face_normals(tris: DataFrame) -> DataFrame:
    """f, v0, v1, v2, nx, ny, nz of unit length (null for a degenerate face), area2 (twice the area)."""
    n = g.cross(g.sub(B, A), g.sub(C, A))
    t = tris.select("f", "v0", "v1", "v2", *[c.alias("u" + k) for c, k in zip(n, "xyz", strict=True)])
    t = t.withColumn("area2", g.norm(g.vec("u")))
    return t.select("f", "v0", "v1", "v2", *[F.when(F.col("area2") > 0, F.col("u" + k) / F.col("area2")).alias("n" + k) for k in "xyz"], "area2")


def vertex_normals(tris: DataFrame, weighted: bool = False) -> DataFrame:
    """v, nx, ny, nz: the unit sum of the normals of a vertex's faces, by area if weighted; degenerate faces don't count."""
    n = face_normals(tris).filter("area2 > 0")
    w = F.col("area2") if weighted else F.lit(1.0)
    each = n.select(F.explode(F.array("v0", "v1", "v2")).alias("v"), *[(F.col("n" + k) * w).alias("n" + k) for k in "xyz"])
    s = each.groupBy("v").agg(*[F.sum("n" + k).alias("s" + k) for k in "xyz"])
    size = g.norm(g.vec("s"))
    return s.select("v", *[(F.col("s" + k) / size).alias("n" + k) for k in "xyz"])


def creases(tris: DataFrame, sharp: float) -> DataFrame:
    """a, b, f, nbr, cosine of edges (a < b) whose faces' normals have a dot product below sharp."""
    n = face_normals(tris)
    t = twins(tris).filter("nbr >= 0 and a < b")
    x = n.select(F.col("f"), *[F.col("n" + k).alias("p" + k) for k in "xyz"])
    y = n.select(F.col("f").alias("nbr"), *[F.col("n" + k).alias("q" + k) for k in "xyz"])
    cosine = g.dot(g.vec("p"), g.vec("q"))
    return t.join(x, "f").join(y, "nbr").select("a", "b", "f", "nbr", cosine.alias("cosine")).filter(F.col("cosine") < sharp)


def kinks(crease: DataFrame, least: int = 2) -> DataFrame:
    """v, n: vertices where more than `least` crease edges meet."""
    ends = crease.select(F.explode(F.array("a", "b")).alias("v"))
    return ends.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > least)


def crease_curves(crease: DataFrame, least: int = 20) -> DataFrame:
    """curve, a, b: crease edges as curves that end at kinks, those of fewer than `least` edges left out.

    Ends of edges are points of their own at a kink and shared elsewhere, so a curve is a component; its least edge names it.
    """
    edge = crease.select("a", "b", F.struct("a", "b").alias("e"))
    ends = edge.select("e", F.explode(F.array("a", "b")).alias("v"))
    inner = ends.join(kinks(crease).select("v"), "v", "left_anti")
    # At most two edges meet at what is left.
    links = inner.groupBy("v").agg(F.min("e").alias("a"), F.max("e").alias("b")).select("a", "b")
    alone = edge.select(F.col("e").alias("a"), F.col("e").alias("b"))
    named = components(links.union(alone)).select(F.col("v").alias("e"), F.col("root").alias("curve"))
    large = named.groupBy("curve").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return named.join(large, "curve").select(F.col("curve.a").alias("curve_a"), F.col("curve.b").alias("curve_b"), "e.a", "e.b", "n")


def finalized(faces: DataFrame) -> DataFrame:
    """v, done, peak: the face after which no edge of the vertex is on the front, and its greatest number of front edges.

    Faces arrive in the order of f. An edge comes to the front with its first face and leaves it with its second; done is
    null for vertices that keep an edge on it, such as those of the border.
    """
    h = halfedges(faces).select("f", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    use = h.withColumn("k", F.row_number().over(Window.partitionBy("p", "q").orderBy("f")))
    step = use.select("f", F.explode(F.array("p", "q")).alias("v"), F.when(F.col("k") % 2 == 1, 1).otherwise(-1).alias("d"))
    net = step.groupBy("v", "f").agg(F.sum("d").alias("d"))
    live = net.withColumn("live", F.sum("d").over(Window.partitionBy("v").orderBy("f")))
    return live.groupBy("v").agg(F.min(F.when(F.col("live") == 0, F.col("f"))).alias("done"), F.max("live").alias("peak"))


def quality(tris: DataFrame) -> DataFrame:
    """f, circumradius, inradius, q = 2 r / R: 1 for an equilateral triangle."""
    big, small = g.circumradius(A, B, C), g.inradius(A, B, C)
    return tris.select("f", big.alias("circumradius"), small.alias("inradius"), (2 * small / big).alias("q"))


def histogram(values: DataFrame, column: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin, n, cum: counts of every bin of [low, high], values beyond it in the first or last one, and running sums."""
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - low) * bins / (high - low)))).cast("int")
    n = values.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("cum", F.sum("n").over(Window.orderBy("bin")))  # one row a bin


def inverse_mean_ratio(tris: DataFrame) -> DataFrame:
    return tris.select("f", "v0", "v1", "v2", g.inverse_mean_ratio(A, B, C).alias("imr"))


def without_poor(tris: DataFrame, cutoff: float) -> DataFrame:
    """Faces below the cutoff; degenerate ones, of ratio 0, stay."""
    return inverse_mean_ratio(tris).filter(F.col("imr") < cutoff)


def not_degenerate() -> Column:
    return (F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v2") != F.col("v0"))


def info(tris: DataFrame, verts: DataFrame) -> DataFrame:
    """One row: counts, Euler characteristic, least and greatest angle in degrees, mean of cosines as an angle."""
    angle = []
    for p, q, r in ((A, B, C), (B, C, A), (C, A, B)):
        d, e = g.sub(q, p), g.sub(r, p)
        angle.append(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(d, e) / (g.norm(d) * g.norm(e)))))
    cos = tris.select(F.explode(F.array(*angle)).alias("c"))
    angles = cos.agg(F.degrees(F.acos(F.max("c"))).alias("least_angle"), F.degrees(F.acos(F.min("c"))).alias("greatest_angle"), F.degrees(F.acos(F.sum(F.round("c", 9)) / F.count("*"))).alias("mean_angle"))
    h = halfedges(tris)
    edges = h.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().agg(F.count("*").alias("n_edges"))
    border = border_edges(tris).agg(F.count("*").alias("n_border"))
    counts = tris.agg(F.count("*").alias("n_faces")).crossJoin(verts.agg(F.count("*").alias("n_verts"))).crossJoin(edges).crossJoin(border).crossJoin(angles)
    return counts.withColumn("euler", F.col("n_verts") - F.col("n_edges") + F.col("n_faces"))


def tet_shell(tets: DataFrame) -> DataFrame:
    """a, b, c (ascending) and t of tetrahedron faces that only one tetrahedron has."""
    faces = F.array(*[F.array_sort(F.array(*[F.col(f"v{k}") for k in range(4) if k != omit])) for omit in range(4)])
    f = tets.select("t", F.explode(faces).alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("t")).filter("n = 1")
    return f.select(F.col("k")[0].alias("a"), F.col("k")[1].alias("b"), F.col("k")[2].alias("c"), "t")


def smooth_scalars(tets: DataFrame, verts: DataFrame, passes: int = 1) -> DataFrame:
    """v, s: scalars averaged over the tetrahedra around each vertex, itself included, as often as they meet."""
    every = F.array("v0", "v1", "v2", "v3")
    pairs = tets.select(F.explode(every).alias("v"), every.alias("n")).select("v", F.explode("n").alias("w"))
    weight = pairs.groupBy("v", "w").agg(F.count("*").alias("k"))
    s = verts.select("v", "s")
    for _ in range(passes):
        s = weight.join(s.select(F.col("v").alias("w"), "s"), "w").groupBy("v").agg((F.sum(F.round(F.col("k") * F.col("s"), 9)) / F.sum("k")).alias("s"))
    return s


def cluster(tris: DataFrame, verts: DataFrame, bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering on a grid of 2**bits - 1 steps an axis: (cell, x, y, z averages), (cells of faces that stay)."""
    box = verts.agg(*[f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    steps = (1 << bits) - 1
    q = [F.floor((F.col(c) - F.col("lo" + c)) * steps / F.when(F.col("hi" + c) > F.col("lo" + c), F.col("hi" + c) - F.col("lo" + c)).otherwise(1.0) + 0.5).cast("int") for c in "xyz"]
    cells = verts.crossJoin(F.broadcast(box)).withColumn("cell", q[0] + (q[1] + q[2] * (1 << bits)) * (1 << bits))  # box: one row
    means = cells.groupBy("cell").agg(*[(F.sum(F.round(c, 9)) / F.count("*")).alias(c) for c in "xyz"], F.count("*").alias("n"))
    out = tris.select("f", "v0", "v1", "v2")
    for k in range(3):
        out = out.join(cells.select(F.col("v").alias(f"v{k}"), F.col("cell").alias(f"c{k}")), f"v{k}")
    return means, out.filter("c0 <> c1 and c1 <> c2 and c2 <> c0").select("f", "c0", "c1", "c2")


def subdivide(faces: DataFrame, verts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of Loop subdivision: (v, x, y, z) and (f, v0, v1, v2).

    Old vertices keep their ids and move by weight 3/(8 n), 3/16 for n = 3, over their n neighbours, border ones by 6/8 and
    1/8; a new vertex on each edge lies at 3/8, 3/8, 1/8, 1/8, on the border in the middle. New ids follow the old ones in
    the order of their edges.
    """
    t = twins(faces)
    full = t.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "f", "nbr")
    third = faces.select(F.col("f"), F.array("v0", "v1", "v2").alias("vs"))
    wing = full.join(third, "f").select("p", "q", "nbr", F.filter("vs", lambda x: (x != F.col("p")) & (x != F.col("q")))[0].alias("w"))
    xyz = verts.select("v", "x", "y", "z")
    edge = wing.join(xyz.withColumnRenamed("v", "w"), "w").groupBy("p", "q").agg(F.min("nbr").alias("nbr"), *[F.sum(F.round(c, 9)).alias("w" + c) for c in "xyz"])
    edge = edge.join(xyz.select(F.col("v").alias("p"), *[F.col(c).alias("p" + c) for c in "xyz"]), "p").join(xyz.select(F.col("v").alias("q"), *[F.col(c).alias("q" + c) for c in "xyz"]), "q")
    mid = [F.when(F.col("nbr") < 0, (F.col("p" + c) + F.col("q" + c)) / 2).otherwise((F.col("p" + c) + F.col("q" + c)) * 0.375 + F.col("w" + c) * 0.125).alias(c) for c in "xyz"]
    top = verts.agg((F.max("v") + 1).alias("top"))
    edge = running(edge, ["p", "q"])
    new = edge.crossJoin(F.broadcast(top)).select("p", "q", (F.col("top") + F.col("place")).cast("int").alias("v"), *mid)  # top: one row

    ring = one_ring(faces).join(xyz.withColumnRenamed("v", "nbr"), "nbr")
    border = border_vertices(faces).withColumn("border", F.lit(True))
    on = ring.join(border.select(F.col("v").alias("nbr"), F.col("border").alias("nb")), "nbr", "left")
    edges = border_edges(faces).select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct().withColumn("be", F.lit(True))
    on = on.withColumn("p", F.least("v", "nbr")).withColumn("q", F.greatest("v", "nbr")).join(edges, ["p", "q"], "left")
    sums = on.groupBy("v").agg(F.count("*").alias("n"), *[F.sum(F.round(c, 9)).alias("s" + c) for c in "xyz"], *[F.sum(F.when(F.col("be"), F.round(c, 9)).otherwise(0.0)).alias("e" + c) for c in "xyz"])
    beta = F.when(F.col("n") == 3, 0.1875).otherwise(F.lit(0.375) / F.col("n"))
    old = verts.join(sums, "v").join(border, "v", "left").select("v", *[F.when(F.col("border"), F.col(c) * 0.75 + F.col("e" + c) * 0.125).otherwise(F.col(c) * (1 - F.col("n") * beta) + F.col("s" + c) * beta).alias(c) for c in "xyz"])
    out = faces.select("f", "v0", "v1", "v2")
    for k in range(3):
        ids = new.select(F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("v").alias(f"m{k}"))
        a, b = F.col(f"v{k}"), F.col(f"v{(k + 1) % 3}")
        out = out.join(ids, (F.least(a, b) == F.col("pp")) & (F.greatest(a, b) == F.col("qq"))).drop("pp", "qq")
    four = [("v0", "m0", "m2"), ("m0", "v1", "m1"), ("m2", "m1", "v2"), ("m0", "m1", "m2")]
    kids = F.array(*[F.struct((F.col("f") * 4 + i).alias("f"), *[F.col(c).cast("int").alias(f"v{j}") for j, c in enumerate(x)]) for i, x in enumerate(four)])
    return old.unionByName(new.select("v", "x", "y", "z")), out.select(F.explode(kids).alias("t")).select("t.*")


def merge(faces: list[DataFrame], verts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Meshes put together; ids of later ones are moved past those before."""
    f, v = faces[0], verts[0]
    for g_, w in zip(faces[1:], verts[1:], strict=True):
        top = F.broadcast(v.agg((F.max("v") + 1).alias("dv")).crossJoin(f.agg((F.max("f") + 1).alias("df"))))
        w = w.crossJoin(top).select((F.col("v") + F.col("dv")).alias("v"), "x", "y", "z")
        g_ = g_.crossJoin(top).select((F.col("f") + F.col("df")).alias("f"), *[(F.col(c) + F.col("dv")).alias(c) for c in ("v0", "v1", "v2")])
        v, f = v.select("v", "x", "y", "z").unionByName(w), f.select("f", "v0", "v1", "v2").unionByName(g_)
    return f, v


def flip(faces: DataFrame) -> DataFrame:
    return faces.select("f", "v0", F.col("v2").alias("v1"), F.col("v1").alias("v2"))


def front_width(events: DataFrame) -> DataFrame:
    """One row: the peak number of live vertices of an event list with kinds v and x. Every event has a seq of its own."""
    d = events.filter("kind in ('v', 'x')").select("seq", F.when(F.col("kind") == "v", 1).otherwise(-1).alias("d"))
    live = running(d, ["seq"], {"live": "d"})
    return live.agg(F.max("live").alias("width"))


def spans(faces: DataFrame) -> DataFrame:
    """f, span: the range of a face's vertex ids."""
    return faces.select("f", (F.greatest("v0", "v1", "v2") - F.least("v0", "v1", "v2")).alias("span"))


def compact(faces: DataFrame) -> DataFrame:
    """v, new: vertices numbered by first use, within a face by its order."""
    use = faces.select("f", F.posexplode(F.array("v0", "v1", "v2")).alias("i", "v"))
    first = use.groupBy("v").agg(F.min(F.col("f") * 3 + F.col("i")).alias("at"))
    return running(first, ["at"], {"new": None}).select("v", F.col("new").cast("int").alias("new"))


def edge_length_means(tris: DataFrame) -> DataFrame:
    """v, len: mean length of the edges to its neighbours."""
    h = halfedges(tris)
    v = incidence_points(tris)
    both = h.select(F.col("a").alias("v"), F.col("b").alias("w")).union(h.select("b", "a")).distinct()
    p = v.select("v", *[F.col(c).alias("p" + c) for c in "xyz"])
    q = v.select(F.col("v").alias("w"), *[F.col(c).alias("q" + c) for c in "xyz"])
    d = both.join(p, "v").join(q, "w").select("v", F.round(g.dist(g.vec("p"), g.vec("q")), 9).alias("d"))
    return d.groupBy("v").agg((F.sum("d") / F.count("*")).alias("len"))


def incidence_points(tris: DataFrame) -> DataFrame:
    """v, x, y, z of the corners of faces."""
    every = F.array(*[F.struct(F.col(f"v{k}").alias("v"), *[F.col(p + c).alias(c) for c in "xyz"]) for k, p in enumerate("abc")])
    return tris.select(F.explode(every).alias("p")).select("p.*").distinct()


def flip_candidates(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """p, q, r, s, f, g, gain: inner edges p q between faces f (p q r) and g (q p s) whose flip to r s is worth it.

    The least angle of the two faces must grow, their area at most by a tenth, and r s must not be an edge already.
    """
    t = twins(faces).filter("nbr >= 0 and f < nbr")
    third = faces.select("f", F.array("v0", "v1", "v2").alias("vs"))
    other = lambda vs: F.filter(vs, lambda x: (x != F.col("a")) & (x != F.col("b")))[0]
    e = t.join(third, "f").withColumn("r", other("vs")).drop("vs").join(third.withColumnRenamed("f", "nbr"), "nbr").withColumn("s", other("vs"))
    e = e.select(F.col("a").alias("p"), F.col("b").alias("q"), "r", "s", "f", F.col("nbr").alias("g"))
    for k in "pqrs":
        e = e.join(verts.select(F.col("v").alias(k), *[F.col(c).alias(k + c) for c in "xyz"]), k)
    p, q, r, s = (g.vec(k) for k in "pqrs")

    def cosines(a, b, c):
        return [g.dot(g.sub(y, x), g.sub(z, x)) / (g.dist(x, y) * g.dist(x, z)) for x, y, z in ((a, b, c), (b, c, a), (c, a, b))]

    flat = (g.area(r, s, q) > 0) & (g.area(s, r, p) > 0)
    now = F.greatest(*cosines(p, q, r), *cosines(q, p, s))
    new = F.greatest(*cosines(r, s, q), *cosines(s, r, p))
    grown = (g.area(r, s, q) + g.area(s, r, p)) <= 1.1 * (g.area(p, q, r) + g.area(q, p, s))
    good = e.filter(flat).withColumn("gain", now - new).filter((F.col("gain") > 1e-9) & grown)
    edges = one_ring(faces).select(F.col("v").alias("r"), F.col("nbr").alias("s"))
    return good.join(edges, ["r", "s"], "left_anti").select("p", "q", "r", "s", "f", "g", "gain")


def flip_edges(faces: DataFrame, verts: DataFrame, rounds: int = 20) -> DataFrame:
    """Faces after flips that enlarge least angles. Each round flips the edges that gain most among those that share a vertex
    of their quads, so that no two flips of a round meet; it ends when none is worth it."""
    from meshspark.operators.graph import settled

    faces = faces.select("f", "v0", "v1", "v2")
    for _ in range(rounds):
        c = settled(flip_candidates(faces, verts))
        if not c.take(1):
            break
        rank = F.struct((-F.col("gain")).alias("x"), "p", "q")
        ends = c.select(F.explode(F.array("p", "q", "r", "s")).alias("v"), rank.alias("k"))
        best = ends.groupBy("v").agg(F.min("k").alias("best"))
        won = c.select("*", rank.alias("k")).select("*", F.explode(F.array("p", "q", "r", "s")).alias("v")).join(best, "v")
        won = won.groupBy("p", "q", "r", "s", "f", "g").agg(F.min((F.col("k") == F.col("best")).cast("int")).alias("ok")).filter("ok = 1")
        new = won.select(F.explode(F.array(F.struct("f", F.col("r").alias("v0"), F.col("s").alias("v1"), F.col("q").alias("v2")), F.struct(F.col("g").alias("f"), F.col("s").alias("v0"), F.col("r").alias("v1"), F.col("p").alias("v2")))).alias("t")).select("t.*")
        faces = settled(faces.join(new.select("f"), "f", "left_anti").unionByName(new))
    return faces


def second_derivatives(tris: DataFrame) -> DataFrame:
    """v, sx, sy, sz: for each vertex the sum over its faces of the cross products of the edges that leave it."""
    rows = []
    for k, (p, q, r) in enumerate(((A, B, C), (B, C, A), (C, A, B))):
        n = g.cross(g.sub(q, p), g.sub(r, p))
        rows.append(F.struct(F.col(f"v{k}").alias("v"), *[x.alias("s" + c) for x, c in zip(n, "xyz", strict=True)]))
    each = tris.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return each.groupBy("v").agg(*[F.sum(F.round("s" + c, 9)).alias("s" + c) for c in "xyz"])


def subdivide_to_area(tris: DataFrame, most: float, rounds: int = 12) -> DataFrame:
    """f, n: each triangle (f, ax .. cz) cut in four until no part is larger than most, and the number of parts."""
    parts = tris.select("f", *[p + c for p in "abc" for c in "xyz"])
    done = None
    for _ in range(rounds):
        big = g.area(A, B, C) > most
        small = parts.filter(~big).select("f")
        done = small if done is None else done.unionByName(small)
        mid = {x: tuple((F.col(x[0] + c) + F.col(x[1] + c)) / 2 for c in "xyz") for x in ("ab", "bc", "ca")}
        own = {p: g.vec(p) for p in "abc"}
        four = [(own["a"], mid["ab"], mid["ca"]), (mid["ab"], own["b"], mid["bc"]), (mid["ca"], mid["bc"], own["c"]), (mid["ab"], mid["bc"], mid["ca"])]
        kids = F.array(*[F.struct(*[x.alias(p + c) for p, v in zip("abc", t, strict=True) for c, x in zip("xyz", v, strict=True)]) for t in four])
        parts = parts.filter(big).select("f", F.explode(kids).alias("t")).select("f", "t.*")
    return done.unionByName(parts.select("f")).groupBy("f").agg(F.count("*").alias("n"))


def smooth_normals(points: DataFrame, radius: float, low: float = -0.3, high: float = 0.3) -> DataFrame:
    """id, nx, ny, nz: means over the neighbours whose normals agree (dot above high) or, turned round, disagree (below low)."""
    from meshspark.operators import spatial

    q = points.select(F.col("id").alias("q"), "x", "y", "z")
    near = spatial.within(q, points, radius).join(points.select(F.col("id").alias("q"), *[F.col("n" + c).alias("o" + c) for c in "xyz"]), "q").join(points.select("id", *["n" + c for c in "xyz"]), "id")
    d = g.dot(g.vec("o"), g.vec("n"))
    sign = F.when(d > high, 1.0).when(d < low, -1.0).otherwise(0.0)
    s = near.groupBy(F.col("q").alias("id")).agg(*[F.sum(F.round(sign * F.col("n" + c), 10)).alias("s" + c) for c in "xyz"])
    size = g.norm(g.vec("s"))
    return s.select("id", *[F.when(size > 0, F.col("s" + c) / size).alias("n" + c) for c in "xyz"])
