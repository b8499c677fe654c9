"""Queries over every point against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.functions import geometry as g
from meshspark.plans import QUERIES


@pytest.fixture(scope="module")
def big(spark, sf):
    """Ids, places and squared distances of all pairs of pts_big."""
    return pairs(fx.pts_big(spark, sf))


def pairs(df):
    rows = sorted((r["id"], r["x"], r["y"], r["z"]) for r in df.collect())
    ids, at = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    return ids, at, ((at[:, None] - at[None]) ** 2).sum(axis=2)


def got(name, spark, sf, key):
    rows = QUERIES[name](spark, sf).collect()
    out = {tuple(r[k] for k in key): r for r in rows}
    assert len(out) == len(rows)
    return out


def ranked(ids, d2, k):
    """{(q, rank): (id, d2)} of the k nearest, ties by least id."""
    out = {}
    for i, q in enumerate(ids):
        for rank, j in enumerate(np.lexsort((ids, d2[i]))[:k]):
            out[q, rank + 1] = ids[j], d2[i, j]
    return out


def check_ranked(rows, want):
    assert set(rows) == set(want)
    assert all(rows[k]["id"] == w[0] and rows[k]["d2"] == pytest.approx(w[1], abs=1e-6) for k, w in want.items())


def test_nearest_points(spark, sf, big):
    ids, at, d2 = big
    check_ranked(got("knn_join", spark, sf, ("q", "rank")), ranked(ids, d2, 5))
    moved = ((at[:, None] + 0.5 - at[None]) ** 2).sum(axis=2)
    near = got("nearest_point", spark, sf, ("q",))
    assert {k: r["id"] for (k,), r in near.items()} == {q: i for (q, _), (i, _) in ranked(ids, moved, 1).items()}
    radii = got("point_radii", spark, sf, ("id",))
    assert {k: r["radius"] for (k,), r in radii.items()} == pytest.approx({q: np.sqrt(d) for (q, k), (_, d) in ranked(ids, d2, 7).items() if k == 7}, abs=1e-6)


def test_neighbourhoods(spark, sf, big):
    ids, at, d2 = big
    near = got("radius_join", spark, sf, ("q",))
    assert {q: (r["n"], r["total"]) for (q,), r in near.items()} == {q: ((m := d2[i] <= 36).sum(), ids[m].sum()) for i, q in enumerate(ids)}
    s = d2 / 144
    w = np.where(s < 1, (1 - s) ** 2, 0)
    mean = w @ at / w.sum(axis=1)[:, None]
    shepard, moments = got("shepard_means", spark, sf, ("q",)), got("weighted_moments", spark, sf, ("q",))
    assert {q for (q,) in shepard} == {q for (q,) in moments} == set(ids.tolist())
    for i, q in enumerate(ids):
        assert (shepard[q,]["x"], shepard[q,]["y"], shepard[q,]["z"]) == pytest.approx(tuple(mean[i]), abs=2e-5)
        m = moments[q,]
        xx, xz = (w[i] @ (at[:, 0] * at[:, c]) / w[i].sum() - mean[i, 0] * mean[i, c] for c in (0, 2))
        assert m["n"] == shepard[q,]["n"] == (w[i] > 0).sum()
        assert (m["mx"], m["cxx"], m["cxz"]) == pytest.approx((mean[i, 0], xx, xz), abs=2e-4)


def test_projected_points(spark, sf, big):
    """A row for every point whose plane holds and that has six neighbours."""
    ids, at, d2 = big
    s = d2 / 225
    w = np.where(s < 1, (1 - s) ** 2, 0)
    want = set()
    for i, q in enumerate(ids):
        if (w[i] > 0).sum() >= 6:
            d = at - w[i] @ at / w[i].sum()
            l1, l2, l3 = np.linalg.eigvalsh((w[i][:, None] * d).T @ d / w[i].sum())
            if l1 * l3 <= 4 * l2 * l2:
                want.add((q,))
    assert set(got("projected_points", spark, sf, ("q",))) == want and len(want) > len(ids) / 40


def test_step_lengths(spark, sf, big):
    ids, _, d2 = big
    ideal = 1 + (ids % 97) / 10
    want = np.clip((0.2 * np.sqrt(d2) + 0.8 * ideal[None]).min(axis=1), 0.5, 4)
    rows = got("step_lengths", spark, sf, ("q",))
    assert {q: r["step"] for (q,), r in rows.items()} == pytest.approx(dict(zip(ids.tolist(), want.tolist(), strict=True)), abs=1e-6)


def test_vectors(spark, sf):
    ids, at, d2 = pairs(fx.pts(spark, sf))
    plane = got("plane_distance", spark, sf, ("id",))
    assert {i: r["d"] for (i,), r in plane.items()} == pytest.approx(dict(zip(ids.tolist(), ((at @ [1, 2, -2] - 0.75) / 3).tolist(), strict=True)), abs=1e-6)
    check_ranked(got("merged_nearest", spark, sf, ("q", "rank")), ranked(ids, d2, 3))


def test_nearest_triangles(spark, sf):
    p = fx.pts(spark, sf).select("id", *[(3.5 + 1.5 * F.col(c)).alias(c) for c in "xyz"])
    every = p.crossJoin(fx.surf_t(spark, sf)).groupBy("id").agg(F.min(g.triangle_distance2(g.vec(), *[g.vec(c) for c in "abc"])).alias("d2"))
    want = {r["id"]: r["d2"] ** 0.5 for r in every.collect()}
    rows = got("nearest_triangle", spark, sf, ("id",))
    assert {i: r["d"] for (i,), r in rows.items()} == pytest.approx(want, abs=2e-5)
