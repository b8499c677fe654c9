"""Searches and fits where very many points lie close together or at one place: a row for each pair would not end in time."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark import fixtures as fx
from meshspark.plans import QUERIES

PARTS, VECTORS = 60_000, 20_000
SECONDS = 60


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Parts at 150 places on three lines (keys that differ by 10007 * 10009 share y and z), vectors in a box of side 0.1."""
    d = str(tmp_path_factory.mktemp("dense"))
    k = F.col("id")
    spark.range(PARTS).select((F.expr("id div 3") * 100160063 + k % 3).alias("p_partkey"), (F.expr("id div 3") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{d}/part.parquet")
    at = [(F.pmod(k * m, F.lit(20011)) / F.lit(200110.0)).cast("float") for m in (7919, 104729, 1299709)]
    spark.range(VECTORS).select(k.alias("vec_id"), F.array(*at).alias("embedding"), (k % 10).cast("int").alias("label")).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def parts(spark, dense):
    """Ids and places in order of ids, and the numbers of some of them."""
    return places(fx.pts_big(spark, dense))


def places(df):
    rows = df.select("id", "x", "y", "z").toPandas().sort_values("id")
    return rows["id"].to_numpy(), rows[["x", "y", "z"]].to_numpy(), range(0, len(rows), 997)


def got(name, spark, sf, key):
    """Rows by the key; all jobs are ended after SECONDS."""
    timer = threading.Timer(SECONDS, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        rows = QUERIES[name](spark, sf).toPandas()
    finally:
        timer.cancel()
    return rows.set_index(key)


def squares(at, q):
    d = at - q
    return d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2


def weights(at, q, radius):
    s = squares(at, q) / (radius * radius)
    return np.where(s < 1, (1 - s) ** 2, 0)


def nearest(ids, at, q, k):
    d2 = squares(at, q)
    order = np.lexsort((ids, d2))[:k]
    return ids[order].tolist(), d2[order]


def test_knn_join(spark, dense, parts):
    ids, at, some = parts
    rows = got("knn_join", spark, dense, ["q", "rank"])
    assert len(rows) == 5 * PARTS
    for i in some:
        assert [rows.loc[(ids[i], r), "id"] for r in range(1, 6)] == nearest(ids, at, at[i], 5)[0]


def test_point_radii(spark, dense, parts):
    ids, at, some = parts
    rows = got("point_radii", spark, dense, "id")
    assert len(rows) == PARTS
    for i in some:
        assert rows.loc[ids[i], "radius"] == pytest.approx(np.sqrt(nearest(ids, at, at[i], 7)[1][6]), abs=1e-6)


def test_nearest_point(spark, dense, parts):
    ids, at, some = parts
    rows = got("nearest_point", spark, dense, "q")
    assert len(rows) == PARTS
    for i in some:
        assert rows.loc[ids[i], "id"] == nearest(ids, at, at[i] + 0.5, 1)[0][0]


def test_radius_join(spark, dense, parts):
    ids, at, some = parts
    rows = got("radius_join", spark, dense, "q")
    assert len(rows) == PARTS
    for i in some:
        near = squares(at, at[i]) <= 36
        assert (rows.loc[ids[i], "n"], rows.loc[ids[i], "total"]) == (near.sum(), ids[near].sum())


def test_weighted_moments(spark, dense, parts):
    ids, at, some = parts
    rows = got("weighted_moments", spark, dense, "q")
    assert len(rows) == PARTS
    for i in some:
        w = weights(at, at[i], 12)
        m, x2 = w @ at / w.sum(), w @ (at[:, 0] ** 2) / w.sum()
        r = rows.loc[ids[i]]
        assert r["n"] == (w > 0).sum() and (r["mx"], r["cxx"]) == pytest.approx((m[0], x2 - m[0] ** 2), abs=2e-4)


def test_shepard_means(spark, dense, parts):
    ids, at, some = parts
    rows = got("shepard_means", spark, dense, "q")
    assert len(rows) == PARTS
    for i in some:
        w = weights(at, at[i], 12)
        r = rows.loc[ids[i]]
        assert r["n"] == (w > 0).sum() and tuple(r[["x", "y", "z"]]) == pytest.approx(tuple(w @ at / w.sum()), abs=2e-5)


def test_plane_fits(spark, dense, parts):
    """Normals are across the direction of greatest spread, which for lines along x is x."""
    ids, at, _ = parts
    rows = got("plane_fits", spark, dense, "id")
    assert set(rows.index) == set(ids.tolist())
    fit = rows["nz"].notna()
    assert fit.any() and np.abs(rows.loc[fit, "nx"]).max() < 1e-6 and np.linalg.norm(rows.loc[fit, ["nx", "ny", "nz"]], axis=1) == pytest.approx(1)


def test_step_lengths(spark, dense, parts):
    ids, at, some = parts
    rows = got("step_lengths", spark, dense, "q")
    assert len(rows) == PARTS
    for i in some:
        s = (0.2 * np.sqrt(squares(at, at[i])) + 0.8 * (1 + ids % 97 / 10)).min()
        assert rows.loc[ids[i], "step"] == pytest.approx(min(max(s, 0.5), 4), abs=1e-6)


def test_merged_nearest(spark, dense):
    ids, at, some = places(fx.pts(spark, dense))
    rows = got("merged_nearest", spark, dense, ["q", "rank"])
    assert len(rows) == 3 * VECTORS
    for i in some:
        assert [rows.loc[(ids[i], r), "id"] for r in range(1, 4)] == nearest(ids, at, at[i], 3)[0]


def test_projected_points(spark, dense, parts):
    """A row for each point whose fit is a plane; one that lies on the surface stays where it is."""
    ids, at, _ = parts
    rows = got("projected_points", spark, dense, "q")
    assert set(rows.index) <= set(ids.tolist()) and len(rows) and rows.notna().all(axis=None)
