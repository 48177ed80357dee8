"""Nearest sites against brute force, for even, far, clustered and tied sets, and the rows that the search makes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.operators import nearest, spatial


def sets(kind, n, m, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "even":
        return rng.uniform(0, 100, (n, 2)), rng.uniform(0, 100, (m, 2))
    if kind == "far":
        return rng.uniform(5_000, 5_010, (n, 2)), rng.normal(0, 1, (m, 2))
    if kind == "mixed":
        return np.concatenate([rng.uniform(0, 1e4, (n // 2, 2)), rng.normal(50, 0.1, (n - n // 2, 2))]), np.concatenate([rng.normal(50, 1, (m - 5, 2)), rng.uniform(0, 1e4, (5, 2))])
    return np.stack(np.meshgrid(np.arange(n // 20), np.arange(20)), -1).reshape(-1, 2).astype(float), rng.integers(0, 6, (m, 2)).astype(float)  # ties and repeated places


def frames(spark, points, sites):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "pixel_id long, x double, y double").repartition(3)
    return p, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)] + [(-1, 1.0, None)], "site_id long, sx double, sy double")


@pytest.mark.parametrize("kind", ["even", "far", "mixed", "ties"])
def test_near_sites(spark, kind):
    points, sites = sets(kind, 200, 150)
    p, s = frames(spark, points, sites)
    d = np.hypot(points[:, None, 0] - sites[None, :, 0], points[:, None, 1] - sites[None, :, 1])
    got = {r["pixel_id"]: (r["site_id"], r["distance"]) for r in spatial.nearest_site(p, s).collect()}
    assert len(got) == len(points)
    assert all(got[i][0] == int(np.flatnonzero(d[i] <= d[i].min() * (1 + 1e-15))[0]) and abs(got[i][1] - d[i].min()) < 1e-9 for i in range(len(points)))
    for k in (3, 1_000):
        near = spatial.knn_weights(p, s, k, 10.0).groupBy("pixel_id").agg(F.collect_list("distance").alias("d"), F.sum("weight").alias("w")).collect()
        assert len(near) == len(points)
        for r in near:
            assert np.allclose(sorted(r["d"]), np.sort(d[r["pixel_id"]])[:k], atol=1e-9) and abs(r["w"] - 1) < 1e-9


@pytest.mark.parametrize("kind", ["even", "far", "mixed"])
def test_few_rows(spark, kind):
    """1,000 points and 3,000 sites: neither points with sites nor groups with nodes come near all pairs."""
    points, sites = sets(kind, 1_000, 3_000)
    p, s = frames(spark, points, sites)
    k = 1 if kind == "far" else 10
    found = nearest.near_sites(p, s, k).groupBy("pixel_id").count().agg(F.count("*"), F.sum("count"), F.min("count")).first()
    assert found[0] == len(points) and found[2] >= k and found[1] < 20 * k * len(points), found
