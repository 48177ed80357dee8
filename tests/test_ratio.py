"""The sparse ratio field against dense matrices, its nodes' support, and the inverse projection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators import models, ratio


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(4)
    c = pd.DataFrame({"x": rng.uniform(0, 40, 60), "y": rng.uniform(0, 40, 60), "q2": rng.uniform(0.5, 3, 60)})
    c["qd"] = c["q2"] * (0.002 + 0.06 * (c["x"] > 20)) + rng.normal(0, 1e-3, 60)
    c["d2"], c["weight"] = c["qd"] ** 2 / c["q2"] + 1e-6, rng.uniform(0.5, 1, 60)
    return c


def dense(cells, nodes, spacing, lam):
    return models.regularised_ratio(cells, nodes, spacing=spacing, lam=lam, high=0.05, neighbours=5)


def test_fields_and_errors_are_those_of_dense_matrices(spark, cells):
    p = ratio.problem(spark.createDataFrame(cells.assign(cell_id="clash", fold=None, w=0.0).astype({"fold": object}), "x double, y double, q2 double, qd double, d2 double, weight double, cell_id string, fold string, w double"), [10, 15], block=12.0, most=12.0, neighbours=5)
    nodes = p.nodes.orderBy("site_id").toPandas()
    found = p.solve([0.1, 10]).toPandas()
    errors = {(r["spacing"], r["lam"]): r for r in p.errors([0.1, 10]).collect()}
    assert len(errors) == 4
    xy = cells[["x", "y"]].to_numpy()
    at = np.floor(xy / 12).astype(int)
    fold = (at[:, 0] + 2 * at[:, 1]) % 5
    for s in (10.0, 15.0):
        own = nodes[nodes["spacing"] == s]
        grid = models.node_grid(xy, s, 12.0)
        assert np.allclose(own[["sx", "sy"]], grid)
        for lam in (0.1, 10.0):
            values = found[(found["spacing"] == s) & (found["lam"] == lam)].sort_values("site_id")
            assert values["site_id"].tolist() == own["site_id"].tolist()
            assert np.allclose(values["value"], dense(cells, grid, s, lam), atol=1e-7)
            e = t = 0.0
            for f in range(5):
                test = cells[fold == f]
                if len(test) and (fold != f).sum() >= 3:
                    v = models.near_basis(test[["x", "y"]].to_numpy(), grid, 1.5 * s, 5) @ dense(cells[fold != f], grid, s, lam)
                    e += (test["d2"] - 2 * v * test["qd"] + v * v * test["q2"]).clip(lower=0).sum()
                    t += test["weight"].sum()
            row = errors[s, lam]
            assert row["cv_rmse"] == pytest.approx(np.sqrt(e / t), rel=1e-5) and row["nodes"] == len(grid) and row["tested_cells"] == 60


def test_bounds_hold_and_no_step_is_better(cells):
    rng = np.random.default_rng(2)
    A = rng.normal(size=(30, 8))
    b = A @ np.array([0.1, -0.1, 0.02, 0.03, 0, 0.05, 0.2, 0.01])
    G, h = A.T @ A, A.T @ b
    i, j = np.triu_indices(8)
    x = ratio.bounded_sparse(i, j, G[i, j], h, 0.0, 0.05)
    slope = G @ x - h
    assert (x >= 0).all() and (x <= 0.05).all()
    assert np.abs(slope[(x > 1e-12) & (x < 0.05 - 1e-12)]).max(initial=0) < 1e-9 and (slope[x <= 1e-12] > -1e-9).all() and (slope[x >= 0.05 - 1e-12] < 1e-9).all()
    assert ratio.bounded_sparse(np.array([0]), np.array([0]), np.array([0.0]), np.array([0.0, 0.0]), 0.0, 1.0).tolist() == [0, 0]  # nodes without data


def test_nodes_outside_the_support_go_and_odd_cells_take_no_part(spark, cells):
    odd = pd.concat([cells, pd.DataFrame({"x": [np.nan, 5], "y": [1.0, 5], "q2": [1.0, 0], "qd": 1.0, "d2": 1.0, "weight": 1.0})])
    df = spark.createDataFrame(odd).replace(float("nan"), None)
    p = ratio.problem(df, [10, 200], support=lambda n: n.where("sx <= 20"), neighbours=5)
    kept = p.nodes.toPandas()
    assert p.cells.count() == 60 and kept["sx"].max() == 20 and set(kept["spacing"]) == {10.0}  # 200: fewer than three nodes
    assert p.solve([1.0]).count() == len(kept)
    none = ratio.problem(df.limit(0), [10], neighbours=5)
    assert none.nodes.count() == 0 and none.errors([1.0]).count() == 0 and none.solve([1.0]).count() == 0


@pytest.mark.parametrize(("zone", "south"), [(50, False), (33, True)])
def test_projection_there_and_back(spark, zone, south):
    rows = [(zone * 6 - 183 + dx, s) for dx in (-3.5, -1.0, 0.0, 2.9) for s in ((-60.0, -0.5) if south else (0.0, 38.2, 79.0))]
    df = spark.createDataFrame(rows, "lon double, lat double")
    e, n = geo.utm(F.col("lon"), F.col("lat"), zone, south)
    x, y = geo.lonlat(F.col("e"), F.col("n"), zone, south)
    for r in df.withColumns({"e": e, "n": n}).withColumns({"x": x, "y": y}).collect():
        assert r["x"] == pytest.approx(r["lon"], abs=2e-8) and r["y"] == pytest.approx(r["lat"], abs=2e-8)
