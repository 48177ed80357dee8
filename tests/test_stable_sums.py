"""Fits of series far from zero: residuals as of the same series about zero, in one aggregation, in batches and on a stream."""

import numpy as np
import pandas as pd
import pytest

from terrachron.functions.basis import TimeModel
from terrachron.operators import lsq
from terrachron.streaming import gram


@pytest.mark.parametrize("model", [TimeModel(17_000, 2), TimeModel(17_000, 1, knots=(17_400, 17_800))])
def test_residuals_far_from_zero(spark, model):
    rng = np.random.default_rng(2)
    days = np.arange(17_000, 18_200, 11)
    X = model.matrix(days)
    frame, want = [], {}
    for k, offset in enumerate((0.0, 1e6, -1e8)):
        y = offset + X[:, 1:] @ rng.normal(0, 3, model.size - 1) + rng.normal(0, 0.01, len(days))
        y[5:8] = np.nan
        there = np.isfinite(y)
        exact = y[there] - offset
        beta = np.linalg.lstsq(X[there], exact, rcond=None)[0]
        want[k] = (np.sqrt(np.mean((exact - X[there] @ beta) ** 2)), beta, offset)
        frame.append(pd.DataFrame({"k": k, "day": days, "value": y}))
    rows = [(int(k), int(d), None if np.isnan(v) else float(v)) for k, d, v in pd.concat(frame).itertuples(index=False)]
    df = spark.createDataFrame(rows, "k int, day int, value double")
    columns = list(model.columns().values())
    sums = lsq.gram(df, ["k"], columns)
    merged = gram.add(lsq.gram(df.where("day < 17300"), ["k"], columns), lsq.gram(df.where("day >= 17300"), ["k"], columns), ["k"])
    for fits in (lsq.fit(df, ["k"], model), lsq.solve_batches(sums, ["k"], model.size), lsq.solve(merged, ["k"], model.size)):
        got = {r["k"]: r for r in fits.collect()}
        for k, (rmse, beta, offset) in want.items():
            assert abs(got[k]["rmse"] - rmse) < 1e-6, (k, got[k]["rmse"], rmse)
            found = np.array([got[k][f"beta{i}"] for i in range(model.size)])
            assert np.allclose(found[1:], beta[1:], atol=1e-4) and abs(found[0] - offset - beta[0]) < 1e-4


def test_basis_without_a_constant(spark):
    df = spark.createDataFrame([(x, float(2 * x + (-1) ** x)) for x in range(1, 30)], "x int, value double")
    got = lsq.fit_columns(df.selectExpr("1 AS k", "*"), ["k"], ["CAST(x AS DOUBLE)"]).first()
    x = np.arange(1, 30)
    y = 2 * x + (-1.0) ** x
    beta = (x @ y) / (x @ x)
    assert abs(got["beta0"] - beta) < 1e-12 and abs(got["rss"] - ((y - beta * x) ** 2).sum()) < 1e-9
    assert lsq.fit_columns(df.limit(0).selectExpr("1 AS k", "*"), ["k"], ["1", "x"]).count() == 0
