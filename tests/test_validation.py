"""Cross-validation by sums over wells against the fits on whole matrices."""

import numpy as np
import pytest

from terrachron.operators import models, validation


@pytest.fixture(scope="module")
def wells():
    rng, n, days = np.random.default_rng(3), 60, np.arange(24) * 30.0
    xy = np.column_stack([np.arange(n) % 10 * 5.0, np.arange(n) // 10 * 5.0])
    matrix = np.sin(xy[:, :1] / 9) * np.cos(days / 58)[None] + xy[:, 1:] / 30 * np.sin(days / 200) + rng.normal(0, 0.1, (n, 24))
    matrix[rng.random(matrix.shape) < 0.3] = np.nan
    return xy, matrix, days


def test_field_models_by_sums(spark, wells):
    xy, matrix, days = wells
    options = {"ranks": [2], "sigmas": [10.0], "ridges": [0.01, 0.1], "block": 15.0, "centres": 6}
    want = sorted(models.field_cv(spark.range(0), xy, matrix, days, **options).collect())
    rows = spark.createDataFrame([(i, *map(float, at), own.tolist()) for i, (at, own) in enumerate(zip(xy, matrix, strict=True))], "id long, x double, y double, series array<double>").repartition(3)
    got = sorted(validation.field_cv(rows, days, **options).collect())
    assert len(got) == len(want) == 2 and np.allclose(np.array(got, float), np.array(want, float), rtol=1e-9)


def test_changes_are_validated_without_a_group_of_all_wells(spark, wells):
    xy, matrix, _ = wells
    rates = [(str(i), 1999 + k, *map(float, xy[i]), float(v)) for i in range(60) for k in (0, 1) if np.isfinite(v := matrix[i, k])] + [(str(i), 1990, float(i), 1.0, 1.0) for i in range(3)]
    found = models.change_cv(spark.createDataFrame(rates, "station_id string, year1 int, x double, y double, rate double").repartition(3), sigmas=[10.0], ridges=[0.1], block=10.0, centres=5)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x["year1"], x["station_id"]): x["predicted"] for x in found.collect()}
    for year in (1999, 2000):
        own = sorted(r for r in rates if r[1] == year)
        at, v = np.array([r[2:4] for r in own]), np.array([r[4] for r in own])
        fold = models.block_folds(at, 10.0, 5, 20260919)
        for f in set(fold):
            c = models.spread_centres(at[fold != f], 5)
            want = models.rbf_basis(at[fold == f], c, 10.0) @ models.rbf_fit(at[fold != f], v[fold != f], c, 10.0, 0.1)
            assert all(abs(got[year, r[0]] - w) < 1e-9 for r, w in zip([r for r, g in zip(own, fold, strict=True) if g == f], want, strict=True))
    assert not [k for k in got if k[0] == 1990]
