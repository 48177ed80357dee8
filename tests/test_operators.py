"""Behaviour of the time-series operators on small inputs with known results."""

from datetime import date, timedelta

import numpy as np

import pytest
from pyspark.sql import functions as F

from terrachron.functions import basis, classes, geo
from terrachron.functions.basis import YEAR, TimeModel
from terrachron.functions.distributions import f_tail
from terrachron.operators import calendar, diagnostics, lsq, models, pairing, profile, seasonal, spatial, storage, trajectories, wells

EPOCH = date(1970, 1, 1)


def day(text):
    return (date.fromisoformat(text) - EPOCH).days


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def design(model, days):
    t = (np.asarray(days) - model.origin) / YEAR
    cols = [t**k for k in range(model.degree + 1)] + [np.maximum(0, t - (k - model.origin) / YEAR) for k in model.knots]
    for p in model.periods:
        a = 2 * np.pi * (np.asarray(days) - model.origin) / p
        cols += [np.sin(a), np.cos(a)]
    return np.column_stack(cols)


def test_quadratic_annual_fit(spark):
    days = list(range(day("2018-01-01"), day("2022-01-01"), 12))
    model, beta = TimeModel(days[0], 2), np.array([2, -30, 2.5, 8, -4.0])
    y = design(model, days) @ beta
    df = spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, y, strict=True)] + [(1, None, 1.0), (1, days[0], None), (2, days[0], 1.0)], "k int, day int, value double")
    rows = {r["k"]: r for r in lsq.fit(df, ["k"], model).collect()}
    assert np.allclose([rows[1][f"beta{i}"] for i in range(5)], beta, atol=1e-7, rtol=0)
    assert rows[1]["rss"] < 1e-8 and rows[1]["n"] == len(days)
    assert rows[2]["beta0"] is None and rows[2]["rss"] is None


def test_hinge_model_and_low_frequency_change(spark):
    days = list(range(day("2018-01-01"), day("2021-01-01"), 6))
    model = TimeModel(days[0], 1, knots=basis.year_knots(days[0], days[-1]))
    assert len(model.knots) == 2
    y = design(model, days) @ np.array([5, -10, 2, 2, 4, -2.0])
    df = spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, y, strict=True)], "k int, day int, value double")
    change = lsq.fit(df, ["k"], model).select(lsq.low_frequency_change(model, day("2019-01-01"), day("2020-01-01")).alias("c")).first()["c"]
    assert abs(change + 8) < 0.1


def test_masked_fits_agree(spark):
    rng = np.random.default_rng(7)
    days = list(range(17600, 17600 + 20 * 24, 24))
    Y = rng.normal(size=(8, 20))
    Y[2:4, 3:5] = np.nan
    Y[6:, 10] = np.nan
    model = TimeModel(days[0], 1)
    long = spark.createDataFrame([(i, d, None if np.isnan(Y[i, j]) else float(Y[i, j])) for i in range(8) for j, d in enumerate(days)], "k long, day int, value double")
    packed = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in Y[i]]) for i in range(8)], "k long, s array<double>")
    a = {r["k"]: [r[f"beta{i}"] for i in range(4)] + [r["rmse"]] for r in lsq.fit(long, ["k"], model).collect()}
    b = {r["k"]: [*r["beta"], r["rmse"]] for r in lsq.packed_fit(packed, "k", "s", days, model).collect()}
    c = {r["k"]: [r[f"beta{i}"] for i in range(4)] + [r["rmse"]] for r in lsq.solve_batches(lsq.gram(long, ["k"], list(model.columns().values())), ["k"], 4).collect()}
    for k in range(8):
        m = np.isfinite(Y[k])
        want = np.linalg.lstsq(design(model, np.array(days)[m]), Y[k][m], rcond=None)[0]
        assert np.allclose(a[k][:4], want, atol=1e-9) and np.allclose(a[k], b[k], atol=1e-9) and np.allclose(a[k], c[k], atol=1e-9)


def test_singular_fit_is_null(spark):
    df = spark.createDataFrame([(1, 5, float(v)) for v in range(10)], "k int, day int, value double")
    r = lsq.fit(df, ["k"], TimeModel(0, 1, ())).first()
    assert r["beta1"] is None


def test_lag_rotation(spark):
    s, c = basis.rotate(F.lit(0.0), F.lit(1.0), F.lit(30.0))
    assert spark.range(1).select(basis.phase_days(s, c).alias("p")).first()["p"] == pytest.approx(30)


def test_scores_and_classes(spark):
    one = spark.range(1)
    assert one.select((classes.bic(F.lit(1000.0), F.lit(100), 4) - classes.bic(F.lit(700.0), F.lit(100), 5)).alias("d")).first()["d"] > 0
    d = spark.createDataFrame([(i, v) for i, v in enumerate([-5.0, -1.0, 0.0, 1.0, 5.0, None])], "i int, d double")
    assert column(d.select("i", classes.bic_preferred(F.col("d")).alias("c")), "c", "i") == [1, 1, 1, 2, 2, 0]
    assert column(d.select("i", classes.bic_evidence(F.col("d")).alias("c")), "c", "i") == [1, 2, 2, 2, 3, 0]
    e = spark.createDataFrame([(0, -10.0, -10.0), (1, -10.0, -20.0), (2, -10.0, -4.0), (3, -10.0, -2.0), (4, 0.0, 0.0)], "i int, a double, b double")
    assert column(e.select("i", classes.deformation_class(F.col("a"), F.col("b")).alias("c")), "c", "i") == [2, 3, 5, 5, 1]
    g = spark.createDataFrame([(i, v) for i, v in enumerate([-2.0, -0.8, -0.2, 0.8, 2.0, None])], "i int, h double")
    assert column(g.select("i", classes.groundwater_state(F.col("h")).alias("c")), "c", "i") == [1, 0, 2, 0, 3, 0]
    rows = list(zip(range(6), [0.0, 2, 2, 2, 2, 0], [-2.0, 0, 0, 0, -2, 0], [2, 0, 0, 0, 2, 0], [2, 4, 2, 3, 3, 1], [-20.0, -8, -15, -25, -25, 0], [0.0, 10, 0, -20, -20, 0], strict=True))
    t = spark.createDataFrame([(i, float(a), float(b), c, m, float(x), float(y)) for i, a, b, c, m, x, y in rows], "i int, rec double, rcn double, n int, m int, late double, ch double")
    got = t.select("i", classes.coupled_class(*(F.col(c) for c in ("rec", "rcn", "n", "m", "late", "ch"))).alias("c"))
    assert column(got, "c", "i") == [1, 2, 3, 4, 5, 6]


def test_ratio_of_vectors(spark):
    df = spark.createDataFrame([(1, 0.0015 * 3e3, 0.0015 * 4e3, 3.0, 4.0)], "k int, d_sine double, d_cosine double, h_sine double, h_cosine double").withColumns({"d_amplitude": F.lit(7.5), "h_amplitude": F.lit(5.0)})
    r = seasonal.ratios(df, 0.0).first()
    assert r["ratio"] == pytest.approx(0.0015) and r["cosine"] == pytest.approx(1) and r["high_confidence"]


def test_gap_support(spark):
    src = spark.createDataFrame([(day(d), 1.0) for d in ("2020-01-01", "2020-01-10", "2020-04-20", "2020-04-30")], "day int, value double")
    q = spark.createDataFrame([(day(d),) for d in ("2020-01-05", "2020-02-15", "2020-04-25", "2020-01-10", "2019-01-01")], "day int")
    got = {r["day"]: r["supported"] for r in calendar.interpolate_at(src, q, [], 30).collect()}
    assert [got[day(d)] for d in ("2020-01-05", "2020-02-15", "2020-04-25", "2020-01-10", "2019-01-01")] == [True, False, True, True, False]


def test_short_gaps_only_inside(spark):
    values = {0: None, 1: 1.0, 2: None, 3: None, 4: 4.0, 5: None, 6: None, 7: None, 8: 8.0, 9: None}
    df = spark.createDataFrame([(1, k, v) for k, v in values.items()], "k int, day int, value double")
    assert column(calendar.fill_short_gaps(df, ["k"], 2), "value", "day") == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]
    assert sorted(r["length"] for r in calendar.missing_runs(df, ["k"]).collect()) == [1, 1, 2, 3]


def greedy(days):
    out, by = [], {}
    for d in sorted(set(days)):
        if d.month <= 8:
            by.setdefault(d.year, []).append(d)
    for y in by:
        free = list(by.get(y + 1, []))
        for s in by[y]:
            a = date(y + 1, s.month, 28 if (s.month, s.day) == (2, 29) else s.day)
            near = sorted((abs((t - a).days), t) for t in free if abs((t - a).days) <= 18)
            if near:
                free.remove(near[0][1])
                out.append((s, near[0][1]))
    return sorted(out)


def test_same_season_pairs(spark):
    text = ("2024-01-02", "2024-02-03", "2024-03-05", "2025-01-03", "2025-02-02", "2025-03-06")
    df = spark.createDataFrame([(1, date.fromisoformat(t)) for t in text], "k int, date date")
    rows = pairing.same_season_pairs(df, ["k"]).orderBy("date1").collect()
    assert [(r["date1"].isoformat(), r["date2"].isoformat()) for r in rows] == [(text[0], text[3]), (text[1], text[4]), (text[2], text[5])]
    assert all(abs(r["anniversary_offset_days"]) <= 1 for r in rows)
    rng = np.random.default_rng(3)
    many = [date(2019, 1, 1) + timedelta(days=int(v)) for v in rng.integers(0, 1500, 160)] + [date(2020, 2, 29)]
    got = pairing.same_season_pairs(spark.createDataFrame([(1, d) for d in many], "k int, date date"), ["k"]).collect()
    assert sorted((r["date1"], r["date2"]) for r in got) == greedy(many)


def test_slopes(spark):
    df = spark.createDataFrame([(k, float(x), y) for k, ys in enumerate([(0.0, 1.0, 2.0), (1.0, 3.0, 5.0), (None, 5.0, 7.0), (None, None, 1.0)]) for x, y in enumerate(ys)], "k int, x double, y double")
    assert column(trajectories.nan_slope(df, ["k"], "x", "y"), "slope", "k") == [1.0, 2.0, 2.0, None]


def test_jackknife(spark):
    rates = [3.0, 1.0, 2.0, 10.0, 5.0]
    df = spark.createDataFrame([(1, 2000, 2001, date(2000, 1, i + 1), date(2001, 1, i + 1), v) for i, v in enumerate(rates)], "k int, year1 int, year2 int, date1 date, date2 date, rate double")
    got = {r["date1"].day - 1: (r["median_without"], r["median_all"]) for r in pairing.jackknife(df, ["k"]).collect()}
    assert got == {i: (float(np.median(rates[:i] + rates[i + 1 :])), 3.0) for i in range(5)}


def spike_case(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "k string, day int, value double")


def test_spikes(spark):
    line = np.linspace(-50, -55, 61)
    line[30] = -120
    flagged = wells.spikes(spike_case(spark, line), ["k"]).where("spike").collect()
    assert [r["day"] for r in flagged] == [30]
    season = 20 * np.sin(2 * np.pi * np.arange(365) / 365)
    assert wells.spikes(spike_case(spark, season), ["k"]).where("spike").count() == 0


def test_wells_to_canonical(spark):
    wide = spark.createDataFrame([("A", 115.0, 38.0, " Deep ", 50.0, "30", "2.5", "x", "0"), ("B", None, 38.0, "deep", 10.0, "30", "1", "20", "-3")], "id string, lon double, lat double, layer string, depth double, elev string, `2020-01-01` string, `2020/1/2` string, `2020.1.3` string")
    long = wells.wide_to_long(wide, {"station_id": "id", "lon": "lon", "lat": "lat", "aquifer_class": "layer", "well_depth_m": "depth", "elevation_m": "elev"})
    heads, audit = wells.canonical(long, variable="depth_to_water", zero_is_missing=True)
    assert [(r["station_id"], r["date"].isoformat(), r["head_m"], r["aquifer_class"]) for r in heads.collect()] == [("A", "2020-01-01", 27.5, "deep")]
    assert [r["reason"] for r in audit.collect()] == ["zero_depth_sentinel"]
    assert wells.date_columns(["2020-13-01", "2020.01.05", "lat"]) == ["2020.01.05"]
    with pytest.raises(KeyError):
        wells.rename(wide, {"a": "nothing"})


def test_markers(spark):
    df = spark.createDataFrame([("深度（m）", "41", "150", "267", "401"), ("2020/01/15", "-100", "-70", "-30", "0"), ("2021/01/15", "-120", "-80", "-35", "0"), ("note", "", "", "", "")], "`标孔` string, F1 string, F2 string, F3 string, F4 string")
    m = profile.markers(df, date_column="标孔", depth_label="深度（m）", marker_columns=["F1", "F2", "F3", "F4"])
    assert m.count() == 8
    assert column(profile.intervals(m).where("date = '2020-01-15'"), "compaction_mm", "depth_top_m") == [30.0, 40.0, 30.0]
    assert column(profile.profile(m), "profile_compaction_mm", "date") == [100.0, 120.0]
    shares = column(profile.contributions(profile.intervals(m)), "fraction_of_profile_change", "depth_top_m")
    assert sum(shares) == pytest.approx(1)
    with pytest.raises(ValueError):
        profile.marker_sign("sideways")


def test_field_model_ranking(spark):
    cv = spark.createDataFrame([(4, 20.0, 0.3, 7.49, 3.21), (5, 25.0, 0.3, 7.74, 3.20), (6, 25.0, 0.3, None, 1.0)], "rank int, sigma double, ridge double, cv_rmse double, cv_harmonic_vector_rmse double")
    assert models.rank_field_models(cv).first()["rank"] == 4 and models.rank_field_models(cv).count() == 2


def test_low_rank_imputation_and_prediction(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 50, (30, 2))
    days = np.arange(0.0, 300.0, 10)
    truth = np.outer(1 + xy[:, 0] / 50, np.sin(days / 40)) + np.outer(xy[:, 1] / 50, np.cos(days / 60))
    seen = truth.copy()
    seen[rng.uniform(size=seen.shape) < 0.1] = np.nan
    model = models.field_fit(xy, seen, days, 2, 25.0, 1e-3)
    assert np.sqrt(np.mean((model.at(xy, days) - truth) ** 2)) < 0.05
    pixels = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pixel_id int, x double, y double")
    got = models.predict_field(pixels, model, [0, 100]).toPandas().pivot(index="pixel_id", columns="day", values="head_anomaly_m")
    assert np.allclose(got.to_numpy(), model.at(xy, np.array([0, 100.0])))


def test_head_change_audit(spark):
    rows = [(f"w{i}{j}", 2018 + k, float(i), float(j), 0.1 * i - 0.2 * j + k) for i in range(4) for j in range(3) for k in range(2)]
    rates = spark.createDataFrame(rows, "station_id string, year1 int, x double, y double, rate double")
    p = models.change_cv(rates, sigmas=[3.0], ridges=[1e-3], folds=3, block=1.5)
    assert p.count() == 24 and models.change_cv_by_interval(p).count() == 2
    assert {r["scope"] for r in trajectories.confusion(p, "actual_state", "predicted_state", ["year1"]).collect()} == {"all", "interval"}


def test_bounded_least_squares():
    rng = np.random.default_rng(0)
    A, x = rng.normal(size=(40, 6)), np.array([0.01, 0.08, -0.02, 0.03, 0.05, 0.0])
    got = models.bounded_least_squares(A, A @ x, 0.0, 0.05)
    grad = A.T @ (A @ got - A @ x)
    assert (got >= 0).all() and (got <= 0.05).all()
    assert all(abs(g) < 1e-6 or (v == 0 and g > 0) or (v == 0.05 and g < 0) for g, v in zip(grad, got, strict=True))


def test_f_tail():
    assert f_tail(np.array([4.0]), np.array([1.0]), np.array([20.0]))[0] == pytest.approx(0.0592655, abs=1e-6)
    assert f_tail(np.array([0.0]), np.array([2.0]), np.array([9.0]))[0] == pytest.approx(1)


def test_storage_identity(spark):
    df = storage.with_parts(spark.createDataFrame([(1, 10.0, 0.002, 3.0, 2.0), (2, -5.0, 0.001, 1.0, 4.0)], "k int, displacement_mm double, ratio double, head_change_m double, area double"))
    v = storage.volumes(df, []).first()
    assert v["total_gws_change_m3"] == pytest.approx(v["recoverable_gws_change_m3"] + v["irreversible_gws_change_m3"])
    assert v["gross_negative_irreversible_change_m3"] == pytest.approx(-0.006 * 4)


def test_space(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0)]
    hull = geo.convex_hull(square)
    assert len(hull) == 4
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0), (3, 4.0, 4.0)], "id int, x double, y double")
    assert column(p.select("id", geo.inside_hull(F.col("x"), F.col("y"), hull).alias("i")), "i", "id") == [True, False, True]
    assert column(spatial.clip(p, [square[:4]]), "in_domain", "id")[:2] == [True, False]
    near = spatial.radius_pairs(p, 4.5).collect()
    assert {(r["a"], r["b"]) for r in near} == {(1, 2), (1, 3), (2, 3)}
    x, y = geo.utm(F.lit(117.0), F.lit(39.0), 50)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(500000, abs=1e-6) and r["y"] == pytest.approx(4316776.583, abs=0.01)
    area = spark.range(1).select((geo.zone_area(F.lit(90.0)) * 4 * np.pi).alias("a")).first()["a"]
    assert area == pytest.approx(5.10065621724e14, rel=1e-9)
    two = spatial.neighbourhood(p.withColumnRenamed("id", "pixel_id"), 30.0, 30.0, 1.0)
    assert [r["pixel_id"] for r in two.collect()] == [3]


def test_statistics(spark):
    df = spark.createDataFrame([(1, float(v), float(w)) for v, w in [(1, 2), (2, 1), (2, 4), (3, 3), (5, 9), (8, 7), (9, 8), (4, 5), (6, 6), (7, 10)]], "k int, a double, b double")
    pdf = df.toPandas()
    assert diagnostics.spearman(df, ["k"], "a", "b").first()["spearman_rho"] == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))
    z = diagnostics.mad_zscore(spark.createDataFrame([(1, 1.0), (1, 1.0)], "k int, value double"), ["k"]).collect()
    assert [r["robust_z"] for r in z] == [0.0, 0.0]



def test_streaming_sums(spark, tmp_path):
    from terrachron.streaming import gram

    days = list(range(17600, 17600 + 400, 8))
    rows = spark.createDataFrame([(k, d, float(k + np.sin(d))) for k in (1, 2) for d in days], "k int, day int, value double")
    model = TimeModel(days[0], 1)
    rows.where(f"day < {days[25]}").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    gram.start(stream(), str(tmp_path / "sums"), str(tmp_path / "cp"), ["k"], model).awaitTermination()
    rows.where(f"day >= {days[25]}").write.mode("append").parquet(str(tmp_path / "in"))
    gram.start(stream(), str(tmp_path / "sums"), str(tmp_path / "cp"), ["k"], model).awaitTermination()
    got = {r["k"]: r["beta1"] for r in gram.fits(spark, str(tmp_path / "sums"), ["k"], model).collect()}
    want = {r["k"]: r["beta1"] for r in lsq.fit(rows, ["k"], model).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_sources(spark, tmp_path):
    from terrachron.sources import rasters, tables

    grid = rasters.Grid(3, 4, (0.5, 0.0, 10.0, 0.0, -0.5, 50.0), "EPSG:4326", -9999.0)
    values = np.arange(12, dtype="f4").reshape(3, 4)
    values[1, 1] = -9999
    (tmp_path / "a_20200101_20200113.tif").write_bytes(rasters.encode_tiff(values, grid))
    again, own = rasters.decode_tiff((tmp_path / "a_20200101_20200113.tif").read_bytes())
    assert np.array_equal(again, values) and own == grid
    cube = rasters.cube(spark, str(tmp_path), unit="cm", positive="subsidence", grid=grid).orderBy("pixel_id").collect()
    assert cube[2]["value"] == -20.0 and cube[5]["value"] is None and cube[0]["day"] == day("2020-01-13")
    spark.dataSource.register(rasters.GeoTiffSource)
    assert spark.read.format("terra_tiff").load(str(tmp_path / "a_20200101_20200113.tif")).where("value IS NOT NULL").count() == 11
    with pytest.raises(ValueError):
        rasters.unit_factor("ft")
    with pytest.raises(ValueError):
        rasters.check_epochs(spark.createDataFrame([(date(2020, 1, 1), date(2020, 1, 2)), (date(2020, 1, 1), date(2020, 1, 2))], "reference_date date, date date"))
    (tmp_path / "t.csv").write_text("﻿a,b\n1,\n", encoding="utf-8")
    assert tables.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.abc")
    (tmp_path / "p.json").write_text('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    assert len(tables.read_polygons(spark, str(tmp_path / "p.json"))[0]) == 4
    (tmp_path / "s.json").write_text('{"lag_days": 12.5}')
    assert tables.read_scalar(spark, str(tmp_path / "s.json"), "lag_days") == 12.5


def test_packed_holdout_and_verdict(spark):
    days = list(range(17600, 17600 + 800, 10))
    model = TimeModel(days[0], 1)
    rng = np.random.default_rng(3)
    Y = model.matrix(days) @ np.array([1, 2, 3, 4.0]) + rng.normal(size=(4, 80))
    Y[1, 5:9] = Y[2, 70] = np.nan
    packed = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in y]) for i, y in enumerate(Y)], "k long, s array<double>")
    long = spark.createDataFrame([(i, d, None if np.isnan(v) else float(v)) for i, y in enumerate(Y) for d, v in zip(days, y, strict=True)], "k long, day int, value double")
    a = {r["k"]: (r["n_test"], r["rmse"]) for r in lsq.packed_holdout(packed, "k", "s", days, model, days[60]).collect()}
    b = {r["k"]: (r["m_n_test"], r["m_rmse"]) for r in diagnostics.holdout(long, ["k"], {"m": model}, days[60], days[-1]).collect()}
    assert {k: n for k, (n, _) in a.items()} == {k: n for k, (n, _) in b.items()}
    assert all(a[k][1] == pytest.approx(b[k][1], abs=1e-9) for k in a)
    one = lambda text, *rows: spark.createDataFrame(list(rows), text)
    got = diagnostics.assess(one("pearson_r double, median_difference double", (0.95, 1.0), (0.8, 9.0)), one("shift_from_full double", (2.0,), (-4.0,)), one("plane_r2 double", (0.1,)), one("r double", (0.1,)), one("rank_recent int, scene_artifact_score double", (1, 9.0))).first()
    assert (got["real"], got["artifact"], got["verdict"]) == (3, 0, "persistent_signal")


def test_interval_sets_and_least_numbers():
    assert trajectories.interval_sets(list(range(2018, 2025))) == {"early": [2018, 2019, 2020], "late": [2022, 2023, 2024], "recent": [2022, 2023, 2024], "recovery": [2020, 2021], "all": list(range(2018, 2025))}
    three = trajectories.interval_sets([2018, 2019, 2020])
    assert three["recovery"] == [2018, 2019] and three["early"] == [2018] and three["late"] == [2020]
    assert trajectories.interval_sets([2018, 2019, 2020, 2021], {"recovery": [2018], "late": None})["recovery"] == [2018]
    with pytest.raises(ValueError):
        trajectories.interval_sets([2018, 2019], {"early": [2017]})
    assert trajectories.least_intervals(three) == {"valid": 3, "recent": 2, "recovery": 1, "declines": 2}
    assert trajectories.least_intervals(three, valid=1, recent=9, declines=3) == {"valid": 2, "recent": 3, "recovery": 1, "declines": 3}


def test_recent_change_and_validity(spark):
    """The recent change is slope times span, a gap included; places with too few intervals have no class."""
    years, sets = range(2018, 2024), trajectories.interval_sets(list(range(2018, 2024)))
    rates = {1: [-10, -10, -10, -12, -20, -24], 2: [-10, -10, -10, -12, None, -24], 3: [-10, None, None, None, -20, -24], 4: [-10, -10, -10, -10, None, -9]}
    heads = {1: [2, 2, 2, -2, -2, 0], 2: [2, 2, 2, -2, -2, 0], 3: [2, 2, 2, 2, -2, 0], 4: [2, 2, None, None, -2, -2]}
    table = lambda d: spark.createDataFrame([(k, y, None if v is None else float(v)) for k, own in d.items() for y, v in zip(years, own, strict=True)] + [(1, 2030, 99.0)], "k int, year1 int, rate double")
    got = {r["k"]: r for r in trajectories.classify(trajectories.interval_metrics(table(rates), table(heads), ["k"], sets)).collect()}
    assert [got[k]["valid"] for k in (1, 2, 3, 4)] == [True, True, False, True]
    assert got[1]["recent_rate_change"] == pytest.approx(-12) and got[2]["recent_rate_change"] == pytest.approx(-12)
    assert got[1]["rate_slope"] == pytest.approx(np.polyfit(np.arange(6), rates[1], 1)[0]) and got[1]["head_difference"] == -4
    assert got[3]["early_rate"] is None and got[3]["coupled_class"] == 255 == got[3]["deformation_class"]
    assert got[1]["coupled_class"] == 5 and got[1]["recent_declines"] == 2
    rows = trajectories.threshold_sensitivity(trajectories.interval_metrics(table(rates), table(heads), ["k"], sets), head=(0.2, 1.0, 2.5)).collect()
    assert {r["meaningful_head_change"] for r in rows} == {1.0, 2.5} and sum(r["pixel_count"] for r in rows) == 3 * 18
