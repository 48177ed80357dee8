"""The stages from rasters and wells to storage budgets: each reads tables of the outputs, and writes its own.

A stage is ``f(spark, config) -> summary``. Pixels are processed as rows; what the driver holds are wells, epochs,
models and one-row summaries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.functions import basis, classes, geo
from terrachron.functions.basis import TimeModel
from terrachron.operators import calendar, diagnostics, lsq, models, pairing, profile, ratio, seasonal, spatial, storage, trajectories, wells
from terrachron.plans.config import ProjectConfig
from terrachron.sources import rasters, tables

EPOCH = date(1970, 1, 1).toordinal()
Stage = Callable[[SparkSession, ProjectConfig], dict[str, Any]]


def day_of(value: object) -> int:
    return date.fromisoformat(str(value)[:10]).toordinal() - EPOCH


def grid_of(cfg: ProjectConfig) -> rasters.Grid:
    g = cfg.noted("insar/grid")
    return rasters.Grid(g["height"], g["width"], tuple(g["affine"]), g["crs"])


def zone_of(cfg: ProjectConfig) -> tuple[int, bool]:
    """UTM zone and hemisphere in which distances are measured."""
    g = grid_of(cfg)
    code = int(g.crs.split(":")[1])
    if 32600 < code < 32800:
        return code % 100, code > 32700
    a, _, c, _, e, f = g.affine
    return geo.utm_zone(c + a * g.width / 2), f + e * g.height / 2 < 0


def kilometres(cfg: ProjectConfig, lon: Column, lat: Column) -> tuple[Column, Column]:
    zone, south = zone_of(cfg)
    x, y = geo.utm(lon, lat, zone, south)
    return x / 1000, y / 1000


def on_pixels(cfg: ProjectConfig, nodes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Those of ``nodes`` (sx, sy in km) that lie on one of ``pixels`` (pixel_id) of the grid."""
    g = grid_of(cfg)
    east, north = F.col("sx") * 1000, F.col("sy") * 1000
    x, y = geo.lonlat(east, north, *zone_of(cfg)) if g.geographic else (east, north)
    at = spatial.points_to_pixels(nodes.withColumns({"x": x, "y": y}), g.affine, g.height, g.width)
    return at.join(pixels.select("pixel_id"), "pixel_id", "left_semi").select(*nodes.columns)


def prepare_insar(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("insar")
    path = cfg.resolve(s["path"])
    names = {"pattern": s.get("pattern", "*.tif"), "name": s.get("filename_regex", r"(\d{8})_(\d{8})\.tif$")}
    files = rasters.discover(spark, path, **names)
    g = rasters.grid_of(spark, files.first()["path"])
    cfg.note("insar/grid", {"height": g.height, "width": g.width, "affine": list(g.affine), "crs": g.crs})
    stack = rasters.cube(spark, path, unit=s.get("unit", "mm"), positive=s.get("positive", "uplift"), grid=g, **names)
    block = int(s.get("block_size", 256))
    rasters.write_cube(stack, f"{cfg.outputs}/insar/stack", g.width, block)
    rows = spatial.pixel_grid(spark.range(g.height * g.width).withColumnRenamed("id", "pixel_id"), g.width, block=block)
    x, y = geo.centre(F.col("row"), F.col("col"), g.affine)
    rows = rows.withColumns({"x": x, "y": y})
    if g.geographic:
        top, bottom = F.lit(g.affine[5]) + g.affine[4] * F.col("row"), F.lit(g.affine[5]) + g.affine[4] * (F.col("row") + 1)
        area = geo.geographic_area(top, bottom, g.affine[0])
        ux, uy = kilometres(cfg, F.col("x"), F.col("y"))
    else:
        area, ux, uy = F.lit(geo.projected_area(g.affine)), F.col("x") / 1000, F.col("y") / 1000
    rings = tables.read_polygons(spark, cfg.resolve(s["domain"])) if s.get("domain") else None
    if rings and not g.geographic:  # outlines come in degrees
        zone, south = zone_of(cfg)
        corners = spark.createDataFrame([(i, j, float(lon), float(lat)) for i, ring in enumerate(rings) for j, (lon, lat) in enumerate(ring)], "i int, j int, lon double, lat double")
        px, py = geo.utm(F.col("lon"), F.col("lat"), zone, south)
        moved = corners.select("i", "j", px.alias("x"), py.alias("y")).orderBy("i", "j").collect()
        rings = [[(r["x"], r["y"]) for r in moved if r["i"] == i] for i in range(len(rings))]
    rows = spatial.clip(rows, rings) if rings else rows.withColumn("in_domain", F.lit(True))
    cfg.write(rows.withColumns({"area": area, "ux": ux, "uy": uy}), "insar/pixels")
    row = cfg.read(spark, "insar/stack").agg(F.count_distinct("day").alias("n"), F.min("day").alias("a"), F.max("day").alias("b")).first()
    return cfg.note("insar/summary", {"epochs": row["n"], "first_day": row["a"], "last_day": row["b"], "pixels": g.height * g.width})


def stack_of(spark: SparkSession, cfg: ProjectConfig) -> DataFrame:
    inside = cfg.read(spark, "insar/pixels").where("in_domain").select("pixel_id")
    df = cfg.read(spark, "insar/stack").select("pixel_id", "day", "value").where("value IS NOT NULL").join(inside, "pixel_id", "left_semi")
    a = cfg.section("analysis")
    return wells.within(df, *(day_of(a[k]) if a.get(k) else None for k in ("start_date", "end_date")))


def prepare_groundwater(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("groundwater")
    raw = tables.read_table(spark, cfg.resolve(s["path"]), sheet=s.get("sheet_name"))
    fields = dict(s.get("fields") or {})
    long = wells.wide_to_long(raw, fields) if s.get("format", "long") == "wide" else wells.rename(raw, fields)
    if "value" not in long.columns:
        long = long.withColumnRenamed("head", "value") if "head" in long.columns else long.withColumnRenamed("head_m", "value")
    quality = s.get("spike_filter") or s.get("local_spike") or {}
    names = {"window_days": "window", "sigma": "sigma", "floor_m": "floor", "min_neighbors": "neighbours", "max_neighbor_gap_days": "gap"}
    spike = {names[k]: v for k, v in quality.items() if k in names} if quality.get("enabled") else None
    heads, audit = wells.canonical(long, variable=s.get("variable", "head"), labels=s.get("aquifer_labels"), least_depth=float(s.get("minimum_water_depth_m", -0.5)), zero_is_missing=bool(s.get("zero_is_missing", False)), spike=spike)
    heads = cfg.write(wells.in_order(heads), "groundwater/canonical")
    cfg.write(wells.in_order(audit), "groundwater/qc_report")
    n = heads.agg(F.count("*").alias("rows"), F.count_distinct("station_id").alias("wells")).first()
    return cfg.note("groundwater/summary", {**n.asDict(), "classes": {r["aquifer_class"]: r["wells"] for r in wells.class_counts(heads).collect()}})


def well_matrix(spark: SparkSession, cfg: ProjectConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Coordinates (km), daily anomalies, days and ids of the wells of the class that pass the coverage tests."""
    s = cfg.section("groundwater_field")
    rows = wells.of_class(cfg.read(spark, "groundwater/canonical"), s.get("aquifer"))
    if not wells.inconsistent_coordinates(rows, float(s.get("coordinate_tolerance_deg", 1e-5))).isEmpty():
        raise ValueError("a station has more than one place")
    daily = wells.daily_median(rows.select("station_id", F.unix_date("date").alias("day"), F.col("head_m").alias("value")), ["station_id"])
    a = cfg.section("analysis")
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    start, end = max(ends["a"], day_of(a["start_date"]) if a.get("start_date") else ends["a"]), min(ends["b"], day_of(a["end_date"]) if a.get("end_date") else ends["b"])
    daily = daily.where(F.col("day").between(start, end))
    filled = calendar.fill_short_gaps(calendar.reindex(daily, ["station_id"], start, end), ["station_id"], int(s.get("max_gap_days", 7)))
    b = s.get("baseline") or {}
    low, high = day_of(b["start"]) if b.get("start") else start, day_of(b["end"]) if b.get("end") else min(end, start + 365)
    moved = wells.baseline_anomaly(filled, ["station_id"], low, high, least=int(s.get("min_baseline_observations", 6)))
    kept = wells.coverage(moved, ["station_id"], end - start + 1, float(s.get("min_coverage_fraction", 0.5)), "anomaly").select("station_id")
    moved = moved.join(kept, "station_id", "left_semi")
    n = kept.count()
    if n < 4:
        raise ValueError(f"{n} wells pass the tests; four are needed")
    active = wells.active_days(moved, n, float(s.get("min_active_well_fraction", 0.0)), "anomaly").select("day")
    frame = moved.join(active, "day", "left_semi").select("station_id", "day", "anomaly").toPandas()
    wide = frame.pivot(index="station_id", columns="day", values="anomaly").sort_index()
    x, y = kilometres(cfg, F.col("lon"), F.col("lat"))
    places = rows.groupBy("station_id").agg(F.min_by("lon", "date").alias("lon"), F.min_by("lat", "date").alias("lat")).select("station_id", x.alias("x"), y.alias("y")).toPandas().set_index("station_id").loc[wide.index]
    return places.to_numpy(float), wide.to_numpy(float), wide.columns.to_numpy(float), list(wide.index)


def build_groundwater_field(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("groundwater_field")
    xy, matrix, days, ids = well_matrix(spark, cfg)
    rbf, cross = s.get("rbf") or {}, s.get("cross_validation") or {}
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    sigmas = rbf.get("sigma_km_candidates") or [rbf.get("sigma_km") or float(np.median(gaps[gaps > 0]))]
    ridges, ranks = rbf.get("ridge_candidates") or [rbf.get("ridge", 1e-3)], s.get("rank_candidates") or [s.get("rank", 4)]
    centres = int(rbf.get("max_centers", 32))
    pixels = cfg.read(spark, "insar/pixels")
    cv = cfg.write(models.field_cv(pixels, xy, matrix, days, ranks=ranks, sigmas=sigmas, ridges=ridges, folds=int(cross.get("folds", 5)), block=float(cross.get("block_km", 30)), seed=int(cross.get("random_state", 20260919)), centres=centres), "groundwater/field_cv")
    best = models.rank_field_models(cv).first()
    if best is None:
        raise ValueError("no candidate could be validated")
    model = models.field_fit(xy, matrix, days, best["rank"], best["sigma"], best["ridge"], centres, int(s.get("svd_iterations", 20)))
    cfg.write(model.table(pixels), "groundwater/field_model")
    stack = cfg.read(spark, "insar/stack").select("day").distinct()
    known = spark.createDataFrame([(int(d), 0.0) for d in days], "day int, value double")
    limit = s.get("max_temporal_interpolation_gap_days", 20)
    supported = calendar.interpolate_at(known, stack, [], None if limit is None else int(limit)).where("supported")
    epochs = sorted(r["day"] for r in supported.collect())
    if len(epochs) < 12:
        raise ValueError(f"{len(epochs)} epochs are supported by wells; twelve are needed")
    field = models.predict_field(pixels.select("pixel_id", F.col("ux").alias("x"), F.col("uy").alias("y")), model, epochs)
    cfg.write(field.withColumnRenamed("head_anomaly_m", "value"), "groundwater/field")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "site_id int, sx double, sy double")
    near = spatial.nearest_site(pixels.select("pixel_id", F.col("ux").alias("x"), F.col("uy").alias("y")), places)
    hull = geo.convex_hull([tuple(map(float, p)) for p in xy])
    most = (s.get("quality") or s.get("support") or {}).get("max_nearest_well_km")
    marked = spatial.support(pixels.select("pixel_id", F.col("ux").alias("x"), F.col("uy").alias("y"), "in_domain").join(near, "pixel_id"), hull, F.col("distance"), most)
    cfg.write(marked.select("pixel_id", F.col("in_domain").alias("prediction"), (F.col("inside_hull") & F.col("in_domain")).alias("inside_hull"), (F.col("high_confidence") & F.col("in_domain")).alias("high_confidence"), F.col("distance").alias("nearest_km")), "groundwater/support")
    return cfg.note("groundwater/field_summary", {"wells": len(ids), "rank": best["rank"], "sigma_km": best["sigma"], "ridge": best["ridge"], "cv_rmse_m": best["cv_rmse"], "cv_harmonic_vector_rmse_m": best["cv_harmonic_vector_rmse"], "epochs": len(epochs)})


#: Settings of evolution, of its groundwater_interpolation and of its sensitivity; block_size and reuse_existing_deformation_maps have no effect, since Spark cuts the work and maps are always made anew.
EVOLUTION = (
    "start_year end_year same_season_months max_pair_day_diff min_pairs_per_interval min_valid_intervals min_recent_intervals min_recovery_intervals recent_decline_min_intervals early_intervals late_intervals recovery_intervals recent_intervals "
    "stable_rate_mm_yr meaningful_rate_change_mm_yr stable_head_change_m_yr meaningful_head_change_m_yr groundwater_interpolation support_mask block_size reuse_existing_deformation_maps sensitivity aquifer pairing thresholds min_wells rbf cross_validation support"
).split()
INTERPOLATION = "max_centers sigma_km_candidates ridge_candidates folds block_km random_state min_wells_per_interval max_nearest_well_km".split()
SENSITIVITY = "stable_rate_mm_yr meaningful_rate_change_mm_yr meaningful_head_change_m_yr sample_stride".split()


def evolution_settings(cfg: ProjectConfig) -> dict[str, Any]:
    """All settings of evolution with their defaults; interpolation falls back on groundwater_field's. Names of the first version (pairing, thresholds, min_wells, rbf, cross_validation, support) still count where the others are absent."""
    s = cfg.section("evolution")
    own, sens = s.get("groundwater_interpolation") or {}, s.get("sensitivity") or {}
    for section, name, names in ((s, "evolution", EVOLUTION), (own, "evolution.groundwater_interpolation", INTERPOLATION), (sens, "evolution.sensitivity", SENSITIVITY)):
        known_names(section, name, *names)
    field, analysis, pairs, old = cfg.section("groundwater_field"), cfg.section("analysis"), s.get("pairing") or {}, s.get("thresholds") or {}
    rbf, cv = {**(field.get("rbf") or {}), **(s.get("rbf") or {})}, {**(field.get("cross_validation") or {}), **(s.get("cross_validation") or {})}
    year = lambda name, key: int(s[name]) if s.get(name) is not None else int(str(analysis[key])[:4]) if analysis.get(key) else None
    first_years = lambda name: [int(pair[0]) for pair in s[name]] if s.get(name) else None
    numbers = lambda values: [float(v) for v in values]
    out = {
        "start_year": year("start_year", "start_date"), "end_year": year("end_year", "end_date"), "months": [int(m) for m in s.get("same_season_months", pairs.get("months", (1, 8)))],
        "day_diff": int(s.get("max_pair_day_diff", pairs.get("max_day_diff", 18))), "pairs": int(s.get("min_pairs_per_interval", pairs.get("min_pairs", 3))),
        "sets": {name: first_years(f"{name}_intervals") for name in trajectories.SETS},
        "least": {"valid": s.get("min_valid_intervals"), "recent": s.get("min_recent_intervals"), "recovery": s.get("min_recovery_intervals"), "declines": s.get("recent_decline_min_intervals")},
        "stable_rate": float(s.get("stable_rate_mm_yr", old.get("stable_rate_mm_yr", 5))), "meaningful_rate": float(s.get("meaningful_rate_change_mm_yr", old.get("meaningful_rate_change_mm_yr", 5))),
        "stable_head": float(s.get("stable_head_change_m_yr", old.get("stable_head_m_yr", 0.5))), "meaningful_head": float(s.get("meaningful_head_change_m_yr", old.get("meaningful_head_m_yr", 1.0))),
        "centres": int(own.get("max_centers", rbf.get("max_centers", 32))), "sigmas": numbers(own.get("sigma_km_candidates", rbf.get("sigma_km_candidates", [10, 15, 20, 25]))), "ridges": numbers(own.get("ridge_candidates", rbf.get("ridge_candidates", [0.1, 0.3, 0.6, 1.0]))),
        "folds": int(own.get("folds", cv.get("folds", 5))), "block": float(own.get("block_km", cv.get("block_km", 30))), "seed": int(own.get("random_state", cv.get("random_state", 20260919))), "wells": int(own.get("min_wells_per_interval", s.get("min_wells", 8))),
        "nearest": own.get("max_nearest_well_km"), "support": str(s.get("support_mask", s.get("support", "high_confidence"))),
        "sensitivity": {"stable": numbers(sens.get("stable_rate_mm_yr", [3, 5, 10])), "change": numbers(sens.get("meaningful_rate_change_mm_yr", [3, 5, 10])), "head": numbers(sens.get("meaningful_head_change_m_yr", [0.5, 1, 1.5]))}, "stride": max(1, int(sens.get("sample_stride", 8))),
    }
    if out["meaningful_head"] < out["stable_head"]:
        raise ValueError("evolution: the meaningful head change is below the stable one")
    return out


def evolution_modes(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s, o = cfg.section("evolution"), evolution_settings(cfg)
    months, diff, least = tuple(o["months"]), o["day_diff"], o["pairs"]
    limits = {k: o[k] for k in ("stable_rate", "meaningful_rate", "stable_head", "meaningful_head")}
    stack = stack_of(spark, cfg).withColumn("date", F.date_from_unix_date("day"))
    epochs = pairing.same_season_pairs(stack.select("date").distinct(), [], months=(int(months[0]), int(months[-1])), max_day_diff=diff)
    pairs = [(r["year1"], r["year2"], r["date1"], r["date2"], r["elapsed_years"]) for r in epochs.orderBy("date1").collect() if (o["start_year"] or r["year1"]) <= r["year1"] and r["year2"] <= (o["end_year"] or r["year2"])]  # as many as epochs, at most
    if not pairs:
        raise ValueError("no two epochs are a year apart")
    rates = pairing.pair_rates(pairing.values_of_pairs(stack, pairs, ["pixel_id"]), ["pixel_id"], least=least)
    rates = cfg.write(rates.where("rate IS NOT NULL"), "evolution/interval_rates")
    heads = cfg.read(spark, "groundwater/canonical")
    if s.get("aquifer"):
        heads = heads.where(F.lower("aquifer_class") == str(s["aquifer"]).lower())
    own = pairing.valued_pairs(heads, ["station_id"], value="head_m", months=(int(months[0]), int(months[-1])), max_day_diff=diff)
    x, y = kilometres(cfg, F.col("lon"), F.col("lat"))
    places = heads.groupBy("station_id").agg(F.min_by("lon", "date").alias("lon"), F.min_by("lat", "date").alias("lat"), F.min_by("aquifer_class", "date").alias("aquifer_class")).withColumns({"x": x, "y": y})
    changes = pairing.pair_rates(own, ["station_id"], least=least).join(places, "station_id")
    changes = cfg.write(changes.where("rate IS NOT NULL"), "evolution/well_same_season_head_change")
    minimum = o["wells"]
    years = sorted(r["year1"] for r in trajectories.common_intervals(rates.select("year1").distinct(), changes, minimum).select("year1").distinct().collect())
    if len(years) < 2:
        raise ValueError(f"{len(years)} intervals have both variables; two are needed")
    cv = models.change_cv(changes.where(F.col("year1").isin(years)), sigmas=o["sigmas"], ridges=o["ridges"], folds=o["folds"], block=o["block"], seed=o["seed"], stable=o["stable_head"], meaningful=o["meaningful_head"], centres=o["centres"])
    cv = cfg.write(cv, "evolution/cv_predictions")
    best = models.change_cv_summary(cv).first()
    cfg.write(models.change_cv_summary(cv), "evolution/spatial_cv")
    chosen = cv.where((F.col("sigma") == best["sigma"]) & (F.col("ridge") == best["ridge"]))
    cfg.write(models.change_cv_by_interval(chosen), "evolution/spatial_cv_by_interval")
    cfg.write(trajectories.confusion(chosen, "actual_state", "predicted_state", ["year1"]), "evolution/state_confusion")
    pixels = cfg.read(spark, "insar/pixels").where("in_domain")
    support = spatial.select_support(cfg.read(spark, "groundwater/support"), o["support"]).select("pixel_id")
    inside = pixels.join(support, "pixel_id", "left_semi").select("pixel_id", F.col("ux").alias("x"), F.col("uy").alias("y"))
    maps = None
    for year in years:  # a few
        w = changes.where(F.col("year1") == year).orderBy("station_id").select("x", "y", "rate").toPandas()
        m = models.predict_change(inside, w[["x", "y"]].to_numpy(float), w["rate"].to_numpy(float), best["sigma"], best["ridge"], year, o["centres"])
        if o["nearest"] is not None:
            wells_of = changes.where(F.col("year1") == year).select(F.col("station_id").alias("site_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
            m = m.join(spatial.nearest_site(inside, wells_of).where(F.col("distance") <= float(o["nearest"])), "pixel_id", "left_semi")
        maps = m if maps is None else maps.unionByName(m)
    maps = cfg.write(maps.withColumn("state", classes.groundwater_state(F.col("head_change"), limits["stable_head"], limits["meaningful_head"])), "evolution/head_change_maps")
    sets = trajectories.interval_sets(years, o["sets"])
    needed = trajectories.least_intervals(sets, **o["least"])
    metrics = trajectories.interval_metrics(rates, maps.withColumnRenamed("head_change", "rate"), ["pixel_id"], sets, meaningful_head=o["meaningful_head"], least=needed)
    places = pixels.select("pixel_id", "row", "col", "area")
    table = cfg.write(trajectories.classify(metrics, least_declines=needed["declines"], **limits).join(places, "pixel_id"), "evolution/metrics")
    valid = table.where("valid")
    for name, column, labels in (("deformation", "deformation_class", classes.DEFORMATION), ("groundwater", "groundwater_state", classes.GROUNDWATER), ("coupled", "coupled_class", classes.COUPLED)):
        cfg.write(trajectories.histogram(valid, column, labels), f"evolution/{name}_summary")
    cfg.write(trajectories.cross_tab(valid, "groundwater_state", classes.GROUNDWATER, "deformation_class", classes.DEFORMATION), "evolution/cross_tab")
    sampled = spatial.stride(table, o["stride"])
    cfg.write(trajectories.threshold_sensitivity(sampled, **o["sensitivity"], stable_head=o["stable_head"], meaningful_head=o["meaningful_head"], least_declines=needed["declines"]), "evolution/threshold_sensitivity")
    return cfg.note("evolution/summary", {"intervals": years, "sets": sets, "sigma_km": best["sigma"], "ridge": best["ridge"], "cv_rmse_m_yr": best["cv_rmse"], "least_intervals": needed, "pixels": table.count(), "valid_pixels": valid.count()})


def decompose_insar(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("deformation")
    least, period, degree = int(s.get("min_observations", 24)), float(s.get("annual_period_days", basis.YEAR)), int(s.get("polynomial_degree", 2))
    if degree not in (1, 2):
        raise ValueError("the polynomial has degree 1 or 2")
    stack = stack_of(spark, cfg)
    ends = stack.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count_distinct("day").alias("n")).first()
    if ends["n"] < max(least, 8):
        raise ValueError(f"{ends['n']} epochs are too few")
    span = (ends["b"] - ends["a"]) / basis.YEAR
    one, two = TimeModel(ends["a"], 1, (period,)), TimeModel(ends["a"], 2, (period,))
    fits = lsq.fit_nested(stack, ["pixel_id"], two, one, min_obs=least)
    b, a = F.col("beta1"), F.col("beta2")
    features = classes.derivatives(b, a, span, float(s.get("vertex_min_abs_curvature", 1e-4)))
    out = fits.select(
        "pixel_id", "n", F.col("small_beta1").alias("linear_rate"), F.col("small_rmse").alias("linear_rmse"), F.col("rmse").alias("quadratic_rmse"), b.alias("linear_coefficient"), a.alias("quadratic_coefficient"), *(c.alias(n) for n, c in features.items()),
        F.col("beta3").alias("sine"), F.col("beta4").alias("cosine"), basis.amplitude(F.col("beta3"), F.col("beta4")).alias("amplitude"), basis.phase_days(F.col("beta3"), F.col("beta4"), period).alias("phase_days"), (classes.bic(F.col("small_rss"), F.col("n"), 4) - classes.bic(F.col("rss"), F.col("n"), 5)).alias("delta_bic"),
    )
    t = float(s.get("bic_threshold", 2.0))
    out = cfg.write(out.withColumns({"bic_preferred": classes.bic_preferred(F.col("delta_bic")), "bic_evidence": classes.bic_evidence(F.col("delta_bic"), t)}), "deformation/products")
    return cfg.note("deformation/summary", diagnostics.bic_counts(out, "delta_bic", t).first().asDict() | {"epochs": ends["n"], "origin_day": ends["a"]})


def shared_days(spark: SparkSession, cfg: ProjectConfig) -> tuple[DataFrame, DataFrame, list[int]]:
    """Displacement and head over the days that both have."""
    d, h = stack_of(spark, cfg), cfg.read(spark, "groundwater/field")
    days = sorted(r["day"] for r in d.select("day").distinct().join(h.select("day").distinct(), "day").collect())  # epochs
    return d.where(F.col("day").isin(days)), h.where(F.col("day").isin(days)), days


def joint_harmonics(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("seasonal_response")
    least, period = int(s.get("min_observations", 24)), float(s.get("annual_period_days", basis.YEAR))
    d, h, days = shared_days(spark, cfg)
    if len(days) < least:
        raise ValueError(f"{len(days)} shared epochs are too few")
    candidates = [int(k) for k in s.get("groundwater_polynomial_candidates", (1, 2))]
    wanted = s.get("groundwater_polynomial_degree", "auto")
    if wanted != "auto":
        degree = int(wanted)
    else:
        fits = {k: lsq.fit(h, ["pixel_id"], TimeModel(days[0], k, (period,)), min_obs=least) for k in candidates}
        if s.get("groundwater_model_selection", "aicc") == "f_test" and len(candidates) == 2:
            a, b = candidates
            degree = candidates[diagnostics.f_test_share(fits[a], fits[b], ["pixel_id"], a + 3, b + 3, float(s.get("groundwater_f_test_alpha", 0.05))).first()["degree"] - 1]
        else:
            degree = diagnostics.choose_degree(fits, {k: k + 3 for k in candidates}).first()["degree"]
    models_ = TimeModel(days[0], int(s.get("deformation_polynomial_degree", 2)), (period,)), TimeModel(days[0], degree, (period,))
    table = cfg.write(seasonal.joint(d, h, ["pixel_id"], *models_, min_obs=least).withColumn("phase_lag_days", seasonal.phase_lag(period)), "seasonal/products")
    return cfg.note("seasonal/summary", {"epochs": len(days), "origin_day": days[0], "groundwater_degree": degree, "pixels": table.count()})


def estimate_lag(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("seasonal_response")
    low, high = s.get("lag_search_days", (0, 180))
    d, h = float(s.get("min_deformation_amplitude_mm", 0.5)), float(s.get("min_head_amplitude_m", 0.2))
    table = cfg.read(spark, "seasonal/products")
    n = table.where(seasonal.valid(d, h)).count()
    if n < 10:
        raise ValueError(f"{n} pixels have both amplitudes; ten are needed")
    extra = cfg.noted("groundwater/field_summary").get("cv_harmonic_vector_rmse_m") or 0.0
    scan = cfg.write(seasonal.lag_scan(table, start=float(low), stop=float(high), step=float(s.get("lag_step_days", 0.5)), min_d=d, min_h=h, extra_head_sigma=extra), "seasonal/lag_scan")
    best = seasonal.best_lag(scan).first()
    return cfg.note("seasonal/lag", {"lag_days": best["lag_days"], "weighted_cosine_similarity": best["weighted_cosine_similarity"], "valid_pixels": n})


def estimate_ske(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s, r = cfg.section("ske"), cfg.section("seasonal_response")
    table = cfg.read(spark, "seasonal/products").join(cfg.read(spark, "groundwater/support").where("prediction").select("pixel_id"), "pixel_id", "left_semi")
    out = seasonal.ratios(
        table, float(cfg.noted("seasonal/lag")["lag_days"]), low=float(s.get("min", 0)), high=float(s.get("max", 0.05)), min_cosine=float(s.get("min_vector_cosine", 0)), high_cosine=float(s.get("high_confidence_min_vector_cosine", 0.7)), min_d=float(r.get("min_deformation_amplitude_mm", 0.5)), min_h=float(r.get("min_head_amplitude_m", 0.2))
    )
    out = cfg.write(out.withColumn("primary", F.when(F.col("support"), F.col("ratio"))).select("pixel_id", "ratio", "cosine", "base", "support", "high_confidence", "primary"), "ske/products")
    return cfg.note("ske/summary", diagnostics.quantile_summary(out.where("support"), [], "ratio").first().asDict())


def storage_budget(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("storage")
    d, h, days = shared_days(spark, cfg)
    period = float(s.get("annual_period_days", basis.YEAR))
    model = TimeModel(days[0], 1, (period,), basis.year_knots(days[0], days[-1]))
    least = max(int(s.get("min_observations", 24)), model.size + 2)
    fits = []
    for name, df in (("d", d), ("h", h)):
        f = lsq.fit(df, ["pixel_id"], model, min_obs=least)
        fits.append(f.select("pixel_id", F.col("n").alias(f"{name}_n"), *(F.col(f"beta{i}").alias(f"{name}{i}") for i in range(model.size))))
    pixels = cfg.read(spark, "insar/pixels").select("pixel_id", "area")
    ske = cfg.read(spark, "ske/products").where("support").select("pixel_id", F.col("primary").alias("ratio"), "cosine")
    joined = fits[0].join(fits[1], "pixel_id").join(ske, "pixel_id").join(pixels, "pixel_id")
    inside = storage.in_domain(F.col("d_n"), F.col("h_n"), F.lit(len(days)), F.col("ratio"), float(s.get("valid_fraction", 0.9)))
    domain = cfg.write(joined.where(inside & F.col("d0").isNotNull() & F.col("h0").isNotNull()), "storage/domain")
    base = calendar.nearest_epoch(spark.createDataFrame([(x,) for x in days], "day int"), spark.createDataFrame([(day_of(s["baseline_date"]) if s.get("baseline_date") else days[0],)], "target int"), []).first()["day"]
    end = min(day_of(s["end_date"]), days[-1]) if s.get("end_date") else days[-1]

    def change(name: str, a: float, b: float) -> Column:
        pairs = zip(model.low_frequency(a), model.low_frequency(b), strict=True)
        return sum((F.col(f"{name}{i}") * (y - x) for i, (x, y) in enumerate(pairs) if y != x), F.lit(0.0))

    def parts(a: float, b: float) -> DataFrame:
        rows = domain.select("pixel_id", "area", "cosine", "ratio", change("d", a, b).alias("displacement_mm"), change("h", a, b).alias("head_change_m"))
        return storage.with_parts(rows)

    whole = cfg.write(parts(base, end), "storage/total_maps")
    totals = storage.volumes(whole, []).first()
    ends = spark.createDataFrame([(date.fromordinal(EPOCH + base), date.fromordinal(EPOCH + end))], "start date, end date")
    yearly = calendar.annual_intervals(ends, []).orderBy("year").collect()  # a row a year
    maps = None
    for y in yearly:
        m = parts(y["start_date"].toordinal() - EPOCH, y["end_date"].toordinal() - EPOCH).withColumn("year", F.lit(y["year"]))
        maps = m if maps is None else maps.unionByName(m)
    maps = cfg.write(maps, "storage/annual_maps")
    threshold = float(s.get("diagnostic_threshold_mm", 1.0))
    intervals = spark.createDataFrame([(y["year"], y["start_date"], y["end_date"], y["complete_calendar_year"]) for y in yearly], "year int, start_date date, end_date date, complete_calendar_year boolean")
    cfg.write(intervals.join(storage.annual_summary(maps, threshold_mm=threshold), "year"), "storage/annual_summary")
    cfg.write(storage.volumes(maps, ["year"]), "storage/annual_change")
    cfg.write(storage.cosine_sensitivity(whole, tuple(s.get("ske_cosine_sensitivity", (0.0, 0.5, 0.7)))), "storage/cosine_sensitivity")
    cfg.write(storage.observed_series(d, h, domain.select("pixel_id", "ratio", "area"), base), "storage/cumulative_observed")
    return cfg.note("storage/summary", {**{k: v for k, v in totals.asDict().items()}, "baseline_day": base, "end_day": end, "years": len(yearly)})


def annual_storage_maps(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    maps = cfg.read(spark, "storage/annual_maps")
    saved = maps.select("year", "area", *((F.col(p) * 1000).alias(f"{p}_mm") for p in storage.PARTS))
    check = cfg.write(storage.reintegrate(saved, cfg.read(spark, "storage/annual_change")), "storage/annual_maps_volume_check")
    worst = check.agg(*(F.max(F.abs(f"{p}_difference")).alias(p) for p in storage.PARTS)).first().asDict()
    return cfg.note("storage/annual_maps_check", {"largest_difference_m3": worst})


def hydrostratigraphy(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s, g = cfg.section("hydrostratigraphy"), grid_of(cfg)
    pixels = cfg.read(spark, "insar/pixels").select("pixel_id", "x", "y")
    rows = None
    for layer in s.get("layers") or []:
        both = None
        for kind in ("sand", "clay"):
            path = cfg.resolve(layer[kind])
            own = rasters.grid_of(spark, path)
            source = spatial.pixel_grid(rasters.read_rasters(spark.createDataFrame([(path,)], "path string")), own.width).select("row", "col", "value")
            part = spatial.bilinear(pixels, source, own.affine).withColumnRenamed("value", kind)
            both = part if both is None else both.join(part, "pixel_id", "full")
        both = both.withColumn("layer_id", F.lit(str(layer["id"])))
        rows = both if rows is None else rows.unionByName(both)
    if rows is None:
        raise ValueError("hydrostratigraphy needs layers")
    rows = cfg.write(rows.withColumn("clay_fraction", classes.clay_fraction(F.col("sand"), F.col("clay"))), "hydrostratigraphy/layers")
    totals = cfg.write(profile.strata_totals(rows, len(s["layers"])), "hydrostratigraphy/totals")
    ratio = cfg.read(spark, "ske/products").where("support").select("pixel_id", F.col("primary").alias("target"))
    each = rows.select("layer_id", "pixel_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("sand", "clay", "clay_fraction")))).alias("m")).select("layer_id", "pixel_id", "m.metric", "m.value")
    cfg.write(diagnostics.spearman(each.join(ratio, "pixel_id"), ["layer_id", "metric"], "value", "target"), "hydrostratigraphy/correlations")
    return cfg.note("hydrostratigraphy/summary", {"layers": len(s["layers"]), "pixels": totals.count(), "grid": [g.height, g.width]})


def extensometer(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("extensometer")
    raw = tables.read_table(spark, cfg.resolve(s["path"]))
    if s.get("format") == "marker_table":
        first = s.get("date_column") or raw.columns[0]
        m = cfg.write(profile.markers(raw, date_column=first, depth_label=s["depth_row_label"], marker_columns=s.get("marker_columns") or [c for c in raw.columns if c != first], positive=s.get("marker_positive", "uplift")), "extensometer/markers")
        i, p = profile.intervals(m), profile.profile(m)
    else:
        rows = wells.coerce(wells.rename(raw, s["fields"]) if s.get("fields") else raw, ["depth_top_m", "depth_bottom_m", "compaction_mm"], keys=("date", "depth_bottom_m")) if "depth_top_m" in raw.columns or s.get("fields") else wells.coerce(raw, ["depth_bottom_m", "compaction_mm"], keys=("date", "depth_bottom_m"))
        i = profile.cumulative_to_intervals(rows) if s.get("measurement_type") == "cumulative_marker_displacement" else rows
        p = profile.profile_sum(i)
    i, p = cfg.write(i, "extensometer/intervals"), cfg.write(p, "extensometer/profile")
    cfg.write(profile.contributions(i), "extensometer/contributions")
    summary: dict[str, Any] = {"dates": p.count()}
    if s.get("lon") is not None and s.get("lat") is not None:
        x, y = kilometres(cfg, F.lit(float(s["lon"])), F.lit(float(s["lat"])))
        at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        pixels = cfg.read(spark, "insar/pixels").select("pixel_id", F.col("ux").alias("x"), F.col("uy").alias("y"))
        near = spatial.neighbourhood(pixels, at["x"], at["y"], float(s.get("comparison_radius_m", 500)) / 1000).select("pixel_id")
        series = profile.spatial_median(stack_of(spark, cfg).join(near, "pixel_id", "left_semi"))
        measured = p.select(F.unix_date("date").alias("day"), F.col("profile_compaction_mm").alias("value"))
        shared = calendar.interpolate_at(measured, series.select("day"), [], int(s.get("overlap_max_gap_days", 45))).where("supported").select("day", F.col("value").alias("profile_compaction_mm"))
        cfg.write(calendar.change_from_first(series.join(shared, "day"), [], value="value"), "extensometer/collocated")
        summary |= calendar.overlap([measured, series]).first().asDict()
    return cfg.note("extensometer/summary", summary)


def known_names(section: dict[str, Any], name: str, *names: str) -> None:
    """An error for a setting that nothing reads."""
    if unknown := sorted(set(section) - set(names) - {"enabled"}):
        raise ValueError(f"{name} has settings that nothing reads: {', '.join(unknown)}")


def classify_deformation(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s = cfg.section("regimes")
    known_names(s, "regimes", "feature_scheme", "k", "k_candidates", "training_spacing_km", "selection_sample_size", "random_state", "stable_rate_mm_yr", "deceleration_threshold_mm_yr", "predict_chunk_size")
    features = ["quadratic_coefficient", "linear_coefficient", "vertex_feature", "end_rate"]
    g, seed = grid_of(cfg), int(s.get("random_state", 20260919))
    rows = cfg.read(spark, "deformation/products").select("pixel_id", "start_rate", *features).dropna()
    n = rows.count()
    if n < 100:
        raise ValueError(f"{n} pixels have every feature; a hundred are needed")
    a, _, c, _, e, f = g.affine
    lat = f + e * g.height / 2
    dx, dy = (abs(a) * 111.320 * np.cos(np.radians(lat)), abs(e) * 110.574) if g.geographic else (abs(a) / 1000, abs(e) / 1000)
    spacing, most = float(s.get("training_spacing_km", 2.0)), int(s.get("selection_sample_size", 50_000))
    placed = spatial.pixel_grid(rows, g.width)
    sample = models.balanced_sample(placed, max(1, round(spacing / dy)), max(1, round(spacing / dx)), most, seed=seed, least=min(100, n))
    k = s.get("k")
    model, table = models.regime_model(rows, features, ks=[int(x) for x in s.get("k_candidates", (2, 3, 4, 5, 6))], k=None if k is None else int(k), seed=seed, sample=sample, most=most)
    cfg.write(table, "regimes/k_selection")
    model = models.ClusterModel.of(cfg.write(model.table(spark), "regimes/model"))
    out = cfg.write(model.assign(rows).select("pixel_id", "cluster_id", "start_rate", *features), "regimes/pixels")
    summary = models.cluster_summary(out, ["start_rate", *features])
    label = classes.regime_label(F.col("median_start_rate"), F.col("median_end_rate"), float(s.get("stable_rate_mm_yr", 5)), float(s.get("deceleration_threshold_mm_yr", 5)))
    summary = cfg.write(summary.withColumn("suggested_label", label), "regimes/cluster_summary")
    return cfg.note("regimes/summary", {"clusters": summary.count()})


def estimate_ske_regularized(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    s, r = cfg.section("ske"), cfg.section("seasonal_response")
    known_names(
        s, "ske", "observation_cell_km", "node_spacing_km_candidates", "lambda_candidates", "basis_sigma_factor", "max_basis_neighbors", "cv_block_km", "max_extrapolation_km", "min", "max", "min_vector_cosine",
        "high_confidence_min_vector_cosine", "aggregation_block_size", "rasterize_block_size", "method",
    )
    lag = F.lit(float(cfg.noted("seasonal/lag")["lag_days"]))
    sigma = float(cfg.noted("groundwater/field_summary").get("cv_harmonic_vector_rmse_m") or 0.0)
    sine, cosine = basis.rotate(F.col("h_sine"), F.col("h_cosine"), lag)
    size = float(s.get("observation_cell_km", 2.5))
    places = cfg.read(spark, "insar/pixels").select("pixel_id", F.col("ux").alias("x"), F.col("uy").alias("y"))
    supported = places.join(cfg.read(spark, "groundwater/support").where("prediction").select("pixel_id"), "pixel_id", "left_semi")
    waves = cfg.read(spark, "seasonal/products").join(supported, "pixel_id").withColumns({"hs": sine, "hc": cosine, "ds": F.col("d_sine") / 1000, "dc": F.col("d_cosine") / 1000})
    waves = waves.withColumns({"da": F.hypot("ds", "dc"), "ha": F.hypot("hs", "hc"), "dot": F.col("ds") * F.col("hs") + F.col("dc") * F.col("hc")})
    cos = F.col("dot") / F.greatest(F.col("da") * F.col("ha"), F.lit(1e-12))
    noise = F.pow(F.col("d_rmse") / 1000 / F.greatest(F.col("da"), F.lit(1e-9)), 2) + (F.col("h_rmse") * F.col("h_rmse") + sigma**2) / F.pow(F.greatest(F.col("ha"), F.lit(1e-9)), 2)
    quality = F.greatest(F.least(cos, F.lit(1.0)), F.lit(0.0)) / (1 + noise)
    valid = (cos > float(s.get("min_vector_cosine", 0))) & (F.col("ha") >= float(r.get("min_head_amplitude_m", 0.2))) & (F.col("da") * 1000 >= float(r.get("min_deformation_amplitude_mm", 0.5)))
    rows = waves.withColumn("w", quality).where(valid & F.col("w").isNotNull()).select("x", "y", (F.col("w") * F.col("ha") * F.col("ha")).alias("q2"), (F.col("w") * F.col("dot")).alias("qd"), (F.col("w") * F.col("da") * F.col("da")).alias("d2"), "w")
    sums = rows.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(*(F.sum(c).alias(c) for c in ("q2", "qd", "d2", "w"))).where("q2 > 0 AND w > 0")
    cells = cfg.write(sums.select(((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"), "q2", "qd", "d2", F.col("w").alias("weight")), "ske/cells")
    n_cells = cells.count()
    if n_cells < 10:
        raise ValueError(f"{n_cells} cells have a seasonal response; ten are needed")
    ends = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    most, factor, neighbours = float(s.get("max_extrapolation_km", 30)), float(s.get("basis_sigma_factor", 1.5)), int(s.get("max_basis_neighbors", 12))
    bounds = {"low": float(s.get("min", 0.0)), "high": float(s.get("max", 0.05))}
    spacings, lams = s.get("node_spacing_km_candidates", (10, 15, 20, 25)), s.get("lambda_candidates", (0.1, 1, 10, 100))
    inside = supported.select("pixel_id")
    posed = ratio.problem(cells, spacings, most=most, block=float(s.get("cv_block_km", 30)), support=lambda nodes: on_pixels(cfg, nodes, inside), box=tuple(ends), sigma_factor=factor, neighbours=neighbours)
    cv = cfg.write(posed.errors(lams, **bounds), "ske/regularized_cv")
    best = models.best_regularised(cv).first()
    if best is None:
        raise ValueError("no candidate could be validated")
    spacing = float(best["spacing"])
    solved = posed.solve([best["lam"]], spacing=spacing, **bounds).select("site_id", "value")
    sites = cfg.write(posed.nodes.where(F.col("spacing") == spacing).join(solved, "site_id").select("site_id", "sx", "sy", "value"), "ske/regularized_nodes")
    seen = posed.cells.select(F.col("cell_id").alias("site_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    near = spatial.nearest_site(supported, seen).where(F.col("distance") <= most).select("pixel_id")
    weights = spatial.knn_weights(supported.join(near, "pixel_id", "left_semi"), sites.select("site_id", "sx", "sy"), neighbours, factor * spacing)
    cfg.write(weights.join(sites.select("site_id", "value"), "site_id").groupBy("pixel_id").agg(F.sum(F.col("weight") * F.col("value")).alias("ske_effective")), "ske/regularized")
    return cfg.note("ske/regularized_summary", {"spacing_km": spacing, "lambda": float(best["lam"]), "cv_rmse_m": float(best["cv_rmse"]), "nodes": best["nodes"], "cells": n_cells})


def synthesize(spark: SparkSession, cfg: ProjectConfig) -> dict[str, Any]:
    maps = cfg.read(spark, "storage/total_maps")
    rows = cfg.read(spark, "regimes/pixels").join(maps.drop("area"), "pixel_id")
    names = ["end_rate", "head_change_m", "ratio", "recoverable", "irreversible"]
    labels = cfg.read(spark, "regimes/cluster_summary").select("cluster_id", F.col("suggested_label").alias("regime"))
    out = cfg.write(models.cluster_summary(rows, names).join(labels, "cluster_id").withColumnRenamed("pixel_count", "storage_domain_pixel_count"), "synthesis/response_by_regime")
    return cfg.note("synthesis/summary", {"regimes": out.count()})


CORE: dict[str, Stage] = {
    "prepare-insar": prepare_insar,
    "prepare-groundwater": prepare_groundwater,
    "build-groundwater-field": build_groundwater_field,
    "evolution-modes": evolution_modes,
    "decompose-insar": decompose_insar,
    "joint-harmonics": joint_harmonics,
    "estimate-lag": estimate_lag,
    "estimate-ske": estimate_ske,
    "storage-budget": storage_budget,
    "annual-storage-maps": annual_storage_maps,
}
OPTIONAL: dict[str, Stage] = {
    "hydrostratigraphy": hydrostratigraphy,
    "extensometer": extensometer,
    "classify-deformation": classify_deformation,
    "estimate-ske-regularized": estimate_ske_regularized,
    "synthesize-legacy": synthesize,
}
STAGES = CORE | OPTIONAL


def run_stage(spark: SparkSession, cfg: ProjectConfig, name: str) -> dict[str, Any]:
    if name not in STAGES:
        raise KeyError(f"no stage {name}; there are {', '.join(STAGES)}")
    return STAGES[name](spark, cfg)


def run_pipeline(spark: SparkSession, cfg: ProjectConfig, start: str | None = None, stop: str | None = None, only: str | None = None) -> dict[str, dict[str, Any]]:
    """Core stages from ``start`` to ``stop``, or one of them."""
    names = list(CORE)
    if only:
        if only not in CORE:
            raise ValueError("only a core stage can be run alone here; use the stage command for others")
        return {only: run_stage(spark, cfg, only)}
    first, last = names.index(start) if start else 0, names.index(stop) if stop else len(names) - 1
    if last < first:
        raise ValueError("the last stage comes before the first")
    return {n: run_stage(spark, cfg, n) for n in names[first : last + 1]}


#: Stages that have figures, and the error of reading tables that are not there.
FIGURES = ("prepare-groundwater", "build-groundwater-field", "evolution-modes", "decompose-insar", "joint-harmonics", "estimate-lag", "estimate-ske", "storage-budget", "annual-storage-maps", "classify-deformation", "estimate-ske-regularized", "synthesize-legacy")
NOT_RUN = AnalysisException


def plot_data(spark: SparkSession, cfg: ProjectConfig, stage: str, most: int = 1400) -> dict[str, DataFrame]:
    """What a figure of a stage shows, as small tables: decimated grids with display limits, scans and series."""
    g = grid_of(cfg)
    step = max(1, -(-max(g.height, g.width) // most))
    maps = {"decompose-insar": ("deformation/products", "end_rate", True), "joint-harmonics": ("seasonal/products", "d_amplitude", False), "estimate-ske": ("ske/products", "primary", False), "storage-budget": ("storage/total_maps", "irreversible", True), "evolution-modes": ("evolution/metrics", "late_rate", True), "build-groundwater-field": ("groundwater/support", "nearest_km", False), "classify-deformation": ("regimes/pixels", "cluster_id", False), "estimate-ske-regularized": ("ske/regularized", "ske_effective", False)}
    if stage in maps:
        name, value, symmetric = maps[stage]
        rows = spatial.stride(spatial.pixel_grid(cfg.read(spark, name).select("pixel_id", F.col(value).alias("value")), g.width), step)
        return {"grid": rows, "limits": spatial.display_limits(rows, symmetric=symmetric)}
    if stage == "estimate-lag":
        return {"scan": cfg.read(spark, "seasonal/lag_scan")}
    if stage == "prepare-groundwater":
        return {"active": wells.monthly_active(cfg.read(spark, "groundwater/canonical"))}
    if stage == "synthesize-legacy":
        return {"regimes": cfg.read(spark, "synthesis/response_by_regime")}
    if stage == "annual-storage-maps":
        return {"volumes": cfg.read(spark, "storage/annual_change")}
    raise KeyError(f"no figure for {stage}")
