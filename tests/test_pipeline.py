"""The synthetic case end to end: 20 x 20 pixels, 61 epochs, 12 wells, known lag, ratio and irreversible volume."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
import yaml

from terrachron.plans import stages
from terrachron.plans.cli import main
from terrachron.plans.config import load_config
from terrachron.sources import rasters

P, SIZE = 365.2425, 20
FIRST = date(2018, 1, 1)
#: Rows and columns of the wells, slopes of the years (below), settings and bounds of the case.
WELLS = [(2, 2), (2, 8), (2, 14), (2, 18), (7, 4), (7, 11), (7, 17), (12, 2), (12, 8), (12, 15), (17, 5), (17, 17)]


def head(t, x, y):
    return (0.35 + 0.002 * x) * t / P + (5 + 0.03 * x + 0.02 * y) * np.cos(2 * np.pi * t / P - (0.4 + 0.002 * y))


def irreversible(day, x):
    out = np.zeros_like(x, dtype=float)
    for year, west, east in zip(range(2018, 2023), (-10, -8, -6, -4, -3), (-4, -3, -2, -1, -0.5), strict=True):
        a, b = (date(year, 1, 1) - FIRST).days, (date(year + 1, 1, 1) - FIRST).days
        out = out + np.where(x < 10, west, east) * (min(day, b) - a) / P * (day > a)
    return out


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("case")
    (root / "insar").mkdir()
    grid = rasters.Grid(SIZE, SIZE, (0.02, 0.0, 115.0, 0.0, -0.02, 38.5), "EPSG:4326", -9999.0)
    y, x = np.mgrid[0:SIZE, 0:SIZE].astype(float)
    zero = 2.0 * head(-50, x, y)
    day = date(2018, 1, 13)
    while day < date(2022, 1, 1):
        t = (day - FIRST).days
        values = irreversible(t, x) + 2.0 * head(t - 50, x, y) - zero
        (root / "insar" / f"geo_20180101_{day:%Y%m%d}.tif").write_bytes(rasters.encode_tiff(values.astype("f4"), grid))
        day += timedelta(days=24)
    rows = []
    for i, (r, c) in enumerate(WELLS):
        for t in range(1461):
            rows.append((f"W{i:02d}", (FIRST + timedelta(days=t)).isoformat(), 115.0 + 0.02 * (c + 0.5), 38.5 - 0.02 * (r + 0.5), "Confined", head(t, c, r)))
    pd.DataFrame(rows, columns=["well", "when", "lon", "lat", "layer", "level"]).to_csv(root / "wells.csv", index=False)
    (root / "markers.csv").write_text("﻿标孔,F1,F2,F3,F4\n深度（m）,41,150,267,401\n2020/01/15,-100,-70,-30,0\n2021/01/15,-120,-80,-35,0\n", encoding="utf-8")
    config = {
        "project": {"root": "."},
        "insar": {"path": "insar", "pattern": "geo_*.tif", "filename_regex": r"geo_(\d{8})_(\d{8})\.tif$", "unit": "mm", "block_size": 10},
        "groundwater": {"path": "wells.csv", "format": "long", "variable": "head", "fields": {"station_id": "well", "date": "when", "lon": "lon", "lat": "lat", "aquifer_class": "layer", "value": "level"}},
        "groundwater_field": {"aquifer": "confined", "rank_candidates": [2], "rbf": {"sigma_km_candidates": [25], "ridge_candidates": [1e-3]}, "cross_validation": {"folds": 3, "block_km": 20}, "baseline": {"start": "2018-01-01", "end": "2018-03-31"}},
        "evolution": {"min_wells": 8, "rbf": {"sigma_km_candidates": [25], "ridge_candidates": [0.01]}, "support": "prediction"},
        "seasonal_response": {"lag_search_days": [0, 100], "lag_step_days": 1},
        "storage": {"baseline_date": "2018-01-13", "valid_fraction": 0.8},
        "extensometer": {"path": "markers.csv", "format": "marker_table", "date_column": "标孔", "depth_row_label": "深度（m）", "marker_columns": ["F1", "F2", "F3", "F4"], "lon": 115.21, "lat": 38.29},
        "regimes": {"k_candidates": [2, 3], "selection_sample_size": 300},
        "ske": {"node_spacing_km_candidates": [15], "lambda_candidates": [0.1, 1], "observation_cell_km": 5, "cv_block_km": 12},
    }
    (root / "project.yaml").write_text(yaml.safe_dump(config, allow_unicode=True), encoding="utf-8")
    return root / "project.yaml"


def test_core_stages_recover_the_truth(spark, project):
    cfg = load_config(project)
    result = stages.run_pipeline(spark, cfg)
    assert list(result) == list(stages.CORE)
    assert result["prepare-insar"]["epochs"] == 61
    assert result["prepare-groundwater"] == {"rows": 17532, "wells": 12, "classes": {"confined": 12}}
    assert abs(result["estimate-lag"]["lag_days"] - 50) <= 3
    assert abs(result["estimate-ske"]["median"] - 0.002) <= 6e-4
    s = result["storage-budget"]
    pixels = cfg.read(spark, "insar/pixels").toPandas().sort_values("pixel_id")
    a, b = s["baseline_day"] - stages.day_of(FIRST), s["end_day"] - stages.day_of(FIRST)
    x = pixels["col"].to_numpy(float)
    truth = float(((irreversible(b, x) - irreversible(a, x)) / 1000 * pixels["area"]).sum())
    assert abs(s["irreversible_gws_change_m3"] - truth) <= 0.05 * abs(truth)
    assert abs(s["total_gws_change_m3"] - s["recoverable_gws_change_m3"] - s["irreversible_gws_change_m3"]) <= 1e-8 * abs(s["total_gws_change_m3"])
    worst = result["annual-storage-maps"]["largest_difference_m3"]
    assert max(worst.values()) <= 1e-6 * abs(s["total_gws_change_m3"])
    assert result["evolution-modes"]["pixels"] == SIZE * SIZE


def test_optional_stages_and_figures(spark, project):
    cfg = load_config(project)
    assert stages.run_stage(spark, cfg, "extensometer")["dates"] == 2
    assert stages.run_stage(spark, cfg, "classify-deformation")["clusters"] in (2, 3)
    assert stages.run_stage(spark, cfg, "synthesize-legacy")["regimes"] >= 1
    assert abs(stages.run_stage(spark, cfg, "estimate-ske-regularized")["cv_rmse_m"]) < 1
    assert cfg.read(spark, "ske/regularized").agg({"ske_effective": "avg"}).first()[0] == pytest.approx(0.002, abs=6e-4)
    assert stages.plot_data(spark, cfg, "decompose-insar")["grid"].count() == SIZE * SIZE
    assert stages.plot_data(spark, cfg, "estimate-lag")["scan"].count() == 101
    assert cfg.read(spark, "regimes/k_selection").count() == 2
    clusters = cfg.read(spark, "regimes/pixels").groupBy("cluster_id").count().count()
    assert clusters == cfg.read(spark, "regimes/cluster_summary").count()
    for name in stages.FIGURES:
        assert all(t.columns for t in stages.plot_data(spark, cfg, name).values())


def test_settings_that_nothing_reads_are_errors(spark, project):
    cfg = load_config(project)
    for section, stage in (("regimes", "classify-deformation"), ("ske", "estimate-ske-regularized")):
        bad = type(cfg)(cfg.data | {section: {"k_range": [2, 3]}}, cfg.root)
        with pytest.raises(ValueError, match="k_range"):
            stages.run_stage(spark, bad, stage)


def test_wide_wells_give_the_long_ones(spark, project, tmp_path):
    """The wide format through its stage: depths below the ground, a column a date."""
    cfg = load_config(project)
    rows = [(f"W{i}", 115.0 + i * 0.01, 38.0, "Confined", 50.0 + i, [10.0 + i, None, 12.5 + i]) for i in range(3)]
    pd.DataFrame([(*r[:5], *r[5]) for r in rows], columns=["well", "lon", "lat", "layer", "top", "2018-01-01", "2018/01/02", "2018.1.3"]).to_csv(tmp_path / "wide.csv", index=False)
    wide = {"path": str(tmp_path / "wide.csv"), "format": "wide", "variable": "depth_to_water", "fields": {"station_id": "well", "lon": "lon", "lat": "lat", "aquifer_class": "layer", "elevation_m": "top"}}
    own = type(cfg)({"outputs": str(tmp_path / "out"), "groundwater": wide}, tmp_path)
    assert stages.run_stage(spark, own, "prepare-groundwater") == {"rows": 6, "wells": 3, "classes": {"confined": 3}}
    got = [(r["station_id"], str(r["date"]), r["head_m"]) for r in own.read(spark, "groundwater/canonical").collect()]
    assert sorted(got) == sorted((r[0], d, r[4] - v) for r in rows for d, v in zip(("2018-01-01", "2018-01-02", "2018-01-03"), r[5], strict=True) if v is not None)


def test_hydrostratigraphy(spark, project, tmp_path):
    """Layers of sand and clay as rasters on the pixel grid: totals where all layers are there."""
    cfg = load_config(project)
    g = stages.grid_of(cfg)
    rng = np.random.default_rng(4)
    layers, sand, clay = [], [], []
    for i in range(2):
        sand.append(rng.uniform(1, 9, (SIZE, SIZE)).astype("f4"))
        clay.append(rng.uniform(1, 9, (SIZE, SIZE)).astype("f4"))
        sand[i][i, i] = np.nan
        for kind, values in (("sand", sand[i]), ("clay", clay[i])):
            (tmp_path / f"{kind}{i}.tif").write_bytes(rasters.encode_tiff(values, g))
        layers.append({"id": f"L{i}", "sand": str(tmp_path / f"sand{i}.tif"), "clay": str(tmp_path / f"clay{i}.tif")})
    own = type(cfg)(cfg.data | {"hydrostratigraphy": {"layers": layers}}, cfg.root)
    stages.run_stage(spark, own, "hydrostratigraphy")
    got = own.read(spark, "hydrostratigraphy/totals").toPandas().set_index("pixel_id")
    s, c = sum(sand).ravel(), sum(clay).ravel()
    inside = np.flatnonzero(np.isfinite(s))
    assert set(got.index) == set(inside.tolist()) and len(inside) == SIZE * SIZE - 2
    assert np.allclose(got.loc[inside, "clay_fraction"], c[inside] / (s + c)[inside], rtol=1e-5)


def test_command_line(spark, project, capsys):
    assert main(["list-stages"]) == 0 and "storage-budget" in capsys.readouterr().out
    assert main(["stage", str(project), "annual-storage-maps"]) == 0
    assert "annual-storage-maps.largest_difference_m3" in capsys.readouterr().out
    assert main(["run", str(project), "--from", "estimate-ske", "--to", "estimate-lag"]) == 1
    assert "ValueError" in capsys.readouterr().err
    assert main(["plot", str(project), "--stage", "estimate-lag"]) == 0 and "estimate-lag scan: " in capsys.readouterr().out
    with pytest.raises(KeyError):
        stages.run_stage(spark, load_config(project), "nothing")


def test_evolution_settings(project):
    """The settings of evolution by name: what they set, what they fall back on, and errors for unknown ones."""
    cfg = load_config(project)
    o = stages.evolution_settings(cfg)
    assert o["wells"] == 8 and o["sigmas"] == [25.0] and o["support"] == "prediction" and o["months"] == [1, 8] and o["stride"] == 8
    text = """
evolution:
  start_year: 2019
  end_year: 2022
  same_season_months: [2, 7]
  max_pair_day_diff: 10
  min_pairs_per_interval: 2
  min_valid_intervals: 3
  early_intervals: [[2019, 2020]]
  recovery_intervals: [[2020, 2021]]
  recent_decline_min_intervals: 1
  stable_head_change_m_yr: 0.25
  groundwater_interpolation: {max_centers: 8, sigma_km_candidates: [12], min_wells_per_interval: 5, max_nearest_well_km: 40}
  support_mask: inside_hull
  block_size: 64
  sensitivity: {sample_stride: 2, stable_rate_mm_yr: [4]}
"""
    given = yaml.safe_load(text)
    cfg.data["evolution"] = given["evolution"]
    o = stages.evolution_settings(cfg)
    assert (o["start_year"], o["end_year"], o["day_diff"], o["pairs"], o["centres"], o["wells"], o["nearest"], o["support"], o["stride"]) == (2019, 2022, 10, 2, 8, 5, 40, "inside_hull", 2)
    assert o["sets"]["early"] == [2019] and o["sets"]["late"] is None and o["least"]["valid"] == 3 and o["sensitivity"]["stable"] == [4.0] and o["stable_head"] == 0.25
    cfg.data["evolution"] = {"min_valid_interval": 3}
    with pytest.raises(ValueError, match="min_valid_interval"):
        stages.evolution_settings(cfg)
    cfg.data["evolution"] = {"stable_head_change_m_yr": 2}
    with pytest.raises(ValueError, match="head change"):
        stages.evolution_settings(cfg)
