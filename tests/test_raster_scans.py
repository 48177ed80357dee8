"""Scans that read only what conditions need, offsets beyond 4 GB, and stored models."""

from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, Not

from terrachron.operators import models
from terrachron.sources import rasters

GRID = rasters.Grid(1300, 20, (1.0, 0.0, 0.0, 0.0, -1.0, 1300.0), "EPSG:32650", None)
VALUES = np.arange(1300 * 20, dtype="f4").reshape(1300, 20)


@pytest.fixture
def folder(tmp_path):
    for name in ("a.tif", "b.TIFF"):
        (tmp_path / name).write_bytes(rasters.encode_tiff(VALUES, GRID))
    (tmp_path / "notes.txt").write_text("no raster")
    return tmp_path


def test_conditions_choose_files_and_strips(folder, monkeypatch):
    reads, plain = [], rasters.opened

    @contextmanager
    def counted(path):
        with plain(path) as file:
            inner = file.read
            file.read = lambda offset, size: reads.append((path, size)) or inner(offset, size)
            yield file

    monkeypatch.setattr(rasters, "opened", counted)
    whole = rasters.TiffReader(str(folder))
    assert len(whole.partitions()) == 6 and sum(len(b) for p in whole.partitions() for b in whole.read(p)) == 2 * 26000
    assert len(reads) == 2 * 21  # each strip of 64 rows once
    reads.clear()
    some = rasters.PushedTiffReader(str(folder))
    asked = [IsNotNull(("pixel_id",)), GreaterThanOrEqual(("pixel_id",), 2600), LessThan(("pixel_id",), 3000), In(("path",), (f"{folder}/a.tif", "other")), Not(EqualTo(("path",), "x"))]
    assert list(some.pushFilters(asked)) == asked
    ids = np.concatenate([b.column(1).to_numpy() for p in some.partitions() for b in some.read(p)])
    assert ids.min() == 2600 and ids.max() < 3020 and len(reads) <= 2 and all(p.endswith("a.tif") for p, _ in reads)
    none = rasters.PushedTiffReader(str(folder))
    none.pushFilters([EqualTo(("pixel_id",), 10**9)])
    assert [p.value for p in none.partitions()] == [None] and list(none.read(none.partitions()[0])) == []


def test_pushed_conditions_keep_the_rows(spark, folder):
    spark.dataSource.register(rasters.GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("terra_tiff").option("pushdown", "true").load(str(folder))
        rows = df.where(F.col("pixel_id").between(10_239, 10_245) & F.col("path").endswith("a.tif")).collect()
        assert sorted((r["pixel_id"], r["value"]) for r in rows) == [(i, float(i)) for i in range(10_239, 10_246)]
        assert df.where(F.col("pixel_id").isin(5, 25_999) & F.col("value").isNotNull()).count() == 4
        assert df.where("pixel_id < 0").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_offsets_of_64_bits():
    values, own = rasters.decode_tiff(rasters.encode_tiff(VALUES, GRID, big=True))
    assert (values == VALUES).all() and own.affine == GRID.affine and own.crs == GRID.crs
    sizes = [3 << 30, 5, 3 << 30]  # beyond 4 GB: chosen by itself
    grid = rasters.Grid(192, 20, GRID.affine, GRID.crs, -1.0)
    head, tail = rasters.frame(sizes, grid, "f4", 64)
    after = len(head) + sum(sizes)
    file = rasters.Tiff(lambda offset, size: head[offset : offset + size] if offset < len(head) else tail[offset - after : offset - after + size])
    assert file.tags[273] == tuple(len(head) + sum(sizes[:i]) for i in range(3)) and file.tags[279] == tuple(sizes) and file.grid.nodata == -1.0
    assert rasters.frame([10], grid, "f4", 192)[0][:4] == b"II*\0"


def test_centres_are_chosen_alike_on_the_cluster(spark):
    rng = np.random.default_rng(3)
    xy = np.round(rng.uniform(0, 10, (40, 2)))  # ties and repeated places
    df = spark.createDataFrame([(i, float(x), float(y), 1) for i, (x, y) in enumerate(xy)] + [(99, None, 1.0, 1)], "id int, x double, y double, v int")
    got = [(r["x"], r["y"]) for r in models.spread_sites(df, 9).orderBy("place").collect()]
    assert got == [tuple(map(float, c)) for c in models.spread_centres(xy, 9)]
    assert models.spread_sites(df.limit(0), 3).count() == 0 and models.spread_sites(df.limit(2), 9).count() == 2


def test_models_come_back_as_they_were_stored(spark, tmp_path):
    rng = np.random.default_rng(5)
    field = models.field_fit(rng.uniform(0, 9, (8, 2)), rng.normal(size=(8, 20)), np.arange(20.0), 2, 3.0, 0.1, centres=4)
    field.table(spark.range(0)).write.parquet(str(tmp_path / "field"))
    again = models.FieldModel.of(spark.read.parquet(str(tmp_path / "field")))
    assert np.array_equal(again.at(np.ones((1, 2)), np.array([3.5])), field.at(np.ones((1, 2)), np.array([3.5])))
    rows = spark.createDataFrame([(i, float(i % 2 * 50 + i % 5), float(i % 3)) for i in range(60)] + [(60, None, 1.0)], "id int, a double, b double")
    model, table = models.regime_model(rows, ["a", "b"], ks=(2, 3), starts=2, final_starts=2)
    model.table(spark).write.parquet(str(tmp_path / "clusters"))
    loaded = models.ClusterModel.of(spark.read.parquet(str(tmp_path / "clusters"))).assign(rows)
    assert table.count() == 2 and loaded.count() == 60  # a row without a feature has no cluster
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, models.regimes(rows, ["a", "b"], ks=(2, 3), starts=2, final_starts=2)[0].collect()))
    with pytest.raises(ValueError):
        models.ClusterModel.of(spark.read.parquet(str(tmp_path / "clusters")).limit(0))
