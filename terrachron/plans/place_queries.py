"""More of the driver contract's queries: wells' quality rules, places, samples, models with given numbers, sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.functions import basis, classes, geo
from terrachron.functions.basis import YEAR, TimeModel
from terrachron.operators import diagnostics, lsq, models, profile, ratio, spatial, wells
from terrachron.plans.queries import EVENT_DAYS, GRID, HULL, IN_HULL, MARKERS, METRICS, QUADRATIC, event_days, grid, heads, markers, metrics, query, r, rsql, series, table
from terrachron.plans.sql import DAY, HEADS, SERIES, model_sql, rounded
from terrachron.sources import rasters, sheets, tables

STATIONS = f"SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_quantity - 10 AS depth, CAST(10 + l_suppkey % 40 AS DOUBLE) AS elevation_m, CAST(l_linenumber * 8 AS DOUBLE) AS well_depth_m FROM lineitem"


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("depth"), (F.lit(10) + F.col("l_suppkey") % 40).cast("double").alias("elevation_m"), (F.col("l_linenumber") * 8).cast("double").alias("well_depth_m")
    )


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the one that all executors share; below a local one where none is set, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='terrachron-')).rstrip('/')}/queries-{uuid.uuid4().hex}"


# --- wells ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS station_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS head FROM orders", dates="date")
def long_rename(spark: SparkSession, sf: str) -> DataFrame:
    return wells.rename(table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")), {"station_id": "o_orderkey", "date": "d", "head": "o_totalprice"})


@query(f"SELECT station_id, l_orderkey, l_linenumber, {rounded('elevation_m - depth')} AS head_m FROM ({STATIONS})")
def depth_to_head(spark: SparkSession, sf: str) -> DataFrame:
    return r(wells.depth_to_head(stations(spark, sf), "depth").select("station_id", "l_orderkey", "l_linenumber", "head_m"))


@query(f"SELECT station_id, count(depth) FILTER (abs(depth) > 1e-12) AS kept, count(*) FILTER (abs(depth) <= 1e-12) AS zeros FROM ({STATIONS}) GROUP BY station_id")
def sentinel_zeros(spark: SparkSession, sf: str) -> DataFrame:
    kept = wells.sentinel_zero(F.col("depth"))
    return stations(spark, sf).groupBy("station_id").agg(F.count(kept).alias("kept"), F.count_if(F.col("depth").isNotNull() & kept.isNull()).alias("zeros"))


@query(f"SELECT station_id, count(*) FILTER (depth >= -0.5 AND depth <= well_depth_m) AS inside, {rounded('avg(depth) FILTER (depth >= -0.5 AND depth <= well_depth_m)')} AS mean_depth FROM ({STATIONS}) GROUP BY station_id")
def physical_ranges(spark: SparkSession, sf: str) -> DataFrame:
    d = wells.physical_range(F.col("depth"), -0.5, F.col("well_depth_m"))
    return r(stations(spark, sf).groupBy("station_id").agg(F.count(d).alias("inside"), F.avg(d).alias("mean_depth")))


@query(f"SELECT series_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM ({SERIES}) WHERE day BETWEEN 9400 AND 10500 GROUP BY series_id")
def analysis_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = wells.within(series(spark, sf).select("series_id", F.col("day").cast("long").alias("day")), 9400, 10500)
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def aquifer_class_filter(spark: SparkSession, sf: str) -> DataFrame:
    return wells.of_class(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "Building", "c_mktsegment")


PLACES = "SELECT c_nationkey AS station_id, 110 + c_custkey % 7 * 1e-6 * c_nationkey AS lon, 37 + c_custkey % 5 * 1e-6 AS lat FROM customer"


@query(f"SELECT station_id, {rounded('max(lon) - min(lon)', 9)} AS lon_spread, {rounded('max(lat) - min(lat)', 9)} AS lat_spread FROM ({PLACES}) GROUP BY station_id HAVING max(lon) - min(lon) > 3.05e-5 OR max(lat) - min(lat) > 3.05e-5")
def coordinate_consistency(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("station_id"), (110 + F.col("c_custkey") % 7 * F.lit(0.000001) * F.col("c_nationkey")).alias("lon"), (37 + F.col("c_custkey") % 5 * F.lit(0.000001)).alias("lat"))
    return r(wells.inconsistent_coordinates(c, 3.05e-5), 9)


@query("SELECT o_custkey AS station_id, arg_min(o_clerk, {'d': o_orderdate, 'v': o_clerk}) AS o_clerk, arg_min(o_orderpriority, {'d': o_orderdate, 'v': o_orderpriority}) AS o_orderpriority FROM orders GROUP BY o_custkey".replace("o_clerk", "o_orderstatus"))
def first_value_metadata(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "station_id"})
    return wells.first_metadata(o, ["station_id"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")


@query(f"SELECT h.series_id, s_name AS name, s_nationkey AS nation, h.n FROM (SELECT series_id, count(*) AS n FROM ({HEADS}) GROUP BY series_id) h JOIN supplier ON s_suppkey = h.series_id")
def metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("series_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return heads(spark, sf).groupBy("series_id").agg(F.count("*").alias("n")).join(meta, "series_id").select("series_id", "name", "nation", "n")


@query("SELECT station_id, date, value, row_number() OVER (ORDER BY station_id, date, value) AS place FROM (SELECT o_custkey AS station_id, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value FROM orders GROUP BY ALL)", dates="date")
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order as it is at the sink: rows are numbered as they come."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("station_id"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value"))
    path = f"{scratch(spark)}/ordered"  # once: sorted again, the rows would be parted at other places
    tables.write_table(wells.in_order(rows).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), path)
    ordered = spark.read.parquet(path)
    sizes = ordered.groupBy("part").agg(F.count("*").alias("m"), F.min("at").alias("low"))
    offsets = sizes.select("part", "low", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # a row a partition
    return ordered.join(F.broadcast(offsets), "part").select("station_id", "date", "value", (F.col("at") - F.col("low") + F.col("before") + 1).alias("place"))


# --- places --------------------------------------------------------------------------------------------------------

RING = [(1.0, -0.5), (8.5, 0.25), (9.25, 60.0), (4.0, 21.5), (0.5, 88.0)]


def crossings_sql(ring: list[tuple[float, float]]) -> str:
    parts = [f"CAST(({y0!r} > y) <> ({y1!r} > y) AND x < ({x1!r} - {x0!r}) * (y - {y0!r}) / ({y1!r} - {y0!r}) + {x0!r} AS INTEGER)" for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True) if y0 != y1]
    return f"({' + '.join(parts)}) % 2 = 1"


@query(f"SELECT pixel_id, x BETWEEN 0.5 AND 9.25 AND y BETWEEN -0.5 AND 88.0 AND {crossings_sql(RING)} AS in_domain FROM ({GRID})")
def polygon_clip(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.clip(grid(spark, sf), [RING]).select("pixel_id", "in_domain")


SUPPORT = f"SELECT pixel_id, true AS prediction, inside_hull, inside_hull AND d <= 3 AS high_confidence FROM (SELECT pixel_id, {IN_HULL} AS inside_hull, least(sqrt((x - 2.5) * (x - 2.5) + (y - 3.5) * (y - 3.5)), sqrt((x - 7.25) * (x - 7.25) + (y - 1) * (y - 1)), sqrt((x - 4) * (x - 4) + (y - 8.75) * (y - 8.75))) AS d FROM ({GRID}))"


@query(" UNION ALL ".join(f"SELECT '{k}' AS support, count(*) AS pixels, coalesce(sum(pixel_id), 0)::BIGINT AS ids FROM ({SUPPORT}){'' if k == 'none' else f' WHERE {k}'}" for k in ("high_confidence", "inside_hull", "prediction", "none")))
def support_selection(spark: SparkSession, sf: str) -> DataFrame:
    from terrachron.plans.queries import sites

    g = grid(spark, sf)
    marked = spatial.support(g.join(spatial.nearest_site(g, sites(spark)), "pixel_id"), HULL, F.col("distance"), 3.0)
    out = None
    for kind in ("high_confidence", "inside_hull", "prediction", "none"):
        one = spatial.select_support(marked, kind).agg(F.lit(kind).alias("support"), F.count("*").alias("pixels"), F.coalesce(F.sum("pixel_id"), F.lit(0)).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


AFFINE = (0.02, 0.0, -1.0, 0.0, -0.02, 1.0)
POINTS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings"
ROWCOL = f"SELECT *, CAST(floor((0.02 * (y - 1.0)) / -0.0004) AS INTEGER) AS \"row\", CAST(floor((-0.02 * (x + 1.0)) / -0.0004) AS INTEGER) AS col FROM ({POINTS})"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "value"))))


@query(f"SELECT id, \"row\", col, CAST(\"row\" AS BIGINT) * 100 + col AS pixel_id FROM ({ROWCOL}) WHERE \"row\" BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99")
def points_to_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.points_to_pixels(points(spark, sf), AFFINE, 100, 100).select("id", "row", "col", "pixel_id")


@query(f"SELECT pixel_id, {rounded('d')} AS distance FROM (SELECT pixel_id, sqrt((x - 4.3) * (x - 4.3) + (y - 5.6) * (y - 5.6)) AS d FROM ({GRID})) QUALIFY d <= 2.75 OR row_number() OVER (ORDER BY d, pixel_id) = 1")
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return r(spatial.neighbourhood(grid(spark, sf), 4.3, 5.6, 2.75).select("pixel_id", "distance"))


@query(f"SELECT pixel_id, {rounded('d')} AS distance FROM (SELECT pixel_id, sqrt((x + 9) * (x + 9) + (y + 3) * (y + 3)) AS d FROM ({GRID})) ORDER BY d, pixel_id LIMIT 1")
def neighbourhood_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A site that no pixel is near: the nearest one."""
    return r(spatial.neighbourhood(grid(spark, sf), -9.0, -3.0, 2.75).select("pixel_id", "distance"))


@query(f"SELECT * FROM (SELECT CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, {rounded('median(value)')} AS a FROM ({POINTS}) WHERE id % 2 = 0 GROUP BY ALL) JOIN (SELECT CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, {rounded('median(value)')} AS b FROM ({POINTS}) WHERE id % 2 = 1 GROUP BY ALL) USING (cx, cy)")
def cell_join_of_maps(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return r(spatial.cell_join(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.1))


@query(f"SELECT CAST(floor(x / 0.25) AS BIGINT) AS cx, CAST(floor(y / 0.25) AS BIGINT) AS cy, {rounded('avg(value)')} AS value, count(value) AS n FROM ({POINTS}) GROUP BY ALL")
def block_averages(spark: SparkSession, sf: str) -> DataFrame:
    return r(spatial.cell_mean(points(spark, sf), 0.25))


CENTRE = f"SELECT pixel_id, 0.02 * (x + 0.5) + 110.0 AS lon, -0.02 * (y + 0.5) + 38.5 AS lat FROM ({GRID})"
N2, N3, N4, N6 = geo.N**2, geo.N**3, geo.N**4, geo.N**6
UTM = {
    "a1": geo.A / (1 + geo.N) * (1 + N2 / 4 + N4 / 64),
    "c": 2 * geo.N**0.5 / (1 + geo.N),
    "k": (geo.N / 2 - 2 * N2 / 3 + 5 * N3 / 16, 13 * N2 / 48 - 3 * N3 / 5, 61 * N3 / 240),
}


def double(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def wave_sql(f: str, g: str) -> str:
    return " + ".join(f"{double(a)} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(UTM["k"], 1))


@query(
    f"SELECT pixel_id, {rounded('lon', 9)} AS lon, {rounded('lat', 9)} AS lat, {rounded(f'500000 + {double(0.9996 * UTM["a1"])} * (eta + {wave_sql("cos", "sinh")})', 3)} AS easting, {rounded(f'{double(0.9996 * UTM["a1"])} * (xi + {wave_sql("sin", "cosh")})', 3)} AS northing FROM ("
    f"SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {double(UTM['c'])} * atanh({double(UTM['c'])} * sin(radians(lat)))) AS t, radians(lon - 111) AS dl FROM ({CENTRE})))"
)
def pixel_centres_utm(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = geo.centre(F.col("y"), F.col("x"), (0.02, 0.0, 110.0, 0.0, -0.02, 38.5))
    rows = grid(spark, sf).select("pixel_id", lon.alias("lon"), lat.alias("lat"))
    east, north = geo.utm(F.col("lon"), F.col("lat"), geo.utm_zone(110.0))
    out = rows.select("pixel_id", "lon", "lat", east.alias("easting"), north.alias("northing"))
    return out.select("pixel_id", *(F.round(c, 9).alias(c) for c in ("lon", "lat")), *(F.round(c, 3).alias(c) for c in ("easting", "northing")))


LONLAT = "SELECT c_custkey, c_custkey * 37 % 360 - 180 + 0.5e0 AS lon, c_custkey * 11 % 160 - 80 + 0.25e0 AS lat FROM customer"


@query(f"SELECT lon, lat, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS BIGINT) AS epsg FROM (SELECT DISTINCT lon, lat FROM ({LONLAT}))")
def automatic_utm_zone(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select((k * 37 % 360 - 180 + 0.5).cast("double").alias("lon"), (k * 11 % 160 - 80 + 0.25).cast("double").alias("lat")).distinct()
    return rows.select("lon", "lat", geo.utm_epsg_of(F.col("lon"), F.col("lat")).alias("epsg"))


# --- samples and orders --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY md5('20260919:' || o_orderkey), o_orderkey LIMIT 100")
def digest_sample(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.hash_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


BLOCKED = f"SELECT series_id AS pixel_id, series_id % 7 AS block_id, count(value) AS n FROM ({SERIES}) GROUP BY ALL HAVING count(value) >= 100"


@query(
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY pixel_id) - 1 AS place, count(*) OVER (PARTITION BY block_id) AS m FROM ({BLOCKED})), "
    "e AS (SELECT block_id, CAST(floor(i * (m - 1) / 19.0) AS BIGINT) AS place FROM (SELECT DISTINCT block_id, m FROM p), range(0, 20) t(i) WHERE m > 20 GROUP BY ALL), "
    "c AS (SELECT p.* FROM p LEFT JOIN e USING (block_id, place) WHERE p.m <= 20 OR e.block_id IS NOT NULL) "
    "SELECT pixel_id, block_id FROM c ORDER BY md5('20260919:' || block_id), block_id, place LIMIT 90"
)
def block_series_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf).select(F.col("series_id").alias("pixel_id"), (F.col("series_id") % 7).alias("block_id"), "value")
    return spatial.block_sample(rows, 200, 90, each=20)


CANDIDATES = "SELECT CAST(s_nationkey AS INTEGER) AS rank, CAST(s_suppkey % 4 AS DOUBLE) AS sigma, CAST(s_suppkey AS DOUBLE) AS ridge, floor(abs(s_acctbal) / 500) AS cv_rmse, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 5 * 1e0 END AS cv_harmonic_vector_rmse FROM supplier"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("int").alias("rank"), (k % 4).cast("double").alias("sigma"), k.cast("double").alias("ridge"), F.floor(F.abs("s_acctbal") / 500).cast("double").alias("cv_rmse"), F.when(k % 3 > 0, (k % 5).cast("double")).alias("cv_harmonic_vector_rmse"))


@query(f"SELECT rank, sigma, ridge, cv_rmse, cv_harmonic_vector_rmse, place = 1 AS selected, place FROM (SELECT *, row_number() OVER (ORDER BY cv_rmse, cv_harmonic_vector_rmse NULLS LAST, rank, sigma, ridge) AS place FROM ({CANDIDATES}))")
def field_model_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report's order: the selected candidate first, then by the rules of choice."""
    report = models.field_report(candidates(spark, sf))
    return report.withColumn("place", F.row_number().over(Window.orderBy(F.desc("selected"), "cv_rmse", F.asc_nulls_last("cv_harmonic_vector_rmse"), "rank", "sigma", "ridge")).cast("long"))


@query("SELECT spacing, lam, cv_rmse FROM (SELECT CAST(s_nationkey AS DOUBLE) AS spacing, CAST(s_suppkey AS DOUBLE) AS lam, floor(abs(s_acctbal) / 500) AS cv_rmse FROM supplier) ORDER BY cv_rmse, spacing, lam LIMIT 1")
def best_regularised_model(spark: SparkSession, sf: str) -> DataFrame:
    cv = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("double").alias("spacing"), F.col("s_suppkey").cast("double").alias("lam"), F.floor(F.abs("s_acctbal") / 500).cast("double").alias("cv_rmse"))
    return models.best_regularised(cv)


CENTRES_SQL = (
    "WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS y FROM supplier), "
    "first AS (SELECT x, y FROM p ORDER BY x + y, id LIMIT 1), "
    "s AS (SELECT 1 AS k, f.x AS cx, f.y AS cy, list({'id': p.id, 'x': p.x, 'y': p.y, 'd': (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)} ORDER BY p.id) AS far FROM p, first f GROUP BY ALL "
    "UNION ALL SELECT k + 1, b.x, b.y, list_transform(far, lambda e: {'id': e.id, 'x': e.x, 'y': e.y, 'd': least(e.d, (e.x - b.x) * (e.x - b.x) + (e.y - b.y) * (e.y - b.y))}) "
    "FROM (SELECT *, list_sort(list_transform(far, lambda e: {'d': -e.d, 'id': e.id, 'x': e.x, 'y': e.y}))[1] AS b FROM s WHERE k < least(12, len(far)))) "
)


@query(CENTRES_SQL + "SELECT CAST(k AS BIGINT) AS place, cx AS x, cy AS y FROM s")
def spread_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve centres of the suppliers, each choice an aggregation."""
    wells_at = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 7919 % 10007).cast("double").alias("y"))
    return models.spread_sites(wells_at, 12)


# --- classes, profiles, maps ---------------------------------------------------------------------------------------


@query(
    f"SELECT series_id, {', '.join(f'{rounded(e, 5)} AS {n}' for n, e in (('start_rate', 'beta1'), ('end_rate', 'beta1 + 2 * beta2 * 6'), ('rate_change', '2 * beta2 * 6'), ('acceleration', '2 * beta2')))}, "
    f"{rounded('CASE WHEN abs(beta2) > 0.5 THEN -beta1 / (2 * beta2) END', 3)} AS vertex_years, {rounded('coalesce(least(greatest(CASE WHEN abs(beta2) > 1e-12 THEN -beta1 / (2 * beta2) END, -6.0), 12.0), CASE WHEN beta1 < 0 THEN 12.0 ELSE -6.0 END)', 3)} AS vertex_feature, "
    f"CASE WHEN beta1 < -5 AND beta1 + 12 * beta2 > 5 THEN 'subsidence_to_rebound' WHEN beta1 > 5 AND beta1 + 12 * beta2 > 5 THEN 'persistent_uplift' WHEN abs(beta1 + 12 * beta2) <= 5 THEN 'stable' WHEN beta1 + 12 * beta2 < -5 AND 12 * beta2 > 5 THEN 'reduced_subsidence' ELSE 'continuous_subsidence' END AS regime "
    f"FROM ({model_sql(SERIES, ['series_id'], QUADRATIC, 24)}) WHERE beta1 IS NOT NULL"
)
def derivative_features(spark: SparkSession, sf: str) -> DataFrame:
    fits = lsq.fit(series(spark, sf), ["series_id"], QUADRATIC, min_obs=24).where("beta1 IS NOT NULL")
    out = fits.select("series_id", *(c.alias(n) for n, c in classes.derivatives(F.col("beta1"), F.col("beta2"), 6.0, 0.5).items()))
    digits = {"vertex_years": 3, "vertex_feature": 3}
    rounded_ = [(F.round(c, digits.get(c, 5)) + F.lit(0.0)).alias(c) for c in out.columns[1:]]
    return out.withColumn("regime", classes.regime_label(F.col("start_rate"), F.col("end_rate"))).select("series_id", *rounded_, "regime")


@query(f"SELECT series_id, {rounded('beta0 + beta1 * 2.5 + beta2 * 2.5 * 2.5', 5)} AS value FROM ({model_sql(SERIES, ['series_id'], QUADRATIC, 24)})")
def polynomial_values(spark: SparkSession, sf: str) -> DataFrame:
    fits = lsq.fit(series(spark, sf), ["series_id"], QUADRATIC, min_obs=24)
    return r(fits.select("series_id", basis.polynomial(F.lit(2.5), *(F.col(f"beta{i}") for i in range(3))).alias("value")), 5)


@query(f"SELECT ps_key AS pixel_id, {rounded('sand')} AS sand, {rounded('clay')} AS clay, {rounded('CASE WHEN sand + clay > 0 THEN clay / (sand + clay) END')} AS clay_fraction FROM (SELECT l_partkey AS ps_key, sum(l_quantity) AS sand, sum(l_discount) AS clay, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_partkey HAVING count(*) = 12)")
def strata_and_clay_fraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_partkey").alias("pixel_id"), F.col("l_quantity").alias("sand"), F.col("l_discount").alias("clay"))
    return r(profile.strata_totals(rows, 12))


@query("SELECT c_custkey, CASE WHEN a = 0 AND b >= 3 THEN 'persistent_signal' WHEN a >= 2 THEN 'unresolved_quality_sensitive' ELSE 'mixed_evidence' END AS verdict FROM (SELECT c_custkey, c_custkey % 4 AS a, c_nationkey % 6 AS b FROM customer)")
def evidence_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", classes.verdict(F.col("c_nationkey") % 6, F.col("c_custkey") % 4).alias("verdict"))


WIDE_MARKERS = "SELECT date, l_linenumber, median(l_extendedprice / 1000) AS u FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_linenumber, l_extendedprice FROM lineitem) GROUP BY ALL"


@query(f"SELECT date, 'F' || l_linenumber AS marker_id, CAST(l_linenumber * 50 AS DOUBLE) AS depth_m, {rounded('-u')} AS marker_displacement_mm FROM ({WIDE_MARKERS}) WHERE l_linenumber <= 3", dates="date")
def signed_marker_table(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table of markers with a row of depths, positive down."""
    m = markers(spark, sf).where("depth_m <= 150").groupBy("date").pivot("marker_id", ["F1", "F2", "F3"]).agg(F.first("marker_displacement_mm"))
    wide = m.select(F.col("date").cast("string").alias("when"), *(F.col(c).cast("string").alias(c) for c in ("F1", "F2", "F3")))
    depths = spark.createDataFrame([("depth", "50", "100", "150")], "when string, F1 string, F2 string, F3 string")
    return r(profile.markers(wide.unionByName(depths), date_column="when", depth_label="depth", marker_columns=["F1", "F2", "F3"], positive="Subsidence ").where("marker_displacement_mm IS NOT NULL"))


@query(f"SELECT date, {rounded('sum(c)')} AS profile_compaction_mm FROM (SELECT date, CASE WHEN depth_m <> 100 THEN u END AS c FROM ({MARKERS})) GROUP BY date", dates="date")
def profile_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = markers(spark, sf).select("date", F.when(F.col("depth_m") != 100, F.col("marker_displacement_mm")).alias("compaction_mm"))
    return r(profile.profile_sum(rows))


@query(f"SELECT date, coalesce(lag(depth_m) OVER w, 0) AS depth_top_m, depth_m AS depth_bottom_m, {rounded('u - coalesce(lag(u) OVER w, 0)')} AS compaction_mm FROM ({MARKERS}) WINDOW w AS (PARTITION BY date ORDER BY depth_m)", dates="date")
def cumulative_markers(spark: SparkSession, sf: str) -> DataFrame:
    rows = markers(spark, sf).select("date", F.col("depth_m").alias("depth_bottom_m"), F.col("marker_displacement_mm").alias("compaction_mm"))
    return r(profile.cumulative_to_intervals(rows))


@query(f"SELECT day, {rounded('median(value)')} AS value FROM ({EVENT_DAYS.format(key='user_id')}) GROUP BY day")
def spatial_median_series(spark: SparkSession, sf: str) -> DataFrame:
    return r(profile.spatial_median(event_days(spark, sf, "user_id")))


@query(METRICS + f"SELECT CAST(series_id % 4 AS INTEGER) AS cluster_id, count(*) AS pixel_count, {rounded('median(early_rate)')} AS median_early_rate, {rounded('median(late_rate)')} AS median_late_rate, {rounded('median(recent_head)')} AS median_recent_head FROM m GROUP BY ALL")
def cluster_medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics(spark, sf).withColumn("cluster_id", (F.col("series_id") % 4).cast("int"))
    return r(models.cluster_summary(rows, ["early_rate", "late_rate", "recent_head"]))


YEAR_MAP = f"SELECT series_id, median(value) AS value FROM ({SERIES}) WHERE year(date) = {{}} GROUP BY series_id"


@query(f"SELECT count(*) AS n, {', '.join(f'{rounded(f"quantile_cont(d, {q})", 5)} AS {n}' for n, q in diagnostics.QUANTILES)}, {rounded('avg(d)', 5)} AS mean FROM (SELECT b.value - a.value AS d FROM ({YEAR_MAP.format(1996)}) a JOIN ({YEAR_MAP.format(1998)}) b USING (series_id))")
def map_difference_summary(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (series(spark, sf).where(F.year("date") == y).groupBy("series_id").agg(F.median("value").alias("value")) for y in (1996, 1998))
    return r(diagnostics.quantile_summary(diagnostics.map_difference(a, b, ["series_id"]), [], "difference"), 5)


RATES = f"SELECT a.series_id, a.y AS year1, b.v - a.v AS rate FROM (SELECT series_id, year(date) AS y, median(value) AS v FROM ({HEADS}) GROUP BY ALL) a JOIN (SELECT series_id, year(date) AS y, median(value) AS v FROM ({HEADS}) GROUP BY ALL) b ON a.series_id = b.series_id AND b.y = a.y + 1"


@query(f"SELECT year1, count(rate) AS n, {', '.join(f'{rounded(f"quantile_cont(rate, {q})", 5)} AS {n}' for n, q in (('p10', 0.1), ('median', 0.5), ('p90', 0.9)))} FROM ({RATES}) WHERE series_id % 2 = 0 AND series_id // 10 % 2 = 0 GROUP BY year1")
def strided_head_change(spark: SparkSession, sf: str) -> DataFrame:
    """Same-season changes on a stride sample, which is the feature: medians and outer tenths of each year."""
    from terrachron.plans.queries import yearly_rates

    rows = spatial.stride(spatial.pixel_grid(yearly_rates(heads(spark, sf)), 10, pixel="series_id"), 2)
    return r(diagnostics.quantile_summary(rows, ["year1"], "rate").select("year1", "n", "p10", "median", "p90"), 5).withColumn("year1", F.col("year1").cast("long"))


LABELS = {"deformation": classes.DEFORMATION, "groundwater": classes.GROUNDWATER, "coupled": classes.COUPLED}


@query(
    f"WITH c AS ({METRICS}SELECT deformation_class AS d, groundwater_state AS g, series_id + 1 AS area FROM k), u AS (SELECT 'deformation' AS family, d AS class_id, count(*) AS pixels, sum(area) AS area FROM c GROUP BY d UNION ALL SELECT 'groundwater', g, count(*), sum(area) FROM c GROUP BY g), "
    f"l(family, class_id, class_label) AS (VALUES {', '.join(f'({f!r}, {k}, {v!r})' for f in ('deformation', 'groundwater') for k, v in LABELS[f].items())}) "
    "SELECT family, class_id, class_label, coalesce(pixels, 0) AS pixels, CAST(coalesce(area, 0) AS DOUBLE) AS area FROM l LEFT JOIN u USING (family, class_id) UNION ALL SELECT 'all', 255, 'outside_support_or_nodata', 0, 0.0"
)
def summary_families(spark: SparkSession, sf: str) -> DataFrame:
    from terrachron.operators import trajectories
    from terrachron.plans.queries import classified

    t = classified(spark, sf)
    return trajectories.summary_families(t, {"deformation": ("deformation_class", classes.DEFORMATION), "groundwater": ("groundwater_state", classes.GROUNDWATER)})


# --- fits and models with given numbers ----------------------------------------------------------------------------

EPOCHS = [9131 + 30 * i for i in range(85)]
MONTHLY = f"SELECT series_id, CAST(9131 + 30 * floor((day - 9131) / 30) AS BIGINT) AS day, median(value) AS value FROM ({SERIES}) WHERE day >= 9131 AND day < {EPOCHS[-1] + 30} GROUP BY ALL"


def packed(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf).where(F.col("day").between(9131, EPOCHS[-1] + 29)).groupBy("series_id", F.floor((F.col("day") - 9131) / 30).cast("int").alias("i")).agg(F.median("value").alias("value"))
    maps = rows.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    return maps.select("series_id", F.transform(F.sequence(F.lit(0), F.lit(len(EPOCHS) - 1)), lambda i: F.col("m")[i]).alias("series"))


@query(f"SELECT series_id, n, {', '.join(f'{rounded(f"beta{i}", 4)} AS beta{i}' for i in range(5))}, {rounded('rmse', 4)} AS rmse FROM ({model_sql(MONTHLY, ['series_id'], QUADRATIC, 24)})")
def mask_grouped_fit(spark: SparkSession, sf: str) -> DataFrame:
    out = lsq.packed_fit(packed(spark, sf), "series_id", "series", EPOCHS, QUADRATIC, min_obs=24)
    return r(out.select("series_id", "n", *(F.col("beta")[i].alias(f"beta{i}") for i in range(5)), F.when(F.col("beta").isNotNull(), F.col("rmse")).alias("rmse")), 4)


TERMS = list(TimeModel(9131, 1).columns("day").values())


@query(
    f"WITH f AS ({model_sql(f'SELECT * FROM ({MONTHLY}) WHERE day < 10957', ['series_id'], TimeModel(9131, 1), 24)}), e AS (SELECT series_id, m.value - ({' + '.join(f'beta{i} * ({t})' for i, t in enumerate(TERMS))}) AS e FROM ({MONTHLY}) m JOIN f USING (series_id) WHERE day >= 10957) "
    f"SELECT series_id, count(e) AS n_test, {rounded('sqrt(avg(e * e))', 4)} AS rmse FROM e GROUP BY series_id HAVING count(e) > 0"
)
def packed_series_holdout(spark: SparkSession, sf: str) -> DataFrame:
    out = lsq.packed_holdout(packed(spark, sf), "series_id", "series", EPOCHS, TimeModel(9131, 1), 10957, min_obs=24)
    return r(out.where("n_test > 0").select("series_id", "n_test", F.col("rmse").alias("rmse")), 4)


NODES = ((2.0, 3.0), (7.0, 1.0), (4.0, 8.0))
WEIGHTS = ((0.5, -0.25), (1.5, 0.75), (-2.0, 0.5), (0.25, 1.0))
COMPONENTS, FIELD_DAYS = ((1.0, 0.5, -0.5), (0.25, 1.0, 2.0)), (0.0, 10.0, 30.0)
BUMPS = [f"exp(-0.5 * ((x - {cx!r}) * (x - {cx!r}) + (y - {cy!r}) * (y - {cy!r})) / 9.0)" for cx, cy in NODES]


@query(
    f"WITH s AS (SELECT pixel_id, {', '.join(f'{WEIGHTS[0][k]!r} + ' + ' + '.join(f'{WEIGHTS[i + 1][k]!r} * {b}' for i, b in enumerate(BUMPS)) + f' AS s{k}' for k in (0, 1))} FROM ({GRID})), "
    "c(day, c0, c1) AS (VALUES (0, 1.0, 0.25), (5, 0.75, 0.625), (20, 0.0, 1.5)) "
    f"SELECT pixel_id, CAST(day AS BIGINT) AS day, {rounded('s0 * c0 + s1 * c1')} AS head_anomaly_m FROM s, c"
)
def field_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """A field of given numbers, stored and read again, at all pixels: scores by place, components between days."""
    path = f"{scratch(spark)}/field_model"
    tables.write_table(models.FieldModel(np.array(NODES), 3.0, 0.0, 2, np.array(WEIGHTS), np.array(COMPONENTS), np.array(FIELD_DAYS)).table(spark.range(0)), path)
    model = models.FieldModel.of(spark.read.parquet(path))
    return r(models.predict_field(grid(spark, sf), model, [0, 5, 20]))


CLUSTERS = ((-1.0, 0.5), (0.25, -0.5), (1.5, 1.0))


@query(
    "WITH p AS (SELECT p_partkey, (p_size - 25.0) / 14.0 AS a, (p_retailprice - 1500.0) / 300.0 AS b FROM part), "
    f"d AS (SELECT p_partkey, {', '.join(f'(a - {u!r}) * (a - {u!r}) + (b - {v!r}) * (b - {v!r}) AS d{i}' for i, (u, v) in enumerate(CLUSTERS))} FROM p) "
    "SELECT p_partkey, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 1 WHEN d1 <= d2 THEN 2 ELSE 3 END AS cluster_id FROM d"
)
def cluster_model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A cluster model of given numbers, stored with its scaler and read again, gives all parts their clusters."""
    path = f"{scratch(spark)}/cluster_model"
    tables.write_table(models.ClusterModel(["p_size", "p_retailprice"], np.array([25.0, 1500.0]), np.array([14.0, 300.0]), np.array(CLUSTERS)).table(spark), path)
    return models.ClusterModel.of(spark.read.parquet(path)).assign(table(spark, sf, "part")).select("p_partkey", "cluster_id")


@query(
    f"WITH v AS (SELECT pixel_id, 0.5 + {' + '.join(f'{w!r} * {b}' for w, b in zip((1.5, -2.0, 0.25), BUMPS, strict=True))} AS h FROM ({GRID})) SELECT pixel_id, CAST(1999 AS BIGINT) AS year1, {rounded('h')} AS head_change, CASE WHEN h > 1 THEN 3 WHEN abs(h) <= 0.5 THEN 2 WHEN h < -1 THEN 1 ELSE 0 END AS state FROM v"
)
def change_and_state_map(spark: SparkSession, sf: str) -> DataFrame:
    """An interval's model, fitted without a ridge to four wells that lie on it, as maps of change and state."""
    xy = np.array([*NODES, (9.0, 9.0)])
    truth = models.rbf_basis(xy, np.array(NODES), 3.0) @ np.array([0.5, 1.5, -2.0, 0.25])
    maps = models.predict_change(grid(spark, sf), xy, truth, 3.0, 0.0, 1999, centre_points=np.array(NODES))
    return r(maps.withColumn("state", classes.groundwater_state(F.col("head_change"))))


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written with a byte-order mark in the first name, read back as texts."""
    path = f"{scratch(spark)}/suppliers.csv"
    tables.write_csv(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("﻿s_suppkey"), "s_name", "s_nationkey"), path)
    return tables.read_table(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def sheet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks of at most 1,000 customers each, packed in tasks and read back as one table of texts."""
    names = ["c_custkey", "c_name", "c_nationkey"]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [[int(a), str(b), int(c)] for a, b, c in frame[names].itertuples(index=False)]
        return pd.DataFrame({"path": [f"{frame['book'].iloc[0]}"], "content": [sheets.encode_workbook(names, rows)]})

    books = table(spark, sf, "customer").select(*names, F.floor(F.col("c_custkey") / 1000).alias("book")).groupBy("book").applyInPandas(pack, "path string, content binary")
    return sheets.read_workbooks(books)


@query("SELECT CAST(floor(sum(o_totalprice)) AS BIGINT) AS total, count(*) AS orders FROM orders")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A one-row summary through a JSON sink, its fields looked up again."""
    path = f"{scratch(spark)}/summary.json"
    row = table(spark, sf, "orders").agg(F.floor(F.sum("o_totalprice")).alias("total"), F.count("*").alias("orders")).first().asDict()
    tables.write_json(row, path, spark)
    return spark.createDataFrame([tuple(int(tables.read_scalar(spark, path, k)) for k in ("total", "orders"))], "total long, orders long")


@query(f"SELECT series_id AS pixel_id, day, {rounded('value')} AS value FROM (SELECT series_id, CAST(day AS BIGINT) AS day, median(value) AS value FROM ({SERIES}) GROUP BY ALL) WHERE day BETWEEN 9400 AND 9403")
def cube_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A cube by tiles and days, of which four days are read."""
    path = f"{scratch(spark)}/cube"
    rasters.write_cube(wells.daily_median(series(spark, sf).select(F.col("series_id").alias("pixel_id"), F.col("day").cast("long").alias("day"), "value"), ["pixel_id"]), path, 10, 4)
    return r(rasters.read_cube(spark, path, days=[9400, 9401, 9402, 9403]).select("pixel_id", "day", "value"))


def raster_folder(spark: SparkSession, sf: str) -> tuple[str, rasters.Grid]:
    """Two dated rasters of the suppliers' balances, in centimetres of subsidence, with gaps."""
    n = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("n")).first()["n"]
    g = rasters.Grid(n // 10 + 1, 10, (0.02, 0.0, 110.0, 0.0, -0.02, 38.5), nodata=-9999.0)
    path = scratch(spark)
    for day, factor in (("20200113", 1), ("20200125", 2)):
        rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pixel_id"), F.when(F.col("s_suppkey") % 7 > 0, F.floor("s_acctbal") * factor).cast("double").alias("value"))
        rasters.write_raster(rows, f"{path}/d_20200101_{day}.tif", g)
    return path, g


@query(f"SELECT s_suppkey AS pixel_id, CAST(d AS BIGINT) AS day, -10.0 * f * floor(s_acctbal) + 0.0 AS value FROM supplier, (VALUES ({DAY.format("'2020-01-13'")}, 1), ({DAY.format("'2020-01-25'")}, 2)) t(d, f) WHERE s_suppkey % 7 > 0")
def raster_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Dated rasters found by name, checked, read and turned to millimetres, positive up."""
    path, g = raster_folder(spark, sf)
    out = rasters.cube(spark, path, unit="cm", positive="subsidence", grid=g).where("value IS NOT NULL")
    return out.select("pixel_id", F.col("day").cast("long").alias("day"), (F.col("value") + F.lit(0.0)).alias("value"))


@query("SELECT CAST(max(s_suppkey) // 10 + 1 AS INTEGER) AS height, 10 AS width, CAST(110.0 AS DOUBLE) AS x0, CAST(38.5 AS DOUBLE) AS y0, 'EPSG:4326' AS crs, CAST(2 AS BIGINT) AS files, CAST(1 AS BIGINT) AS reference_dates FROM supplier")
def raster_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path, _ = raster_folder(spark, sf)
    files = rasters.discover(spark, path)
    rasters.check_epochs(files)
    g = rasters.grid_of(spark, files.first()["path"])
    return files.agg(F.lit(g.height).alias("height"), F.lit(g.width).alias("width"), F.lit(g.affine[2]).alias("x0"), F.lit(g.affine[5]).alias("y0"), F.lit(g.crs).alias("crs"), F.count("*").alias("files"), F.count_distinct("reference_date").alias("reference_dates"))


@query("SELECT s_suppkey AS pixel_id, floor(s_acctbal) AS value FROM supplier WHERE s_suppkey // 10 BETWEEN 2 AND 5 AND s_suppkey % 10 BETWEEN 3 AND 7 AND s_suppkey % 7 > 0")
def raster_window(spark: SparkSession, sf: str) -> DataFrame:
    """A window of rows and columns: only the strips that hold it are decoded."""
    path, g = raster_folder(spark, sf)
    files = rasters.discover(spark, path).where(F.col("date") == F.lit("2020-01-13").cast("date"))
    return rasters.read_rasters(files, g, window=(2, 6, 3, 8)).where("value IS NOT NULL").select("pixel_id", "value")


# --- the bounded ratio field -----------------------------------------------------------------------------------------

RATIO_CELLS = f"SELECT (floor(x / 2.5) + 0.5) * 2.5 AS x, (floor(y / 2.5) + 0.5) * 2.5 AS y, sum(value * value) AS q2, sum(value * x) AS qd FROM ({GRID}) GROUP BY ALL HAVING sum(value * value) > 0"


def ratio_problem(spark: SparkSession, sf: str) -> ratio.Problem:
    """Cells of the grid of values, with nodes 4 and 7 apart, four of them near each cell."""
    rows = grid(spark, sf).select("x", "y", F.lit(1.0).alias("w"), F.col("value").alias("q"), F.col("x").alias("d"))
    c = spatial.cell_sums(rows, 2.5)
    cells = c.select(((F.col("cx") + 0.5) * 2.5).alias("x"), ((F.col("cy") + 0.5) * 2.5).alias("y"), "q2", "qd", "d2", F.col("w").alias("weight"))
    return ratio.problem(cells, [4.0, 7.0], most=3.0, block=5.0, neighbours=4)


@query(
    f"WITH c AS MATERIALIZED ({RATIO_CELLS}), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c), "
    "n AS (SELECT spacing, i * spacing AS sx, j * spacing AS sy FROM e, (VALUES (CAST(4 AS DOUBLE)), (CAST(7 AS DOUBLE))) s(spacing), range(-1, 2000) a(i), range(-1, 2000) b(j) WHERE i BETWEEN floor(x0 / spacing) AND ceil(x1 / spacing) AND j BETWEEN floor(y0 / spacing) AND ceil(y1 / spacing)), "
    "m AS (SELECT spacing, sx, sy FROM n, c GROUP BY ALL HAVING min((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 9), "
    "k AS (SELECT spacing, x, y, q2, qd, sx, sy, exp(-0.5 * ((x - sx) * (x - sx) + (y - sy) * (y - sy)) / pow(1.5 * spacing, 2)) AS w FROM c, m QUALIFY row_number() OVER (PARTITION BY spacing, x, y ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), sy, sx) <= 4), "
    "w AS (SELECT * REPLACE (w / greatest(sum(w) OVER (PARTITION BY spacing, x, y), 1e-12) AS w) FROM k) "
    f"SELECT a.spacing, a.sx AS ax, a.sy AS ay, b.sx AS bx, b.sy AS b_y, {rounded('sum(a.q2 * a.w * b.w)', 2)} AS v FROM w a JOIN w b ON a.spacing = b.spacing AND a.x = b.x AND a.y = b.y AND (a.sy < b.sy OR (a.sy = b.sy AND a.sx <= b.sx)) GROUP BY ALL "
    f"UNION ALL SELECT spacing, sx, sy, NULL, NULL, {rounded('sum(qd * w)', 2)} FROM w GROUP BY ALL"
)
def ratio_normal_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse normal sums of a ratio field: a row a pair of nodes that share a cell, and a row a node for the right-hand side."""
    p = ratio_problem(spark, sf)
    at = {side: p.nodes.select(F.col("site_id").alias(side), F.col("sx").alias(x), F.col("sy").alias(y)) for side, x, y in (("a", "ax", "ay"), ("b", "bx", "b_y"))}
    total = p.sums.groupBy("spacing", "a", "b").agg(F.sum("v").alias("v"))
    return total.join(at["a"], "a").join(at["b"], "b", "left").select("spacing", "ax", "ay", "bx", "b_y", (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query()
def bounded_ratio_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate's nodes, error and tested cells, and the mean of its field between the bounds; a bounded fit has no SQL."""
    p, bounds = ratio_problem(spark, sf), {"low": 0.0, "high": 0.01}
    lams = [0.1, 10.0]
    fields = p.solve(lams, **bounds).groupBy("spacing", "lam").agg(F.avg("value").alias("mean_value"), F.min("value").alias("least_value"), F.max("value").alias("greatest_value"))
    return p.errors(lams, **bounds).join(fields, ["spacing", "lam"])
