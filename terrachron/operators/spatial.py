"""Spatial joins on points and grids, cell sums, resampling and support masks."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.functions import geo
from terrachron.operators import ranks
from terrachron.operators.nearest import near_sites


def pixel_grid(df: DataFrame, width: int, pixel: str = "pixel_id", block: int = 256) -> DataFrame:
    """``df`` with row, col and block_id (a partitioning key of square tiles)."""
    row, col = F.floor(F.col(pixel) / width), F.col(pixel) % width
    return df.withColumns({"row": row.cast("int"), "col": col.cast("int"), "block_id": (F.floor(row / block) * ceil(width / block) + F.floor(col / block)).cast("long")})


def nearest_site(points: DataFrame, sites: DataFrame, *, point: str = "pixel_id") -> DataFrame:
    """point, site_id and distance of the nearest of the sites (site_id, sx, sy); the smallest id among equals."""
    best = near_sites(points, sites, 1, point=point).groupBy(point).agg(F.min(F.struct("distance", "site_id")).alias("b"))
    return best.select(point, "b.site_id", "b.distance")


def knn_weights(points: DataFrame, sites: DataFrame, k: int = 12, sigma: float = 1.0, *, point: str = "pixel_id", vanished: float | None = None) -> DataFrame:
    """point, site_id, distance and Gaussian weight, normalised to 1, of the k nearest of the sites.

    ``vanished``: the weight of sites so far away that all of a point's weights are 0 as doubles (None: equal shares).
    """
    own = Window.partitionBy(point)
    near = near_sites(points, sites, k, point=point).withColumn("__k", F.row_number().over(own.orderBy("distance", "site_id"))).where(F.col("__k") <= k).drop("__k")
    w = geo.gaussian(F.col("distance"), sigma)
    total = F.sum(w).over(own)
    return near.withColumn("weight", F.when(total > 0, w / total).otherwise(1 / F.count("*").over(own) if vanished is None else F.lit(vanished)))


def radius_pairs(points: DataFrame, radius: float, *, point: str = "id") -> DataFrame:
    """a < b and distance of all pairs within ``radius``: an equi-join on grid cells of that size and their neighbours."""
    cells = points.select(F.col(point).alias("id"), "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = cells.select("id", "x", "y", F.explode(around).alias("o"), "cx", "cy").select("id", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    on = [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy"), F.col("a.id") < F.col("b.id"), d <= radius]
    return cells.alias("a").join(spread.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance"))


def points_to_pixels(points: DataFrame, affine: tuple[float, ...], height: int, width: int) -> DataFrame:
    """``points`` with row, col and pixel_id of the pixel that holds them; points outside go."""
    row, col = geo.row_col(F.col("x"), F.col("y"), affine)
    out = points.withColumns({"row": row.cast("int"), "col": col.cast("int")}).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return out.withColumn("pixel_id", F.col("row").cast("long") * width + F.col("col"))


def neighbourhood(pixels: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Pixels (with x, y) within a radius of a site, or else the nearest one."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    ranked = pixels.withColumn("distance", d)
    nearest = ranked.orderBy("distance", "pixel_id").limit(1)
    return ranked.where(F.col("distance") <= radius).unionByName(nearest.where(F.col("distance") > radius)).dropDuplicates(["pixel_id"])


def cell_sums(df: DataFrame, cell: float, *, weight: str = "w", head: str = "q", displacement: str = "d") -> DataFrame:
    """cx, cy and sums of q q, q d, d d, w and rows of each cell; only cells with weight and head stay."""
    q, d, w = F.col(head), F.col(displacement), F.col(weight)
    out = df.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.sum(w * q * q).alias("q2"), F.sum(w * q * d).alias("qd"), F.sum(w * d * d).alias("d2"), F.sum(w).alias("w"), F.count("*").alias("n"))
    return out.where("q2 > 0 AND w > 0")


def cell_join(a: DataFrame, b: DataFrame, cell: float, value: str = "value") -> DataFrame:
    """Medians of two point maps in cells that both have."""
    sides = [m.where(F.col(value).isNotNull()).groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.median(value).alias(n)) for m, n in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], ["cx", "cy"])


def cell_mean(df: DataFrame, cell: float, value: str = "value") -> DataFrame:
    """Block averages on a coarser grid."""
    return df.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def bilinear(targets: DataFrame, source: DataFrame, affine: tuple[float, ...], *, key: str = "pixel_id", value: str = "value") -> DataFrame:
    """key and value: a source raster (row, col, value) at target points (x, y), over the up to four cells that are there."""
    a, _, c, _, e, f = affine
    fx, fy = F.round((F.col("x") - c) / a - 0.5, 9), F.round((F.col("y") - f) / e - 0.5, 9)  # a target on a centre takes that cell alone
    base = targets.select(key, fx.alias("fx"), fy.alias("fy"))
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    each = base.select(key, "fx", "fy", F.explode(corner).alias("o")).select(key, (F.floor("fy") + F.col("o.i")).cast("int").alias("row"), (F.floor("fx") + F.col("o.j")).cast("int").alias("col"), (F.abs(1 - F.col("o.i") - (F.col("fy") - F.floor("fy"))) * F.abs(1 - F.col("o.j") - (F.col("fx") - F.floor("fx")))).alias("w"))
    joined = each.join(source.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("__v")), ["row", "col"]).where("w > 0")
    return joined.groupBy(key).agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias(value))


def stride(df: DataFrame, step: int) -> DataFrame:
    return df.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 20260919) -> DataFrame:
    """n rows, the same ones each time, by a digest of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def block_sample(df: DataFrame, days: int, most: int, *, each: int = 200, seed: int = 20260919, pixel: str = "pixel_id", block: str = "block_id", value: str = "value") -> DataFrame:
    """pixel and block of at most ``most`` series: blocks in the order of a digest, from each at most ``each`` evenly spaced ones.

    Only series with values on at least half the ``days`` days, and 12, count.
    """
    good = df.groupBy(pixel, block).agg(F.count(value).alias("__n")).where(F.col("__n") >= max(12, days // 2))
    own = Window.partitionBy(block)
    placed = good.select(pixel, block, (F.row_number().over(own.orderBy(pixel)) - 1).alias("__at"), F.count("*").over(own).alias("__m"))
    step = F.ceil(F.col("__at") * (each - 1) / (F.col("__m") - 1))
    chosen = placed.where((F.col("__m") <= each) | (F.floor(step * (F.col("__m") - 1) / (each - 1)) == F.col("__at")))
    return chosen.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(block).cast("string"))), block, "__at").limit(most).select(pixel, block)


def fold_ids(points: DataFrame, block: float, folds: int) -> DataFrame:
    """``points`` with bx, by (blocks from the smallest x and y) and the diagonal fold of the block."""
    low = points.agg(F.min("x").alias("__lx"), F.min("y").alias("__ly"))
    out = points.crossJoin(F.broadcast(low))
    out = out.withColumns({"bx": geo.block_id(F.col("x"), F.col("__lx"), block), "by": geo.block_id(F.col("y"), F.col("__ly"), block)}).drop("__lx", "__ly")
    return out.withColumn("fold", geo.legacy_fold(F.col("bx"), F.col("by"), folds))


def support(points: DataFrame, hull: list[tuple[float, float]], nearest: Column | None = None, max_distance: float | None = None) -> DataFrame:
    """``points`` with inside_hull and high_confidence (inside, and near enough to a well if a distance is given)."""
    inside = geo.inside_hull(F.col("x"), F.col("y"), hull)
    near = F.lit(True) if nearest is None or max_distance is None else nearest <= max_distance
    return points.withColumns({"prediction": F.lit(True), "inside_hull": inside, "high_confidence": inside & near})


def select_support(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a support: high_confidence, inside_hull, prediction, or none for all."""
    return df if kind == "none" else df.where(F.coalesce(F.col(kind), F.lit(False)))


def clip(df: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """``df`` with in_domain: inside an odd number of rings, after a test of their bounding box."""
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
    odd = sum((geo.inside_polygon(F.col("x"), F.col("y"), r).cast("int") for r in rings), F.lit(0)) % 2 == 1
    return df.withColumn("in_domain", box & odd)


def display_limits(df: DataFrame, value: str = "value", symmetric: bool = False) -> DataFrame:
    """One row: the 2nd and 98th percentiles, or plus and minus the larger of their sizes."""
    q = ranks.quantiles(df, [], {"": value}, {"low": 0.02, "high": 0.98})
    m = F.greatest(F.abs("low"), F.abs("high"))
    return q.select((-m).alias("low"), m.alias("high")) if symmetric else q
