"""k nearest sites of points, by two trees of squares that are descended together.

Points and sites are laid in squares that are split 8 x 8 a level, each set in its own. A node is an occupied square with
the box that its members really take up. The search goes down both trees by levels. Its state is a table of pairs
(group of points, node of sites). From the boxes follow a least and a greatest distance of each pair. A group's k-th
greatest distance is the least one within which nodes of k sites lie whole; a node beyond it by its least distance
can't hold a site that is among the k nearest of any point of the group, and its pair goes. Every level is a join of the
pairs with the children of both sides and a window over a group's few pairs, so far, clustered and dense sets cost alike:
what is left at the end are the nodes about the k-th distance of small groups. Only then points meet sites.
"""

from __future__ import annotations

import tempfile
import uuid
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Squares on a side of a square one level up; levels at most, and levels that are added while squares are too full.
SPLIT, DEEPEST, STEP = 8, 8, 2
#: Points and sites that a square of the last level holds at most, but at DEEPEST.
POINTS, SITES = 32, 8
#: Nodes of a level that may be sent to every task.
BROADCAST_ROWS = 100_000
#: Rounding of distances of boxes against those of their members.
SLACK = 1 + 1e-9


def shared_folder(spark: SparkSession, kind: str = "nearest") -> str:
    """A new folder's name below the one that all executors share; below a local one where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='terrachron-')).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def squares(x: str, y: str, box: tuple[float, float, float, float], levels: int) -> list[Column]:
    """gx and gy of the last level's squares within the members' own extent."""
    width = max(box[1] - box[0], box[3] - box[2], 1e-300) * (1 + 1e-12) / SPLIT**levels
    return [F.floor((F.col(c) - F.lit(low)) / F.lit(width)).cast("long").alias(name) for c, low, name in ((x, box[0], "gx"), (y, box[2], "gy"))]


def tree(members: DataFrame, x: str, y: str, box: tuple[float, float, float, float], n: int, most: int) -> tuple[int, DataFrame]:
    """The number of the last level, and level, gx, gy, n and the box x0, x1, y0, y1 of each occupied square of all levels, written and read back.

    The last level is the first from which on no square has more than ``most`` members, looked for in steps, or DEEPEST.
    """
    spark, path = members.sparkSession, shared_folder(members.sparkSession)
    levels = min(DEEPEST, ceil(log(max(2.0, n / most), SPLIT * SPLIT)) + 1)
    while True:
        leaves = members.groupBy(*squares(x, y, box, levels)).agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
        leaves.write.mode("overwrite").parquet(f"{path}/leaves")
        read = spark.read.schema(leaves.schema).parquet(f"{path}/leaves")
        if levels == DEEPEST or read.agg(F.max("n")).first()[0] <= most:
            break
        levels = min(DEEPEST, levels + STEP)
    up = read.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    above = F.pow(F.lit(float(SPLIT)), F.lit(levels) - F.col("level"))
    nodes = up.groupBy("level", *(F.floor(F.col(c) / above).cast("long").alias(c) for c in ("gx", "gy"))).agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    nodes.write.partitionBy("level").parquet(f"{path}/nodes")
    return levels, spark.read.schema(nodes.schema).parquet(f"{path}/nodes")


def extent(members: DataFrame, x: str, y: str) -> tuple[int, tuple[float, float, float, float]]:
    r = members.agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return r[0], tuple(0.0 if v is None else float(v) for v in r[1:])


def gap(a: str, b: str, c: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{b}.{c}0") - F.col(f"{a}.{c}1"), F.col(f"{a}.{c}0") - F.col(f"{b}.{c}1"))


def reach(a: str, b: str, c: str) -> Column:
    return F.greatest(F.col(f"{b}.{c}1") - F.col(f"{a}.{c}0"), F.col(f"{a}.{c}1") - F.col(f"{b}.{c}0"))


def near_pairs(groups: DataFrame, nodes: DataFrame, k: int, group_levels: int, node_levels: int) -> DataFrame:
    """g and s (square and box of a group of points and of a node of sites) and limit of what is left at the last levels."""

    def children(side: DataFrame, name: str, level: int, few: dict[int, int]) -> DataFrame:
        own = F.struct("gx", "gy", "n", "x0", "x1", "y0", "y1").alias(name)
        rows = side.where(F.col("level") == level).select(own, *(F.floor(F.col(c) / SPLIT).cast("long").alias(f"__{c}") for c in ("gx", "gy")))
        return F.broadcast(rows) if few.get(level, 0) <= BROADCAST_ROWS else rows

    sizes = [{r["level"]: r["count"] for r in side.groupBy("level").count().collect()} for side in (groups, nodes)]
    top = [children(side, name, 0, few).drop("__gx", "__gy") for side, name, few in ((groups, "g", sizes[0]), (nodes, "s", sizes[1]))]
    pairs = top[0].crossJoin(top[1]).withColumn("limit", F.lit(float("inf")))  # one row each
    own = Window.partitionBy("g.gx", "g.gy")
    for level in range(1, max(group_levels, node_levels) + 1):
        for side, name, last, few in ((groups, "g", group_levels, sizes[0]), (nodes, "s", node_levels, sizes[1])):
            if level <= last:
                pairs = pairs.withColumnRenamed(name, f"{name}_")
                on = (F.col(f"{name}_.gx") == F.col("__gx")) & (F.col(f"{name}_.gy") == F.col("__gy"))
                pairs = pairs.join(children(side, name, level, few), on).drop(f"{name}_", "__gx", "__gy")
        pairs = pairs.withColumns({"low": F.hypot(gap("g", "s", "x"), gap("g", "s", "y")), "high": F.hypot(reach("g", "s", "x"), reach("g", "s", "y"))}).where(F.col("low") <= F.col("limit") * SLACK)
        held = pairs.withColumn("held", F.sum("s.n").over(own.orderBy("high").rowsBetween(Window.unboundedPreceding, 0)))
        held = held.withColumn("limit", F.min(F.when(F.col("held") >= k, F.col("high"))).over(own))
        pairs = held.where(F.col("low") <= F.col("limit") * SLACK).select("g", "s", "limit")
    return pairs


def near_sites(points: DataFrame, sites: DataFrame, k: int, *, point: str = "pixel_id") -> DataFrame:
    """point, site_id and distance of the sites (site_id, sx, sy) that may be among the k nearest of each point (x, y), and are if they are.

    Points and sites without coordinates take no part; repeated ones give a row each. Fewer than k sites are all near.
    """
    points, sites = points.where("x IS NOT NULL AND y IS NOT NULL"), sites.where("sx IS NOT NULL AND sy IS NOT NULL")
    (n_points, around), (n_sites, within) = extent(points, "x", "y"), extent(sites, "sx", "sy")
    if not n_points or not n_sites:
        return points.select(point, F.lit(None).cast(dict(sites.dtypes)["site_id"]).alias("site_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    levels, trees = zip(tree(points, "x", "y", around, n_points, POINTS), tree(sites, "sx", "sy", within, n_sites, SITES), strict=True)
    pairs = near_pairs(*trees, min(k, n_sites), *levels)
    asked = points.select(point, "x", "y", *squares("x", "y", around, levels[0])).join(pairs.select(F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy"), "s", "limit"), ["gx", "gy"])
    away = F.hypot(F.greatest(F.lit(0.0), F.col("s.x0") - F.col("x"), F.col("x") - F.col("s.x1")), F.greatest(F.lit(0.0), F.col("s.y0") - F.col("y"), F.col("y") - F.col("s.y1")))
    met = asked.where(away <= F.col("limit") * SLACK).select(point, "x", "y", F.col("s.gx").alias("gx"), F.col("s.gy").alias("gy"))
    laid = sites.select("site_id", "sx", "sy", *squares("sx", "sy", within, levels[1]))
    return met.join(laid, ["gx", "gy"]).select(point, "site_id", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")).alias("distance"))
