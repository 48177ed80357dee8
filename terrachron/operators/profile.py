"""Marker tables of an extensometer: markers, intervals, profiles, contributions; strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.operators import ranks
from terrachron.operators.wells import parse_date

UP, DOWN = ("uplift", "up", "upward", "positive_up"), ("subsidence", "down", "downward", "positive_down")


def marker_sign(text: str) -> float:
    word = str(text).strip().lower()
    if word not in UP + DOWN:
        raise ValueError(f"neither uplift nor subsidence: {text}")
    return 1.0 if word in UP else -1.0


def markers(df: DataFrame, *, date_column: str, depth_label: str, marker_columns: list[str], positive: str = "uplift") -> DataFrame:
    """date, marker_id, depth_m, marker_displacement_mm (positive up) from a wide table with one row of depths."""
    label = F.trim(F.col(f"`{date_column}`").cast("string"))
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    wide = df.select(label.alias("__label"), *(number(c).alias(c) for c in marker_columns))
    long = wide.unpivot(["__label"], marker_columns, "marker_id", "__value")
    depths = long.where(F.col("__label") == depth_label.strip()).groupBy("marker_id").agg(F.max("__value").alias("depth_m")).where("depth_m IS NOT NULL")
    rows = long.where(F.col("__label") != depth_label.strip()).withColumn("date", parse_date(F.col("__label"))).where("date IS NOT NULL")
    joined = rows.join(depths, "marker_id").select("date", "marker_id", "depth_m", (F.col("__value") * marker_sign(positive)).alias("marker_displacement_mm"))
    some = F.count("marker_displacement_mm").over(Window.partitionBy("date"))
    return joined.withColumn("__n", some).where("__n > 0").drop("__n")


def intervals(m: DataFrame) -> DataFrame:
    """Compaction between each marker and the next deeper one: u(lower) - u(upper)."""
    w = Window.partitionBy("date").orderBy("depth_m")
    out = m.select("date", F.col("depth_m").alias("depth_top_m"), F.lead("depth_m").over(w).alias("depth_bottom_m"), F.col("marker_id").alias("upper_marker"), F.lead("marker_id").over(w).alias("lower_marker"), (F.lead("marker_displacement_mm").over(w) - F.col("marker_displacement_mm")).alias("compaction_mm"))
    return out.where("depth_bottom_m IS NOT NULL")


def profile(m: DataFrame) -> DataFrame:
    """The whole column between the shallowest and the deepest marker."""
    return m.groupBy("date").agg(F.min("depth_m").alias("monitoring_top_m"), F.max("depth_m").alias("monitoring_bottom_m"), (F.max_by("marker_displacement_mm", "depth_m") - F.min_by("marker_displacement_mm", "depth_m")).alias("profile_compaction_mm"))


def cumulative_to_intervals(df: DataFrame) -> DataFrame:
    """Values cumulative from the surface to intervals: each less the one above, which starts at 0."""
    w = Window.partitionBy("date").orderBy("depth_bottom_m")
    return df.select("date", F.coalesce(F.lag("depth_bottom_m").over(w), F.lit(0.0)).alias("depth_top_m"), "depth_bottom_m", (F.col("compaction_mm") - F.coalesce(F.lag("compaction_mm").over(w), F.lit(0.0))).alias("compaction_mm"))


def contributions(i: DataFrame) -> DataFrame:
    """First and last known value of each interval, the change and its share of the sum of changes."""
    rows = i.where("compaction_mm IS NOT NULL")
    out = rows.groupBy("depth_top_m", "depth_bottom_m").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("compaction_mm", "date").alias("initial_mm"), F.max_by("compaction_mm", "date").alias("final_mm")).withColumn("change_mm", F.col("final_mm") - F.col("initial_mm"))
    total = F.sum("change_mm").over(Window.partitionBy())
    return out.withColumn("fraction_of_profile_change", F.when(total != 0, F.col("change_mm") / total))


def profile_sum(i: DataFrame) -> DataFrame:
    return i.groupBy("date").agg(F.sum("compaction_mm").alias("profile_compaction_mm"))


def spatial_median(df: DataFrame, value: str = "value", day: str = "day") -> DataFrame:
    """day and the exact median of all pixels, null where a day has none; a day's pixels don't meet in one task."""
    return ranks.side_by_side(df.select(day).distinct(), ranks.medians(df, [day], {value: value}), [day])


def strata_totals(df: DataFrame, layers: int, *, sand: str = "sand", clay: str = "clay") -> DataFrame:
    """pixel_id, total sand and clay over pixels that have all layers, and the clay fraction."""
    ok = F.col(sand).isNotNull() & F.col(clay).isNotNull()
    out = df.where(ok).groupBy("pixel_id").agg(F.sum(sand).alias("sand"), F.sum(clay).alias("clay"), F.count("*").alias("__n")).where(F.col("__n") == layers).drop("__n")
    return out.withColumn("clay_fraction", F.when(F.col("sand") + F.col("clay") > 0, F.col("clay") / (F.col("sand") + F.col("clay"))))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
