"""Partition of displacement into a recoverable and an irreversible part, and area-weighted volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.operators import ranks

PARTS = ("total", "recoverable", "irreversible")


def partition(displacement_mm: Column, ratio: Column, head_change: Column) -> tuple[Column, Column, Column]:
    """Metres of total, recoverable and irreversible change."""
    total = displacement_mm / 1000
    recoverable = ratio * head_change
    return total, recoverable, total - recoverable


def with_parts(df: DataFrame, *, displacement: str = "displacement_mm", ratio: str = "ratio", head: str = "head_change_m") -> DataFrame:
    """``df`` with total, recoverable and irreversible."""
    return df.withColumns(dict(zip(PARTS, partition(F.col(displacement), F.col(ratio), F.col(head)), strict=True)))


def in_domain(displacement_n: Column, head_n: Column, epochs: Column, ratio: Column, fraction: float = 0.9) -> Column:
    """Pixels with a ratio and with both series on enough epochs."""
    least = F.ceil(epochs * fraction)
    return F.coalesce(ratio.isNotNull() & (displacement_n >= least) & (head_n >= least), F.lit(False))


def volumes(df: DataFrame, keys: list[str], *, area: str = "area") -> DataFrame:
    """Volumes of the three parts, the gross negative irreversible volume and the pixels and area they cover."""
    v = [F.sum(F.col(p) * F.col(area)).alias(f"{p}_gws_change_m3") for p in PARTS]
    there = F.col("irreversible").isNotNull()
    gross = -F.sum(F.greatest(-F.col("irreversible"), F.lit(0.0)) * F.col(area))
    return df.groupBy(*keys).agg(*v, gross.alias("gross_negative_irreversible_change_m3"), F.count_if(there).alias("pixels"), F.sum(F.when(there, F.col(area))).alias("area_m2"))


def annual_summary(df: DataFrame, *, area: str = "area", threshold_mm: float = 1.0) -> DataFrame:
    """For each year: volumes, area fractions by sign, the area that recovers while it compacts, medians in mm."""
    a, least = F.col(area), threshold_mm / 1000
    negative = {"total": F.col("total") < -least, "irreversible": F.col("irreversible") < -least}
    positive = F.col("recoverable") > least
    both = positive & negative["irreversible"]
    whole = F.sum(a)
    rows = df.where("irreversible IS NOT NULL")
    sums = rows.groupBy("year").agg(
        *(F.sum(F.col(p) * a).alias(f"{p}_gws_change_m3") for p in PARTS),
        F.greatest(-F.sum(F.col("irreversible") * a), F.lit(0.0)).alias("net_irreversible_loss_magnitude_m3"),
        (-F.sum(F.greatest(-F.col("irreversible"), F.lit(0.0)) * a)).alias("gross_negative_irreversible_change_m3"),
        (whole / 1e6).alias("domain_area_km2"),
        (F.sum(F.when(negative["total"], a).otherwise(0)) / whole).alias("fraction_area_total_negative"),
        (F.sum(F.when(positive, a).otherwise(0)) / whole).alias("fraction_area_recoverable_positive"),
        (F.sum(F.when(negative["irreversible"], a).otherwise(0)) / whole).alias("fraction_area_irreversible_negative"),
        (F.sum(F.when(both, a).otherwise(0)) / 1e6).alias("recovery_with_continued_compaction_area_km2"),
        (F.sum(F.when(both, a).otherwise(0)) / whole).alias("fraction_area_recovery_with_continued_compaction"),
    )
    middles = ranks.medians(rows, ["year"], {f"median_{p}_mm": F.col(p) * 1000 for p in PARTS})
    return ranks.side_by_side(sums, middles, ["year"]).withColumn("diagnostic_threshold_mm", F.lit(threshold_mm))


def cosine_sensitivity(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.5, 0.7), *, area: str = "area") -> DataFrame:
    """Pixels, area and volumes of pixels whose cosine passes each threshold."""
    grid = F.broadcast(df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "min_vector_cosine double"))
    kept = df.where("irreversible IS NOT NULL").join(grid, F.col("cosine") >= F.col("min_vector_cosine"))
    out = kept.groupBy("min_vector_cosine").agg(F.count("*").alias("pixels"), (F.sum(area) / 1e6).alias("area_km2"), *(F.sum(F.col(p) * F.col(area)).alias(f"{p}_gws_change_m3") for p in PARTS))
    return out.select("*", *((F.col(f"{p}_gws_change_m3") / F.col("area_km2") / 1e3).alias(f"{p}_equivalent_mm") for p in PARTS))


def observed_series(displacement: DataFrame, head: DataFrame, pixels: DataFrame, base_day: int, *, area: str = "area") -> DataFrame:
    """day, cumulative volumes since the base epoch, over pixels (pixel_id, ratio, area) where both series are there."""
    joined = displacement.select("pixel_id", "day", F.col("value").alias("d")).join(head.select("pixel_id", "day", F.col("value").alias("h")), ["pixel_id", "day"]).join(pixels, "pixel_id")
    base = joined.where(F.col("day") == base_day).select("pixel_id", F.col("d").alias("d0"), F.col("h").alias("h0"))
    moved = joined.join(base, "pixel_id").where(F.col("d").isNotNull() & F.col("h").isNotNull())
    parts = partition(F.col("d") - F.col("d0"), F.col("ratio"), F.col("h") - F.col("h0"))
    return moved.groupBy("day").agg(*(F.sum(p * F.col(area)).alias(f"{n}_gws_change_m3") for n, p in zip(PARTS, parts, strict=True)))


def reintegrate(maps_mm: DataFrame, previous: DataFrame, *, area: str = "area") -> DataFrame:
    """Volumes of saved annual maps (year, {part}_mm) against saved volumes: both, pixels and difference."""
    own = maps_mm.groupBy("year").agg(*(F.sum(F.col(f"{p}_mm") / 1000 * F.col(area)).alias(f"{p}_maps") for p in PARTS), *(F.count(f"{p}_mm").alias(f"map_pixels_{p}") for p in PARTS))
    joined = own.join(previous, "year", "left")
    return joined.select("year", *(c for p in PARTS for c in (F.col(f"{p}_maps").alias(f"{p}_gws_change_m3_maps"), F.col(f"{p}_gws_change_m3").alias(f"{p}_gws_change_m3_previous"), F.col(f"map_pixels_{p}"), (F.col(f"{p}_maps") - F.col(f"{p}_gws_change_m3")).alias(f"{p}_difference"))))
