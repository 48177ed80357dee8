"""Well tables: wide to long, coercion, quality control, gap filling, baselines and coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATE_NAME = re.compile(r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(\s|$)")
MAD = 1.4826


def date_columns(names: list[str]) -> list[str]:
    """The column names that read as a date."""
    found = [(n, DATE_NAME.match(n)) for n in names]
    return [n for n, m in found if m and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31]


def wide_to_long(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``fields``: canonical name to source column. Every date column becomes a row (date text, value text)."""
    ids = [F.col(f"`{v}`").alias(k) for k, v in fields.items()]
    dates = date_columns(df.columns)
    if not dates:
        raise ValueError("no column reads as a date")
    flat = df.select(*ids, *(F.col(f"`{d}`").cast("string").alias(d) for d in dates))
    return flat.unpivot(list(fields), [F.col(f"`{d}`") for d in dates], "date", "value")


def rename(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    if missing := sorted(set(fields.values()) - set(df.columns)):
        raise KeyError(f"columns are missing: {missing}")
    return df.select(*(F.col(f"`{v}`").alias(k) for k, v in fields.items()))


def parse_date(c: Column) -> Column:
    """A date from year, month, day with any of - / . between; null for what isn't one."""
    return F.try_to_date(F.regexp_replace(F.substring_index(F.trim(c.cast("string")), " ", 1), "[/.]", "-"), "y-M-d")


def coerce(df: DataFrame, numbers: list[str], date: str = "date", keys: tuple[str, ...] = ("station_id", "date", "lon", "lat")) -> DataFrame:
    """Texts to dates and numbers, null where they are neither; rows with a null key go. NaN is null."""
    out = df.withColumn(date, parse_date(F.col(date)))
    for c in numbers:
        v = F.expr(f"try_cast(`{c}` AS double)")
        out = out.withColumn(c, F.when(~F.isnan(v), v))
    return out.dropna(subset=[k for k in keys if k in out.columns])


def map_labels(c: Column | None, labels: dict[str, str]) -> Column:
    """The label of a value, else its trimmed lower case; ``unknown`` without a column."""
    if c is None:
        return F.lit("unknown")
    text = F.lower(F.trim(c.cast("string")))
    if not labels:
        return text
    table = F.create_map(*(F.lit(x) for k, v in labels.items() for x in (str(k), v)))
    return F.coalesce(table[F.trim(c.cast("string"))], text)


def depth_to_head(df: DataFrame, depth: str = "value", elevation: str = "elevation_m") -> DataFrame:
    if elevation not in df.columns:
        raise KeyError(f"depths need {elevation}")
    return df.withColumn("head_m", F.col(elevation) - F.col(depth))


def sentinel_zero(c: Column, atol: float = 1e-12) -> Column:
    return F.when(F.abs(c) > atol, c)


def physical_range(depth: Column, least: float = -0.5, well_depth: Column | None = None) -> Column:
    out = F.when(depth >= least, depth)
    return out if well_depth is None else F.when(F.coalesce(depth <= well_depth, F.lit(True)), out)


def daily_median(df: DataFrame, keys: list[str], value: str = "value", day: str = "day") -> DataFrame:
    """One row a key and day: the median of its values."""
    return df.groupBy(*keys, day).agg(F.median(value).alias(value))


def inconsistent_coordinates(df: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Stations whose coordinates spread by more than the tolerance."""
    spread = [F.max(c) - F.min(c) for c in ("lon", "lat")]
    return df.groupBy("station_id").agg(*(s.alias(f"{c}_spread") for s, c in zip(spread, ("lon", "lat"), strict=True))).where((F.col("lon_spread") > tolerance) | (F.col("lat_spread") > tolerance))


def frame(days: int) -> tuple[int, int]:
    """The days around a row that a centred time window of ``days`` holds."""
    return (-(days - 1) // 2, (days - 1) // 2) if days % 2 else (-days // 2 + 1, days // 2)


def spikes(df: DataFrame, keys: list[str], *, value: str = "value", day: str = "day", window: int = 31, sigma: float = 8.0, floor: float = 15.0, neighbours: int = 7, gap: int = 7) -> DataFrame:
    """``df`` with local_median, abs_residual, threshold and spike.

    A value is a spike if both its neighbours lie within ``gap`` days and it is further from the median of the window
    around it than max(floor, sigma * 1.4826 * MAD), where the window has ``neighbours`` values at least; deviations
    in the MAD are each from their own day's median.
    """
    low, high = frame(window)
    around = Window.partitionBy(*keys).orderBy(day).rangeBetween(low, high)
    enough = F.count(value).over(around) >= neighbours
    first = df.withColumn("local_median", F.when(enough, F.percentile(value, F.lit(0.5)).over(around))).withColumn("abs_residual", F.abs(F.col(value) - F.col("local_median")))
    enough_again = F.count("abs_residual").over(around) >= neighbours
    second = first.withColumn("threshold", F.when(enough_again, F.greatest(F.lit(floor), sigma * MAD * F.percentile("abs_residual", F.lit(0.5)).over(around))))
    there = F.when(F.col(value).isNotNull(), F.col(day))
    before, after = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(day).rowsBetween(1, Window.unboundedFollowing)
    near = (F.col(day) - F.last(there, ignorenulls=True).over(before) <= gap) & (F.first(there, ignorenulls=True).over(after) - F.col(day) <= gap)
    return second.withColumn("spike", F.coalesce(near & (F.col("abs_residual") > F.col("threshold")), F.lit(False)))


def qc_report(parts: list[DataFrame]) -> DataFrame:
    """The union of audit tables with different columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def baseline_anomaly(df: DataFrame, keys: list[str], start: int, end: int, *, least: int = 6, value: str = "value", day: str = "day") -> DataFrame:
    """anomaly = value - the key's median within [start, end]; keys with fewer than ``least`` values there go."""
    inside = F.when(F.col(day).between(start, end), F.col(value))
    base = df.groupBy(*keys).agg(F.median(inside).alias("baseline"), F.count(inside).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(base, keys).withColumn("anomaly", F.col(value) - F.col("baseline"))


def coverage(df: DataFrame, keys: list[str], days: int, least: float = 0.5, value: str = "value") -> DataFrame:
    """Keys with values on at least a share ``least`` of ``days`` days, and that share."""
    return df.groupBy(*keys).agg((F.count(value) / F.lit(days)).alias("coverage")).where(F.col("coverage") >= least)


def active_days(df: DataFrame, series: int, least: float = 0.0, value: str = "value", day: str = "day") -> DataFrame:
    """Days on which at least a share ``least`` of ``series`` series have a value, and that share."""
    return df.groupBy(day).agg((F.count(value) / F.lit(series)).alias("active")).where(F.col("active") >= least)


def within(df: DataFrame, start: int | None = None, end: int | None = None, day: str = "day") -> DataFrame:
    """The rows of an analysis window; an end that is not given is the data's own."""
    df = df if start is None else df.where(F.col(day) >= start)
    return df if end is None else df.where(F.col(day) <= end)


def of_class(df: DataFrame, label: str | None, column: str = "aquifer_class") -> DataFrame:
    """The rows of a class, whatever its case; all rows without one."""
    return df if not label else df.where(F.lower(column) == str(label).lower())


def first_metadata(df: DataFrame, keys: list[str], columns: list[str], order: str = "date") -> DataFrame:
    """keys and each column's value of the first row that has one (the smallest among those of one date)."""
    return df.groupBy(*keys).agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns))


def in_order(df: DataFrame) -> DataFrame:
    """Canonical order, for a sink."""
    return df.orderBy("station_id", "date")


def class_counts(df: DataFrame, station: str = "station_id", label: str = "aquifer_class") -> DataFrame:
    return df.select(station, label).distinct().groupBy(label).agg(F.count("*").alias("wells"))


def monthly_active(df: DataFrame, station: str = "station_id", date: str = "date") -> DataFrame:
    return df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count_distinct(station).alias("wells"))


def canonical(df: DataFrame, *, variable: str = "head", labels: dict[str, str] | None = None, least_depth: float = -0.5, zero_is_missing: bool = False, spike: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Well rows (station_id, date, lon, lat, value [, aquifer_class, well_depth_m, elevation_m]) to canonical heads and a QC report."""
    extra = [c for c in ("well_depth_m", "elevation_m") if c in df.columns]
    rows = coerce(df, ["lon", "lat", "value", *extra])
    rows = rows.withColumn("station_id", F.trim(F.col("station_id").cast("string"))).withColumn("aquifer_class", map_labels(F.col("aquifer_class") if "aquifer_class" in rows.columns else None, labels or {}))
    audit = rows.select("station_id", "date", "aquifer_class", F.lit("zero_depth_sentinel").alias("reason"), "value").where(F.lit(zero_is_missing) & (F.abs("value") <= 1e-12))
    if variable == "depth_to_water":
        depth = sentinel_zero(F.col("value")) if zero_is_missing else F.col("value")
        depth = physical_range(depth, least_depth, F.col("well_depth_m") if "well_depth_m" in rows.columns else None)
        rows = depth_to_head(rows.withColumn("value", depth))
    else:
        rows = rows.withColumn("head_m", F.col("value"))
    if spike is not None:
        checked = spikes(rows.withColumn("__day", F.unix_date("date")), ["station_id"], value="head_m", day="__day", **spike)
        found = checked.where("spike").select("station_id", "date", "aquifer_class", F.lit("local_spike").alias("reason"), "head_m", F.col("local_median").alias("local_median_m"), F.col("abs_residual").alias("abs_residual_m"), F.col("threshold").alias("threshold_m"))
        audit = qc_report([audit, found])
        rows = checked.withColumn("head_m", F.when(~F.col("spike"), F.col("head_m")))
    return rows.where(F.col("head_m").isNotNull()).select("station_id", "date", "lon", "lat", "head_m", "aquifer_class", *extra), audit
