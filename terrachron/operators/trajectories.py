"""Interval metrics, classes of trajectories, and their histograms, tables and sensitivities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.functions import classes


def nan_slope(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """slope and n of y on x over rows where both are there; null with fewer than ``least`` or without spread in x."""
    there = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)
    a, b = F.when(there == 1, F.col(x)), F.when(there == 1, F.col(y))
    n, sx, sy, sxx, sxy = F.count(there), F.sum(a), F.sum(b), F.sum(a * a), F.sum(a * b)
    sums = df.groupBy(*keys).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    denominator = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("n") >= least) & (F.abs(denominator) > 1e-12), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / denominator)
    return sums.select(*keys, "n", slope.alias("slope"))


SETS = ("early", "late", "recent", "recovery")


def interval_sets(years: list[int], chosen: dict[str, list[int] | None] | None = None) -> dict[str, list[int]]:
    """First years of the intervals of each set, and of all.

    Early and late are up to three at either end, recent the last three, recovery the two before those, or the first
    two where there are none. ``chosen`` sets replace them; a chosen interval that isn't there is an error.
    """
    y = sorted(set(years))
    n = len(y)
    k, r = min(3, max(1, n // 2)), min(3, n)
    out = {"early": y[:k], "late": y[n - k :], "recent": y[n - r :], "recovery": y[max(0, n - r - 2) : n - r] or y[:2]}
    out |= {name: list(own) for name, own in (chosen or {}).items() if own}
    if missing := sorted({v for own in out.values() for v in own} - set(y)):
        raise ValueError(f"intervals that begin in {missing} are required and not there")
    return {**out, "all": y}


def least_intervals(sets: dict[str, list[int]], **least: int | None) -> dict[str, int]:
    """The numbers of intervals that a place must have: valid (of all, for either variable), recent (likewise), recovery (heads), declines (recent heads)."""
    n = {"valid": len(sets["all"]), "recent": len(sets["recent"]), "recovery": len(sets["recovery"]), "declines": len(sets["recent"])}
    usual = {"valid": 4, "recent": 2, "recovery": 1, "declines": 2}
    return {name: max(2 if name == "valid" else 1, min(n[name] if least.get(name) is None else int(least[name]), n[name], usual[name] if least.get(name) is None else n[name])) for name in usual}


def interval_metrics(rates: DataFrame, heads: DataFrame, keys: list[str], sets: dict[str, list[int]], *, meaningful_head: float = 1.0, least: dict[str, int] | None = None) -> DataFrame:
    """keys, valid, the twelve metrics, recent_declines, recent_heads (their list) and the numbers of intervals.

    rates and heads: keys, year1, rate. Medians early, late, recovery and recent are over a set's intervals that are
    there; slopes are per year over the intervals' middles, and the recent change is the recent slope times the recent
    set's span (a year for one interval). A place without enough intervals (``least``) is not valid, and its metrics
    are null. Intervals outside of ``sets["all"]`` don't count.
    """
    least = least or least_intervals(sets)
    span = float(max(sets["recent"]) - min(sets["recent"])) if len(sets["recent"]) > 1 else 1.0

    def of(name: str, value: str = "rate") -> Column:
        return F.when(F.col("year1").isin(sets[name] or [-1]), F.col(value))

    def slope(name: str) -> Column:
        return F.regr_slope(of(name), F.col("year1") + 0.5)

    a = rates.groupBy(*keys).agg(
        F.median(of("early")).alias("early_rate"), F.median(of("late")).alias("late_rate"), slope("all").alias("rate_slope"), slope("recent").alias("recent_rate_slope"), F.count(of("all")).alias("n_rate_intervals"), F.count(of("recent")).alias("n_recent_rates")
    )
    b = heads.groupBy(*keys).agg(
        *(F.median(of(name)).alias(f"{name}_head") for name in SETS), slope("all").alias("head_slope"), F.collect_list(of("recent")).alias("recent_heads"), F.count(of("all")).alias("n_head_intervals"), F.count(of("recovery")).alias("n_recovery_heads")
    )
    both = a.join(b, keys).withColumns({"rate_change": F.col("late_rate") - F.col("early_rate"), "recent_rate_change": F.col("recent_rate_slope") * span, "head_difference": F.col("late_head") - F.col("early_head"), "recent_declines": declines(meaningful_head)})
    enough = (F.least("n_rate_intervals", "n_head_intervals") >= least["valid"]) & (F.least("n_recent_rates", F.size("recent_heads")) >= least["recent"]) & (F.col("n_recovery_heads") >= least["recovery"])
    both = both.withColumn("valid", enough)
    return both.withColumns({name: F.when(F.col("valid"), F.col(name)) for name in METRICS})


#: The metrics of a place, by this package's names.
METRICS = ("early_rate", "late_rate", "rate_change", "rate_slope", "recent_rate_change", "recent_rate_slope", "early_head", "late_head", "head_difference", "head_slope", "recovery_head", "recent_head")
#: The class of places that are not valid.
NODATA = 255


def declines(meaningful_head: Column | float) -> Column:
    """How many recent heads fall by more than a meaningful change."""
    m = meaningful_head if isinstance(meaningful_head, Column) else F.lit(float(meaningful_head))
    return F.size(F.filter("recent_heads", lambda h: h < -m))


def classify(metrics: DataFrame, *, least_declines: int = 2, **thresholds: float) -> DataFrame:
    """``metrics`` with deformation_class, groundwater_state and coupled_class; ``NODATA`` where a place is not valid."""
    s, c, h, m = (thresholds.get(k, d) for k, d in (("stable_rate", 5.0), ("meaningful_rate", 5.0), ("stable_head", 0.5), ("meaningful_head", 1.0)))
    mode, state, coupled = classes_of(s, c, h, m, F.col("recent_declines"), least_declines)
    masked = lambda x: F.when(F.col("valid"), x).otherwise(NODATA)
    return metrics.withColumns({"deformation_class": masked(mode), "groundwater_state": masked(state), "coupled_class": masked(coupled)})


def classes_of(stable_rate: Column | float, meaningful_rate: Column | float, stable_head: Column | float, meaningful_head: Column | float, fallen: Column, least_declines: int) -> tuple[Column, Column, Column]:
    """Deformation class, groundwater state and coupled class under given thresholds."""
    mode = classes.deformation_class(F.col("early_rate"), F.col("late_rate"), F.col("rate_change"), stable_rate, meaningful_rate)
    state = classes.groundwater_state(F.col("recent_head"), stable_head, meaningful_head)
    coupled = classes.coupled_class(F.col("recovery_head"), F.col("recent_head"), fallen, mode, F.col("late_rate"), F.col("recent_rate_change"), least_declines=least_declines, stable_rate=stable_rate, meaningful_rate=meaningful_rate, stable_head=stable_head, meaningful_head=meaningful_head)
    return mode, state, coupled


def legend(df: DataFrame, labels: dict[int, str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(labels.items()), f"{name} int, {name}_label string")


def histogram(df: DataFrame, column: str, labels: dict[int, str], *, area: str = "area") -> DataFrame:
    """class_id, class_label, pixel_count, area, fraction_of_support, fraction_of_classified (null for class 0); empty classes count 0."""
    counts = df.groupBy(F.col(column).alias("class_id")).agg(F.count("*").alias("pixel_count"), F.sum(area).alias("area"))
    rows = legend(df, labels, "class_id").join(counts, "class_id", "left").na.fill({"pixel_count": 0, "area": 0.0})
    whole = Window.partitionBy()
    some = F.sum(F.when(F.col("class_id") > 0, F.col("pixel_count"))).over(whole)
    return rows.select("class_id", F.col("class_id_label").alias("class_label"), "pixel_count", "area", (F.col("pixel_count") / F.sum("pixel_count").over(whole)).alias("fraction_of_support"), F.when((F.col("class_id") > 0) & (some > 0), F.col("pixel_count") / some).alias("fraction_of_classified"))


def summary_families(df: DataFrame, families: dict[str, tuple[str, dict[int, str]]], *, area: str = "area", nodata: int = 255) -> DataFrame:
    """family, class_id, class_label, pixels and area of every class of each family (column, labels), and the legend's row of pixels outside."""
    out = df.sparkSession.createDataFrame([("all", nodata, "outside_support_or_nodata", 0, 0.0)], "family string, class_id int, class_label string, pixels long, area double")
    for family, (column, labels) in families.items():
        rows = histogram(df, column, labels, area=area)
        out = out.unionByName(rows.select(F.lit(family).alias("family"), "class_id", "class_label", F.col("pixel_count").alias("pixels"), F.col("area").cast("double").alias("area")))
    return out


def cross_tab(df: DataFrame, first: str, first_labels: dict[int, str], second: str, second_labels: dict[int, str], *, area: str = "area") -> DataFrame:
    """Every combination of two classes with pixel_count, area and fraction of all, zeros included."""
    counts = df.groupBy(first, second).agg(F.count("*").alias("pixel_count"), F.sum(area).alias("area"))
    rows = legend(df, first_labels, first).crossJoin(legend(df, second_labels, second)).join(counts, [first, second], "left").na.fill({"pixel_count": 0, "area": 0.0})
    return rows.withColumn("fraction_of_support", F.col("pixel_count") / F.sum("pixel_count").over(Window.partitionBy()))


def confusion(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """Counts of actual and predicted classes over all rows and for each interval, in one pass (grouping sets)."""
    names = ", ".join(by)
    out = df.sparkSession.sql(f"SELECT CASE WHEN grouping({by[0]}) = 1 THEN 'all' ELSE 'interval' END AS scope, {names}, {actual}, {predicted}, count(*) AS count FROM {{df}} GROUP BY GROUPING SETS (({actual}, {predicted}), ({names}, {actual}, {predicted}))", df=df)
    total = F.sum("count").over(Window.partitionBy("scope", *by, actual))
    return out.withColumn("actual_count", total).withColumn("fraction_of_actual", F.col("count") / F.col("actual_count"))


def threshold_sensitivity(metrics: DataFrame, *, stable: Sequence[float] = (3.0, 5.0, 10.0), change: Sequence[float] = (3.0, 5.0, 10.0), head: Sequence[float] = (0.5, 1.0, 1.5), stable_head: float = 0.5, meaningful_head: float = 1.0, least_declines: int = 2) -> DataFrame:
    """stable_rate, meaningful_rate_change, meaningful_head_change, class_id, pixel_count, fraction: coupled classes of valid places under every combination of thresholds.

    Declines are counted anew for each head threshold; those below ``stable_head`` don't count (``meaningful_head`` if
    none is left). A sample by strides of rows and columns is ``spatial.stride`` before.
    """
    kept = [m for m in head if m >= stable_head] or [meaningful_head]
    grid = metrics.sparkSession.createDataFrame([(float(s), float(c), float(m)) for s in stable for c in change for m in kept], "stable_rate double, meaningful_rate_change double, meaningful_head_change double")
    names = grid.columns
    both = metrics.where("valid").crossJoin(F.broadcast(grid))
    coupled = classes_of(F.col(names[0]), F.col(names[1]), stable_head, F.col(names[2]), declines(F.col(names[2])), least_declines)[2]
    counts = both.groupBy(*names, coupled.alias("class_id")).agg(F.count("*").alias("pixel_count"))
    return counts.withColumn("fraction", F.col("pixel_count") / F.sum("pixel_count").over(Window.partitionBy(*names)))


def intervals_with_wells(well_rates: DataFrame, least: int = 8) -> DataFrame:
    return well_rates.where("rate IS NOT NULL").groupBy("year1").agg(F.count("*").alias("n_wells")).where(F.col("n_wells") >= least)


def common_intervals(rates: DataFrame, well_rates: DataFrame, least: int = 8) -> DataFrame:
    """Rates of the intervals that enough wells have (semi-join)."""
    return rates.join(intervals_with_wells(well_rates, least), "year1", "left_semi")


def missing_intervals(required: DataFrame, available: DataFrame) -> DataFrame:
    """Required first years that are not available (anti-join)."""
    return required.select("year1").distinct().join(available.select("year1"), "year1", "left_anti")
