"""Daily calendars, gap-aware interpolation, nearest and common epochs, overlaps of time ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reindex(df: DataFrame, keys: list[str], start: int | None = None, end: int | None = None, day: str = "day") -> DataFrame:
    """A row for every key and day; days default to each key's own range."""
    low = F.min(day) if start is None else F.lit(start)
    high = F.max(day) if end is None else F.lit(end)
    days = df.groupBy(*keys).agg(low.alias("__low"), high.alias("__high")).select(*keys, F.explode(F.sequence("__low", "__high")).alias(day))
    return days.join(df, [*keys, day], "left")


def brackets(df: DataFrame, keys: list[str], value: str, day: str) -> DataFrame:
    """``df`` with the days and values of the last value up to each row and the first from it on."""
    there = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("day"), F.col(value).alias("value")))
    back = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("__before", F.last(there, ignorenulls=True).over(back)).withColumn("__after", F.first(there, ignorenulls=True).over(ahead))


def linear(day: Column) -> Column:
    a, b = F.col("__before"), F.col("__after")
    return F.when(a["day"] == b["day"], a["value"]).otherwise(a["value"] + (b["value"] - a["value"]) * (day - a["day"]) / (b["day"] - a["day"]))


def fill_short_gaps(df: DataFrame, keys: list[str], max_gap: int, *, value: str = "value", day: str = "day") -> DataFrame:
    """A daily series whose inner runs of at most ``max_gap`` missing days are filled linearly in time."""
    run = F.col("__after")["day"] - F.col("__before")["day"] - 1
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(run <= max_gap, linear(F.col(day)))
    return brackets(df, keys, value, day).withColumn(value, filled).drop("__before", "__after")


def missing_runs(df: DataFrame, keys: list[str], *, value: str = "value", day: str = "day") -> DataFrame:
    """Runs of missing days of a daily series: first_day, last_day, length."""
    w = Window.partitionBy(*keys).orderBy(day)
    miss = F.col(value).isNull()
    begun = F.when(miss != F.coalesce(F.lag(miss).over(w), ~miss), 1).otherwise(0)
    runs = df.withColumn("__miss", miss).withColumn("__begun", begun).withColumn("__run", F.sum("__begun").over(w))
    return runs.where("__miss").groupBy(*keys, "__run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("__run")


def interpolate_at(df: DataFrame, queries: DataFrame, keys: list[str], max_gap: int | None, *, value: str = "value", day: str = "day") -> DataFrame:
    """Each query (keys, day) with value: exact, or linear if its bracket is no wider than ``max_gap`` days; supported says whether."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, day, value, F.lit(False).alias("__query"))
    asked = queries.select(*keys, day, F.lit(None).cast("double").alias(value), F.lit(True).alias("__query"))
    both = brackets(rows.unionByName(asked), keys, value, day)
    # a query's own row may sort before or after an equal day's value, so both sides are asked for with days tied
    tied = Window.partitionBy(*keys).orderBy(day).rangeBetween(0, 0)
    both = both.withColumn("__same", F.max(value).over(tied))
    width = F.col("__after")["day"] - F.col("__before")["day"]
    inside = width.isNotNull() if max_gap is None else F.coalesce(width <= max_gap, F.lit(False))
    out = both.where("__query").withColumn(value, F.coalesce("__same", F.when(inside, linear(F.col(day))))).withColumn("supported", F.col("__same").isNotNull() | inside)
    return out.select(*keys, day, value, "supported")


def common_days(sources: list[DataFrame], keys: list[str], day: str = "day") -> DataFrame:
    """Keys and days that every source has."""
    return reduce(lambda a, b: a.intersect(b), [s.select(*keys, day) for s in sources])


def nearest_epoch(epochs: DataFrame, targets: DataFrame, keys: list[str], *, day: str = "day", target: str = "target") -> DataFrame:
    """For each target day the nearest epoch of the key, the earliest among equals.

    With keys, epochs and targets lie in one order of days, and only the epochs next to targets are looked at: no row
    is made for a pair of epoch and target. Without keys the epochs are sent to every task.
    """
    if not keys:
        gap = F.struct(F.abs(F.col(day) - F.col(target)).alias("gap"), F.col(day).alias("day"))
        joined = targets.crossJoin(F.broadcast(epochs.select(day).distinct()))
        return joined.groupBy(target).agg(F.min(gap).alias("__best")).select(target, F.col("__best.day").alias(day), F.col("__best.gap").alias("gap"))
    rows = epochs.select(*keys, F.col(day).alias("__at"), F.lit(0).alias("__asks")).unionByName(targets.select(*keys, F.col(target).alias("__at"), F.lit(1).alias("__asks")).distinct())
    order = Window.partitionBy(*keys).orderBy("__at", "__asks")
    beside = (F.coalesce(F.lag("__asks").over(order), F.lit(0)) == 1) | (F.coalesce(F.lead("__asks").over(order), F.lit(0)) == 1)
    some = rows.withColumn("__beside", beside).where("__beside OR __asks = 1")
    there, back = F.when(F.col("__asks") == 0, F.struct(F.col("__at").alias("day"))), Window.partitionBy(*keys).orderBy(F.desc("__at"), "__asks")
    ends = [F.last(there, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for w, name in ((order, "__a"), (back, "__b"))]
    at, a, b = F.col("__at"), F.col("__a.day"), F.col("__b.day")
    near = F.when(b.isNull() | (at - a <= b - at), a).otherwise(b)
    found = some.select(*keys, "__at", "__asks", *ends).where("__asks = 1 AND (__a IS NOT NULL OR __b IS NOT NULL)").select(*keys, at.alias(target), near.alias(day))
    return found.withColumn("gap", F.abs(F.col(day) - F.col(target)))


def overlap(sources: list[DataFrame], day: str = "day") -> DataFrame:
    """One row: start and end of the range that all sources share, both null without one."""
    parts = [s.agg(F.min(day).alias(f"a{i}"), F.max(day).alias(f"b{i}")) for i, s in enumerate(sources)]
    row = reduce(lambda x, y: x.crossJoin(y), parts)
    start, end = (F.greatest, F.least) if len(sources) > 1 else ((lambda c: c), (lambda c: c))
    out = row.select(start(*(F.col(f"a{i}") for i in range(len(sources)))).alias("start"), end(*(F.col(f"b{i}") for i in range(len(sources)))).alias("end"))
    return out.select(F.when(F.col("start") <= F.col("end"), F.col("start")).alias("start"), F.when(F.col("start") <= F.col("end"), F.col("end")).alias("end"))


def change_from_first(df: DataFrame, keys: list[str], *, value: str = "value", day: str = "day") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumn("change", F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def annual_intervals(spark_df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end") -> DataFrame:
    """Calendar years of [start, end] (dates): year, start_date, end_date, complete_calendar_year."""
    years = spark_df.select(*keys, start, end, F.explode(F.sequence(F.year(start), F.year(end))).alias("year"))
    first, following = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    out = years.select(*keys, "year", F.greatest(first, F.col(start)).alias("start_date"), F.least(following, F.col(end)).alias("end_date"), ((F.col(start) <= first) & (F.col(end) >= following)).alias("complete_calendar_year"))
    return out.where("end_date > start_date")
