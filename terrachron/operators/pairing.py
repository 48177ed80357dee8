"""Same-season pairs: one-to-one nearest anniversaries, and rates from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.functions.basis import YEAR


def same_season_pairs(df: DataFrame, keys: list[str], *, date: str = "date", months: tuple[int, int] = (1, 8), max_day_diff: int = 18, years: list[int] | None = None) -> DataFrame:
    """keys, year1, year2, date1, date2, anniversary_offset_days, elapsed_days, elapsed_years.

    A year's dates, in order, each take the free date of the next year nearest to their anniversary, the earlier among
    equals, if it lies within ``max_day_diff`` days; both must fall into the months. Days of a key are counted once.
    The greedy fold runs over a year's dates within one row, so it needs one shuffle, by key.
    """
    inside = df.select(*keys, F.to_date(date).alias("d")).where(F.month("d").between(*months)).distinct()
    by_year = inside.groupBy(*keys, F.year("d").alias("y")).agg(F.sort_array(F.collect_list("d")).alias("days"))
    target = by_year.select(*keys, (F.col("y") - 1).alias("y"), F.col("days").alias("free"))
    both = by_year.join(target, [*keys, "y"])
    if years is not None:
        both = both.where(F.col("y").isin(years))
    best = f"array_min(transform(filter(acc.free, t -> abs(datediff(t, add_months(s, 12))) <= {max_day_diff}), t -> struct(abs(datediff(t, add_months(s, 12))) AS gap, t AS day)))"
    none = "CAST(array() AS array<struct<date1: date, date2: date>>)"
    step = f"element_at(transform(array({best}), b -> named_struct('free', if(b IS NULL, acc.free, array_remove(acc.free, b.day)), 'pairs', if(b IS NULL, acc.pairs, array_append(acc.pairs, named_struct('date1', s, 'date2', b.day))))), 1)"
    pairs = both.withColumn("p", F.expr(f"aggregate(days, named_struct('free', free, 'pairs', {none}), (acc, s) -> {step}).pairs"))
    out = pairs.select(*keys, F.col("y").alias("year1"), (F.col("y") + 1).alias("year2"), F.explode("p").alias("p")).select(*keys, "year1", "year2", "p.date1", "p.date2")
    elapsed = F.datediff("date2", "date1")
    return out.select("*", F.datediff("date2", F.add_months("date1", 12)).alias("anniversary_offset_days"), elapsed.alias("elapsed_days"), (elapsed / F.lit(YEAR)).alias("elapsed_years"))


def valued_pairs(df: DataFrame, keys: list[str], *, date: str = "date", value: str = "value", months: tuple[int, int] = (1, 8), max_day_diff: int = 18) -> DataFrame:
    """``same_season_pairs`` with value1, value2 and rate, in one shuffle by key: the fold carries the days' medians along."""
    rows = df.select(*keys, F.to_date(date).alias("d"), F.col(value).alias("v")).where(F.month("d").between(*months))
    rows = rows.repartition(*keys) if keys else rows
    daily = rows.groupBy(*keys, "d").agg(F.median("v").alias("v"))
    whole = daily.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("all"))
    year = lambda k: F.filter("all", lambda x: F.year(x["d"]) == F.col("y") + k)
    both = whole.select(*keys, "all", F.explode(F.array_distinct(F.transform("all", lambda x: F.year(x["d"])))).alias("y")).select(*keys, "y", year(0).alias("days"), year(1).alias("free")).where(F.size("free") > 0)
    gap = "abs(datediff(t.d, add_months(s.d, 12)))"
    best = f"array_min(transform(filter(acc.free, t -> {gap} <= {max_day_diff}), t -> struct({gap} AS gap, t.d AS day, t.v AS v)))"
    none = "CAST(array() AS array<struct<date1: date, date2: date, value1: double, value2: double>>)"
    pair = "named_struct('date1', s.d, 'date2', b.day, 'value1', CAST(s.v AS double), 'value2', CAST(b.v AS double))"
    step = f"element_at(transform(array({best}), b -> named_struct('free', if(b IS NULL, acc.free, filter(acc.free, t -> t.d <> b.day)), 'pairs', if(b IS NULL, acc.pairs, array_append(acc.pairs, {pair})))), 1)"
    pairs = both.withColumn("p", F.expr(f"aggregate(days, named_struct('free', free, 'pairs', {none}), (acc, s) -> {step}).pairs"))
    out = pairs.select(*keys, F.col("y").alias("year1"), (F.col("y") + 1).alias("year2"), F.explode("p").alias("p")).select(*keys, "year1", "year2", "p.*")
    elapsed = F.datediff("date2", "date1")
    out = out.withColumns({"anniversary_offset_days": F.datediff("date2", F.add_months("date1", 12)), "elapsed_days": elapsed, "elapsed_years": elapsed / F.lit(YEAR)})
    return out.withColumn("rate", (F.col("value2") - F.col("value1")) / F.col("elapsed_years"))


def values_of_pairs(df: DataFrame, pairs: list[tuple], keys: list[str], *, date: str = "date", value: str = "value") -> DataFrame:
    """The rates of the same pairs of dates (year1, year2, date1, date2, elapsed_years: one list for all) in every series, in one shuffle by key."""
    series = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(date), F.col(value)))).alias("m"))
    each = F.array(*(F.struct(F.lit(y1).alias("year1"), F.lit(y2).alias("year2"), F.lit(a).alias("date1"), F.lit(b).alias("date2"), F.lit(float(t)).alias("elapsed_years")) for y1, y2, a, b, t in pairs))
    out = series.select(*keys, "m", F.explode(each).alias("p")).select(*keys, "p.*", F.col("m")[F.col("p.date1")].alias("value1"), F.col("m")[F.col("p.date2")].alias("value2"))
    return out.withColumn("rate", (F.col("value2") - F.col("value1")) / F.col("elapsed_years"))


def with_values(pairs: DataFrame, df: DataFrame, keys: list[str], *, date: str = "date", value: str = "value") -> DataFrame:
    """Pairs with value1 and value2 of their dates."""
    values = df.select(*keys, F.to_date(date).alias("d"), F.col(value).alias("v")).groupBy(*keys, "d").agg(F.median("v").alias("v"))
    out = pairs
    for i in (1, 2):
        out = out.join(values.select(*keys, F.col("d").alias(f"date{i}"), F.col("v").alias(f"value{i}")), [*keys, f"date{i}"], "left")
    return out.withColumn("rate", (F.col("value2") - F.col("value1")) / F.col("elapsed_years"))


def pair_rates(valued: DataFrame, keys: list[str], *, least: int = 3) -> DataFrame:
    """keys, year1, year2, n_pairs, rate: the median of the pairs' rates, null with fewer than ``least`` of them."""
    out = valued.groupBy(*keys, "year1", "year2").agg(F.count("rate").alias("n_pairs"), F.median("rate").alias("rate"))
    return out.withColumn("rate", F.when(F.col("n_pairs") >= least, F.col("rate")))


def jackknife(valued: DataFrame, keys: list[str]) -> DataFrame:
    """For each pair the median rate without it, and its shift from that of all pairs; the sorted rates of a group are one array."""
    groups = valued.where("rate IS NOT NULL").groupBy(*keys, "year1", "year2").agg(F.sort_array(F.collect_list(F.struct("rate", "date1", "date2"))).alias("all"))
    one = groups.select(*keys, "year1", "year2", "all", F.posexplode("all").alias("i", "p"))
    n = F.size("all")

    def middle(size, at):  # noqa: ANN001, ANN202  median of a sorted array of that size, by its 0-based element
        half = F.floor(size / 2).cast("int")
        return F.when(size % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)

    full = middle(n, lambda k: F.col("all")[k]["rate"])
    rest = middle(n - 1, lambda k: F.col("all")[F.when(k >= F.col("i"), k + 1).otherwise(k)]["rate"])
    return one.where(n > 1).select(*keys, "year1", "year2", F.col("p.date1").alias("date1"), F.col("p.date2").alias("date2"), rest.alias("median_without"), full.alias("median_all"), (rest - full).alias("shift_from_full"))


def without_scenes(valued: DataFrame, scenes: DataFrame, keys: list[str], *, least: int = 3) -> DataFrame:
    """``pair_rates`` of the pairs that use none of the dates in ``scenes`` (date)."""
    for i in (1, 2):
        valued = valued.join(scenes.select(F.col("date").alias(f"date{i}")).distinct(), f"date{i}", "left_anti")
    return pair_rates(valued, keys, least=least)
