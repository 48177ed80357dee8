"""Exact quantiles and ranks by key, where one key may hold most rows.

A double is taken as a long that sorts as doubles do (``sortable``), and that long as three digits of 22, 21 and 21 bits.
Counts by digit merge, so rows are added up in their own tasks, and the counts of one digit below one prefix are at most
4,194,304 rows whatever the data are: only these meet in a window, never a key's values.

``quantiles`` goes down the digits with the wanted ranks of all keys at once: each of three scans counts the next digit
of the rows that share a prefix with a rank. With more keys than may be broadcast, and for ``average_ranks``, the
distinct values of a key are counted once and numbered by the three levels of their prefixes.

Nulls have no rank and don't count. NaN sorts above infinity, -0.0 equals 0.0, keys may be null (a group of their own).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.operators.nearest import shared_folder

#: Bits below the end of each digit.
ENDS = (42, 21, 0)
#: Pairs of a key and a wanted rank that may be sent to every task.
BROADCAST_ROWS = 200_000
INFINITE = 2047 << 52


def sortable(df: DataFrame, value: str, name: str = "__b") -> DataFrame:
    """``df`` with a long for each double, in the order of the doubles: exponent and fraction as IEEE 754 stores them, by exact arithmetic.

    Each step is a column, so that it is computed once a row.
    """
    v, a, e, two = F.col(value), F.col("__a"), F.col("__e"), F.col("__two")
    size = F.abs(v)
    normal = (size >= F.lit(2.0**-1022)) & (size < F.lit(float("inf")))
    out = df.withColumn("__a", F.when(normal, size).otherwise(F.lit(1.0)))
    out = out.withColumn("__e", F.least(F.greatest(F.floor(F.log2("__a")), F.lit(-1022)), F.lit(1023)))
    out = out.withColumn("__two", F.pow(F.lit(2.0), e.cast("double")))
    # The logarithm may be off by a little about a power of two; the next power would overflow, hence the quotient.
    step = F.when((a < two) & (e > -1022), -1).when(a / two >= 2, 1).otherwise(0)
    out = out.withColumn("__step", step).withColumn("__two", F.when(F.col("__step") < 0, two / 2).when(F.col("__step") > 0, two * 2).otherwise(two))
    regular = F.shiftleft((e + F.col("__step") + 1023).cast("long"), 52) + ((a / two - 1) * F.lit(2.0**52)).cast("long")
    bits = F.when(normal, regular).when(F.isnan(v), F.lit(INFINITE + 1)).when(size < F.lit(2.0**-1022), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).otherwise(F.lit(INFINITE))
    return out.withColumn(name, bits).withColumn(name, F.when(v < 0, -F.col(name)).when(v.isNotNull(), F.col(name))).drop("__a", "__e", "__two", "__step")


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """A join by columns of equal name, in which nulls are equal; the left side's stay."""
    other = right.select(*(F.col(c).alias(f"__on_{i}") for i, c in enumerate(on)), *(c for c in right.columns if c not in on))
    other = F.broadcast(other) if broadcast else other
    if not on:
        return left.join(other, F.lit(True), how)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__on_{i}")) for i, c in enumerate(on)))
    return left.join(other, same, how).drop(*(f"__on_{i}" for i in range(len(on))))


def few_keys(df: DataFrame, keys: list[str], most: int) -> bool:
    """Whether ``keys`` has at most ``most`` values; one job, over the keys' columns only."""
    return not keys or df.select(*keys).distinct().limit(most + 1).count() <= most


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder now and read back, for what several scans read and is dear to compute."""
    path = shared_folder(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix(i: int) -> Column:
    return F.shiftright("__b", ENDS[i]).alias(f"__p{i}")


def running(by: list[str], order: str) -> Column:
    return F.sum("__n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def numbered(rows: DataFrame, ks: list[str]) -> DataFrame:
    """ks, __b, __v, __n, __before (values below) and __m (all values of the key) of each distinct value; rows: ks, __b, __v."""
    by = ks or ["__all"]
    leaves = rows.withColumn("__all", F.lit(0)).groupBy(*by, "__b").agg(F.count("*").alias("__n"), F.min("__v").alias("__v"))
    leaves = leaves.select("*", prefix(0), prefix(1))
    middle = leaves.groupBy(*by, "__p0", "__p1").agg(F.sum("__n").alias("__n"))
    top = middle.groupBy(*by, "__p0").agg(F.sum("__n").alias("__n"))
    top = top.select(*by, "__p0", (running(by, "__p0") - F.col("__n")).alias("__t"), F.sum("__n").over(Window.partitionBy(*by)).alias("__m"))
    middle = middle.withColumn("__u", running([*by, "__p0"], "__p1") - F.col("__n")).drop("__n")
    leaves = leaves.withColumn("__w", running([*by, "__p0", "__p1"], "__b") - F.col("__n"))
    middle = join_same(middle, top, [*by, "__p0"])
    out = join_same(leaves, middle, [*by, "__p0", "__p1"])
    return out.select(*ks, "__b", "__v", "__n", (F.col("__t") + F.col("__u") + F.col("__w")).alias("__before"), "__m")


def wanted(m: Column, qs: list[float]) -> Column:
    """The two ranks about each quantile of ``m`` values, as an array of (i, r)."""
    place = [F.floor((m - 1) * F.lit(float(q))).cast("long") for q in qs]
    return F.array(*(F.struct(F.lit(2 * j + s).alias("i"), F.least(p + s, m - 1).cast("long").alias("r")) for j, p in enumerate(place) for s in (0, 1)))


def held(ranks: Column, before: Column) -> Column:
    """Those of ``ranks`` that are among the __n values after ``before``, counted from there."""
    inside = F.filter(ranks, lambda x: (x["r"] >= before) & (x["r"] < before + F.col("__n")))
    return F.transform(inside, lambda x: F.struct(x["i"].alias("i"), (x["r"] - before).alias("r")))


def descended(rows: DataFrame, ks: list[str], qs: list[float]) -> DataFrame:
    """ks, __m, __v and the wanted ranks __r that the value holds, by three scans of ``rows``; the ranks are few enough to be broadcast."""
    state = None
    for i in range(len(ENDS)):
        above = [*ks, "__m", "__r", f"__p{i - 1}"] if state is not None else (ks or ["__all"])
        here = rows.withColumn("__all", F.lit(0)) if state is None else join_same(rows.select("*", prefix(i - 1)), state, [*ks, f"__p{i - 1}"], broadcast=True)
        last = [F.min("__v").alias("__v")] if i == len(ENDS) - 1 else []
        counts = here.select("*", prefix(i)).groupBy(*above, f"__p{i}").agg(F.count("*").alias("__n"), *last)
        if state is None:
            counts = counts.withColumn("__m", F.sum("__n").over(Window.partitionBy(*above))).withColumn("__r", wanted(F.col("__m"), qs))
        counts = counts.withColumn("__before", running(above, f"__p{i}") - F.col("__n"))
        counts = counts.withColumn("__r", held(F.col("__r"), F.col("__before"))).where(F.size("__r") > 0)
        state = counts.select(*ks, "__m", "__r", "__v" if last else f"__p{i}")
    return state


def quantiles(df: DataFrame, keys: list[str], values: Mapping[str, Column | str], qs: Mapping[str, float], most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` and the exact quantiles of each value, named value + quantile, with linear interpolation.

    A key has a row if any of its values is not null; a value without rows has null quantiles. Without keys there is one
    row, always. ``df`` is read three times (once with more keys than may be broadcast), so store what is dear to compute.
    With keys, one job counts them now.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    named = df.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), *((F.col(c) if isinstance(c, str) else c).cast("double").alias(f"__v{j}") for j, c in enumerate(values.values())))
    pairs = F.explode(F.array(*(F.struct(F.lit(j).alias("c"), F.col(f"__v{j}").alias("v")) for j in range(len(values)))))
    long = named.select(*ks, pairs.alias("__x")).select(*ks, F.col("__x.c").alias("__c"), (F.col("__x.v") + F.lit(0.0)).alias("__v")).where("__v IS NOT NULL")
    rows, share, by = sortable(long, "__v"), list(qs.values()), [*ks, "__c"]
    if few_keys(named, ks, most // (2 * len(qs) * len(values))):
        found = descended(rows, by, share)
    else:
        found = numbered(rows, by).withColumn("__r", held(wanted(F.col("__m"), share), F.col("__before"))).where(F.size("__r") > 0)
    each = found.select(*by, "__m", "__v", F.explode("__r.i").alias("__i"))

    def at(c: int, j: int, q: float) -> Column:
        low, high = (F.min(F.when((F.col("__c") == c) & (F.col("__i") == 2 * j + s), F.col("__v"))) for s in (0, 1))
        m = F.max(F.when(F.col("__c") == c, F.col("__m")))
        place = (m - 1) * F.lit(float(q))
        part = place - F.floor(place)
        return F.when((low == high) | (part == 0), low).otherwise(low + (high - low) * part)

    return each.groupBy(*ks).agg(*(at(c, j, q).alias(f"{v}{n}") for c, v in enumerate(values) for j, (n, q) in enumerate(qs.items()))).withColumnsRenamed(dict(zip(ks, keys, strict=True)))


def medians(df: DataFrame, keys: list[str], values: Mapping[str, Column | str]) -> DataFrame:
    """``keys`` and the exact median of each value under its name; as ``quantiles``."""
    return quantiles(df, keys, values, {"": 0.5})


def with_groups(df: DataFrame, groups: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, many rows a key, with the columns of ``groups``, one row a key; sent to every task where the keys are few (counted now)."""
    return join_same(df, groups, keys, "left", broadcast=few_keys(df, keys, most))


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row a key as one, with the rows of the left one; without keys each is one row."""
    return join_same(left, right, keys, "left", broadcast=not keys)


def average_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with rank_<column> among the rows of its key: ties share the mean of their ranks, nulls have none.

    Only counts of distinct values are numbered; rows meet their value's rank in a join whose one side has a row a value,
    so that a value which many rows share is split by adaptive execution.
    """
    out = df
    for c in columns:
        valued = sortable(out.withColumn("__v", F.col(c).cast("double") + F.lit(0.0)), "__v")
        own = valued.where("__v IS NOT NULL").select(*keys, "__b", "__v")
        ranks = numbered(own, keys).select(*keys, "__b", (F.col("__before") + (F.col("__n") + 1) / 2).alias(f"rank_{c}"))
        out = join_same(valued, ranks, [*keys, "__b"], "left").drop("__b", "__v")
    return out
