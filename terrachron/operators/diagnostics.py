"""Quantiles, error metrics, rank correlation, robust scores, planes, holdouts, windows and agreement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.functions import basis, classes
from terrachron.functions.basis import TimeModel
from terrachron.operators import lsq, ranks

ROBUST = 0.6744897501960817
QUANTILES = (("p01", 0.01), ("p10", 0.1), ("median", 0.5), ("p90", 0.9), ("p99", 0.99))


def exact_quantiles(df: DataFrame, value: str | Column, qs: Sequence[float], most: int = ranks.BROADCAST_ROWS) -> list[float | None]:
    """Exact quantiles of all rows, with linear interpolation, as numbers; None without a value. See ``ranks.quantiles``."""
    names = {str(i): q for i, q in enumerate(qs)}
    row = ranks.quantiles(df, [], {"q": value}, names, most=most).first()
    return [row[f"q{n}"] for n in names]


def quantile_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean and exact quantiles with linear interpolation; null without values."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return ranks.side_by_side(sums, ranks.quantiles(df, keys, {"": value}, dict(QUANTILES)), keys)


def threshold_fractions(df: DataFrame, keys: list[str], value: str = "value", thresholds: tuple[tuple[str, str, float], ...] = (("below_5", "<", -5.0), ("below_20", "<", -20.0), ("above_5", ">", 5.0))) -> DataFrame:
    """The share of values beyond each threshold."""
    return df.groupBy(*keys).agg(*(F.avg(((F.col(value) < t) if op == "<" else (F.col(value) > t)).cast("double")).alias(n) for n, op, t in thresholds))


def error_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def decisive_accuracy(actual: Column, predicted: Column) -> Column:
    """Share of equal states among rows whose actual state is not a transition."""
    return F.avg(F.when(actual != 0, (actual == predicted).cast("double")))


def harmonic_errors(df: DataFrame, keys: list[str], period: float = basis.YEAR) -> DataFrame:
    """Errors of amplitude, phase (circular), harmonic vector and trend between actual (a_) and predicted (p_) fits."""
    d = lambda c: F.col(f"p_{c}") - F.col(f"a_{c}")
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(d("amplitude") * d("amplitude"))).alias("amplitude_rmse"), F.avg(basis.circular_distance(d("phase_days"), period)).alias("phase_mae_days"), F.sqrt(F.avg(d("sine") * d("sine") + d("cosine") * d("cosine"))).alias("vector_rmse"), F.sqrt(F.avg(d("rate") * d("rate"))).alias("trend_rmse")
    )


def guarded_pearson(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3, spread: float = 1e-12) -> DataFrame:
    """n and r over rows where both are there; null with too few rows or without spread."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(x).alias("__sx"), F.stddev_pop(y).alias("__sy"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))
    return out.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("__sx") > spread) & (F.col("__sy") > spread), F.col("r")).alias("r"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """n and the correlation of ranks over rows where both are there; ranks as ``ranks.average_ranks``."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return guarded_pearson(ranks.average_ranks(rows, keys, [x, y]), keys, f"rank_{x}", f"rank_{y}", least).withColumnRenamed("r", "spearman_rho")


def mad_zscore(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``df`` with robust_z: 0.6745 (x - median) / MAD, 0 where the MAD is 0 or there is no value at all.

    The medians, a row a key, are written to the shared folder now, so ``df`` is read by eight scans.
    """
    a = ranks.with_groups(df, ranks.stored(ranks.medians(df, keys, {"__m": value})), keys)
    away = F.abs(F.col(value) - F.col("__m"))
    b = ranks.with_groups(a, ranks.medians(a, keys, {"__mad": away}), keys)
    return b.withColumn("robust_z", F.when(F.col("__mad") > 0, ROBUST * (F.col(value) - F.col("__m")) / F.col("__mad")).otherwise(0.0)).drop("__m", "__mad")


def plane_fit(df: DataFrame, keys: list[str], *, x: str = "x", y: str = "y", value: str = "value", least: int = 4) -> DataFrame:
    """keys, plane_r2, plane_peak_to_peak (over the corners of the bounding box) and n of a plane through standardised x, y."""
    there = F.col(value).isNotNull()
    g = df.where(there).groupBy(*keys).agg(*(f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))), F.var_pop(value).alias("__v"))
    rows = df.where(there).join(g, keys) if keys else df.where(there).crossJoin(F.broadcast(g))
    rows = rows.withColumn("__u", (F.col(x) - F.col(f"__m{x}")) / F.col(f"__s{x}")).withColumn("__w", (F.col(y) - F.col(f"__m{y}")) / F.col(f"__s{y}")).withColumn("__c", F.col(value).cast("double"))
    fits = lsq.fit_columns(rows, keys, ["CAST(1 AS DOUBLE)", "__u", "__w"], y="__c", min_obs=least)
    out = fits.join(g, keys) if keys else fits.crossJoin(F.broadcast(g))
    size = F.abs(F.col("beta1")) * (F.col(f"__hi{x}") - F.col(f"__lo{x}")) / F.col(f"__s{x}") + F.abs(F.col("beta2")) * (F.col(f"__hi{y}") - F.col(f"__lo{y}")) / F.col(f"__s{y}")
    return out.select(*keys, "n", F.when(F.col("__v") > 0, 1 - F.col("rss") / F.col("n") / F.col("__v")).alias("plane_r2"), size.alias("plane_peak_to_peak"))


def epoch_scatter(df: DataFrame, *, value: str = "residual", day: str = "day", least: int = 100) -> DataFrame:
    """For each epoch with enough pixels: median residual, 1.4826 MAD, p95 of centred residuals.

    Two columns of ``df`` are written to the shared folder now, and then the epochs' medians, so ``df`` is computed once.
    """
    rows = ranks.stored(df.where(F.col(value).isNotNull()).select(day, value))
    n = rows.groupBy(day).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    middle = ranks.stored(ranks.side_by_side(n, ranks.medians(rows, [day], {"spatial_median": value}), [day]))
    away = F.abs(F.col(value) - F.col("spatial_median"))
    centred = ranks.with_groups(rows, middle, [day]).where("n IS NOT NULL").select(day, away.alias("__d"))
    spread = ranks.quantiles(centred, [day], {"": "__d"}, {"__mad": 0.5, "p95_abs_centered": 0.95})
    out = ranks.side_by_side(middle, spread, [day])
    return out.select(day, "spatial_median", "n", (1.4826 * F.col("__mad")).alias("spatial_robust_sigma"), "p95_abs_centered")


def artifact_ranks(epochs: DataFrame, recent_from: int, *, noise: str = "spatial_robust_sigma", ramp: str = "plane_peak_to_peak", day: str = "day") -> DataFrame:
    """``epochs`` with scene_artifact_score and its ranks among all and among recent epochs (first come first on ties)."""
    middles = epochs.agg(F.median(noise).alias("__m0"), F.median(ramp).alias("__m1"))
    centred = epochs.crossJoin(F.broadcast(middles)).withColumn("__d0", F.col(noise) - F.col("__m0")).withColumn("__d1", F.col(ramp) - F.col("__m1"))
    spreads = centred.agg(F.median(F.abs("__d0")).alias("__k0"), F.median(F.abs("__d1")).alias("__k1"))
    z = [F.when(F.col(f"__k{i}") > 0, ROBUST * F.col(f"__d{i}") / F.col(f"__k{i}")).otherwise(0.0) for i in (0, 1)]
    out = centred.crossJoin(F.broadcast(spreads)).withColumn("scene_artifact_score", classes.artifact_score(*z)).drop("__m0", "__m1", "__d0", "__d1", "__k0", "__k1")
    order = [F.desc("scene_artifact_score"), F.asc(day)]
    recent = F.col(day) >= recent_from
    return out.withColumn("rank_all", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("rank_recent", F.when(recent, F.row_number().over(Window.partitionBy(recent).orderBy(*order))))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def holdout(df: DataFrame, keys: list[str], models: dict[str, TimeModel], first_test_day: int, last_test_day: int, *, min_obs: int = 0) -> DataFrame:
    """keys, n_test and <name>_rmse of each model fitted before the test days, on the test days."""
    train, test = df.where(F.col("day") < first_test_day), df.where(F.col("day").between(first_test_day, last_test_day))
    out = None
    for name, model in models.items():
        r = lsq.residuals(test, lsq.fit(train, keys, model, min_obs=min_obs), keys, model)
        side = r.groupBy(*keys).agg(F.count("residual").alias(f"{name}_n_test"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias(f"{name}_rmse"))
        out = side if out is None else out.join(side, keys)
    return out


def window_rates(df: DataFrame, keys: list[str], windows: list[tuple[str, int, int]], *, min_obs: int = 12) -> DataFrame:
    """keys, window, rate (per year) and rmse of a linear and annual fit in each of a few overlapping windows of days."""
    own = [F.struct(F.lit(n).alias("window"), F.lit(a).alias("origin"), F.lit(b).alias("end")) for n, a, b in windows]
    rows = df.select(*keys, "day", "value", F.explode(F.filter(F.array(*own), lambda w: F.col("day").between(w["origin"], w["end"]))).alias("w")).select(*keys, "w.window", (F.col("day") - F.col("w.origin")).alias("day"), "value")
    fits = lsq.fit(rows, [*keys, "window"], TimeModel(0), min_obs=min_obs)
    return fits.select(*keys, "window", F.col("beta1").alias("rate"), "rmse", "n")


def map_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """later - earlier where both are there."""
    joined = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys)
    return joined.where("__a IS NOT NULL AND __b IS NOT NULL").select(*keys, (F.col("__b") - F.col("__a")).alias("difference"))


def agreement(df: DataFrame, a: str, b: str, threshold: float = 5.0) -> DataFrame:
    """How two rates agree: Pearson r, share of equal states, share of the first's subsidence that the second confirms.

    The pairs of rates are written to the shared folder now, as several scans read them.
    """
    x, y = classes.rate_state(F.col(a), threshold), classes.rate_state(F.col(b), threshold)
    rows = ranks.stored(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b))
    return rows.agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson_r"), F.avg((x == y).cast("double")).alias("state_agreement"), F.avg(F.when(x == 1, (y == 1).cast("double"))).alias("confirmed_subsidence")).crossJoin(F.broadcast(ranks.medians(rows, [], {"median_difference": F.col(b) - F.col(a)})))


def choose_degree(fits: dict[int, DataFrame], sizes: dict[int, int]) -> DataFrame:
    """degree, median_aicc over all series, best first; the scores are written to the shared folder now, as several scans read them."""
    each = [f.select(F.lit(degree).alias("degree"), classes.aicc(F.col("rss"), F.col("n"), sizes[degree]).alias("a")) for degree, f in fits.items()]
    degrees = fits[next(iter(fits))].sparkSession.createDataFrame([(d,) for d in fits], "degree int")
    out = ranks.side_by_side(degrees, ranks.medians(ranks.stored(reduce(DataFrame.unionByName, each)), ["degree"], {"median_aicc": "a"}), ["degree"])
    return out.orderBy(F.asc_nulls_last("median_aicc"), "degree")


def f_test_share(small: DataFrame, large: DataFrame, keys: list[str], k_small: int, k_large: int, alpha: float = 0.05) -> DataFrame:
    """One row: valid series, the share whose larger model is significant, and the degree (2 if over half)."""
    from terrachron.functions.distributions import f_tail_udf

    joined = small.select(*keys, F.col("rss").alias("r1")).join(large.select(*keys, F.col("rss").alias("r2"), "n"), keys)
    f = classes.nested_f(F.col("r1"), F.col("r2"), F.col("n"), k_small, k_large)
    p = joined.select(f_tail_udf(f, F.lit(float(k_large - k_small)), (F.col("n") - k_large).cast("double")).alias("p")).where("p IS NOT NULL")
    return p.agg(F.count("*").alias("n_valid"), F.avg((F.col("p") < alpha).cast("double")).alias("share")).withColumn("degree", F.when(F.col("share") > 0.5, 2).otherwise(1))


def bic_counts(df: DataFrame, delta: str = "delta_bic", threshold: float = 2.0) -> DataFrame:
    """Counts and fractions of preferred models and of evidence."""
    p, e = classes.bic_preferred(F.col(delta)), classes.bic_evidence(F.col(delta), threshold)
    n = F.count(delta)
    named = [("preferred_small", p == 1), ("preferred_large", p == 2), ("evidence_small", e == 1), ("evidence_none", e == 2), ("evidence_large", e == 3)]
    return df.agg(n.alias("n"), *(F.count_if(c).alias(k) for k, c in named), *((F.count_if(c) / n).alias(f"fraction_{k}") for k, c in named))


def recent_rates(df: DataFrame, keys: list[str], since: int, *, min_obs: int = 12) -> DataFrame:
    """keys, recent_rate and rmse of a linear and annual fit of the rows from a day on, apart from any longer fit."""
    f = lsq.fit(df.where(F.col("day") >= since), keys, TimeModel(since), min_obs=min_obs)
    return f.select(*keys, F.col("beta1").alias("recent_rate"), F.col("rmse").alias("recent_rmse"), "n")


def assess(sensitivity: DataFrame, shifts: DataFrame, plane: DataFrame, recurrence: DataFrame, epochs: DataFrame) -> DataFrame:
    """One row: findings for a real signal and for an artefact, and the verdict of a rule of thumb.

    sensitivity: pearson_r, median_difference of each exclusion; shifts: shift_from_full; plane: plane_r2; recurrence:
    r; epochs: rank_recent, scene_artifact_score.
    """
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    stable = (F.col("pearson_r") >= 0.9) & (F.abs("median_difference") <= 5)
    a = sensitivity.agg(count(stable).alias("real_0"), count(F.col("pearson_r") < 0.7).alias("artifact_0"))
    most = F.max(F.abs("shift_from_full"))
    b = shifts.agg((most <= 5).cast("int").alias("real_1"), (most >= 10).cast("int").alias("artifact_1"))
    c = plane.agg(count(F.col("plane_r2") < 0.25).alias("real_2"), count(F.col("plane_r2") > 0.6).alias("artifact_2"))
    d = recurrence.agg(count(F.col("r") >= 0.4).alias("real_3"))
    e = epochs.agg((count((F.col("rank_recent") <= 10) & (F.col("scene_artifact_score") >= 5)) >= 5).cast("int").alias("artifact_4"))
    row = a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)
    real, artifact = (sum((F.coalesce(F.col(n), F.lit(0)) for n in row.columns if n.startswith(k)), F.lit(0)) for k in ("real", "artifact"))
    return row.select(real.alias("real"), artifact.alias("artifact")).withColumn("verdict", classes.verdict(F.col("real"), F.col("artifact")))
