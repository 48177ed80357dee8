"""Joint harmonics of two variables, the search for a lag, and ratios with their masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.functions.basis import YEAR, TimeModel, amplitude, phase_days, rotate
from terrachron.operators import lsq

LEAST_NORM = 1e-12


def harmonics(df: DataFrame, keys: list[str], model: TimeModel, *, min_obs: int = 24) -> DataFrame:
    """keys, sine, cosine, amplitude, phase_days, end_rate (per year, of a polynomial without hinges), rmse, n."""
    at = model.index()
    fits = lsq.fit(df, keys, model, min_obs=min_obs)
    s, c = F.col(f"beta{at['s0']}"), F.col(f"beta{at['q0']}")
    return fits.select(*keys, s.alias("sine"), c.alias("cosine"), amplitude(s, c).alias("amplitude"), phase_days(s, c, model.periods[0]).alias("phase_days"), F.col("beta1").alias("rate"), "rmse", "rss", "n")


def joint(displacement: DataFrame, head: DataFrame, keys: list[str], displacement_model: TimeModel, head_model: TimeModel, *, min_obs: int = 24) -> DataFrame:
    """Fits of both variables over the days that they share: d_ and h_ columns."""
    both = displacement.select(*keys, "day", F.col("value").alias("d")).join(head.select(*keys, "day", F.col("value").alias("h")), [*keys, "day"])
    sides = []
    for name, model in (("d", displacement_model), ("h", head_model)):
        f = harmonics(both.select(*keys, "day", F.col(name).alias("value")), keys, model, min_obs=min_obs)
        sides.append(f.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in f.columns if c not in keys)))
    return sides[0].join(sides[1], keys)


def weight(extra_head_sigma: float = 0.0) -> Column:
    """Amplitudes' product, damped by their relative errors."""
    sigma = F.sqrt(F.pow(F.col("h_rmse"), 2) + extra_head_sigma**2)
    return F.col("d_amplitude") * F.col("h_amplitude") / (1 + F.pow(F.col("d_rmse") / F.col("d_amplitude"), 2) + F.pow(sigma / F.col("h_amplitude"), 2))


def valid(min_d: float = 0.5, min_h: float = 0.2) -> Column:
    return (F.col("d_amplitude") >= min_d) & (F.col("h_amplitude") >= min_h)


def cosine_and_scale(lag: Column, period: float = YEAR) -> tuple[Column, Column]:
    """Cosine between displacement and the lagged head, and the least-squares ratio (displacement in m)."""
    s, c = rotate(F.col("h_sine"), F.col("h_cosine"), lag, period)
    dot = F.col("d_sine") * s + F.col("d_cosine") * c
    norm = F.hypot(F.col("d_sine"), F.col("d_cosine")) * F.hypot(s, c)
    return dot / F.greatest(norm, F.lit(LEAST_NORM)), dot / 1000 / F.greatest(s * s + c * c, F.lit(LEAST_NORM))


def lag_scan(joined: DataFrame, *, start: float = 0.0, stop: float = 180.0, step: float = 0.5, min_d: float = 0.5, min_h: float = 0.2, extra_head_sigma: float = 0.0, period: float = YEAR) -> DataFrame:
    """lag_days, weighted_cosine_similarity for every lag; the cosine is linear in sums, so pixels are read once.

    cos(lag) = (a cos L + b sin L) with a and b the weighted sums of the in-phase and quadrature parts of the unit vectors.
    """
    w = weight(extra_head_sigma)
    d, h = F.hypot("d_sine", "d_cosine"), F.hypot("h_sine", "h_cosine")
    norm = F.greatest(d * h, F.lit(LEAST_NORM))
    along = (F.col("d_sine") * F.col("h_sine") + F.col("d_cosine") * F.col("h_cosine")) / norm
    across = (F.col("d_sine") * F.col("h_cosine") - F.col("d_cosine") * F.col("h_sine")) / norm
    sums = joined.where(valid(min_d, min_h)).agg(F.sum(w * along).alias("a"), F.sum(w * across).alias("b"), F.sum(w).alias("w"))
    n = int(round((stop - start) / step)) + 1
    lags = joined.sparkSession.range(n).select((F.lit(start) + F.col("id") * step).alias("lag_days"))
    angle = 2 * F.pi() * F.col("lag_days") / F.lit(period)
    return lags.crossJoin(F.broadcast(sums)).select("lag_days", ((F.col("a") * F.cos(angle) + F.col("b") * F.sin(angle)) / F.col("w")).alias("weighted_cosine_similarity"))


def best_lag(scan: DataFrame) -> DataFrame:
    """The lag of the highest similarity, the first among equals."""
    return scan.agg(F.max_by("lag_days", F.struct("weighted_cosine_similarity", -F.col("lag_days"))).alias("lag_days"), F.max("weighted_cosine_similarity").alias("weighted_cosine_similarity"))


def phase_lag(period: float = YEAR) -> Column:
    """How many days displacement follows head."""
    return F.pmod(F.col("d_phase_days") - F.col("h_phase_days"), F.lit(period))


def ratios(joined: DataFrame, lag: float | Column, *, low: float = 0.0, high: float = 0.05, min_cosine: float = 0.0, high_cosine: float = 0.7, min_d: float = 0.5, min_h: float = 0.2, period: float = YEAR) -> DataFrame:
    """``joined`` with cosine, ratio, base, support and high_confidence (each within the one before)."""
    cosine, ratio = cosine_and_scale(lag if isinstance(lag, Column) else F.lit(lag), period)
    out = joined.withColumn("cosine", cosine).withColumn("ratio", ratio)
    base = F.coalesce(valid(min_d, min_h) & (F.col("cosine") > min_cosine), F.lit(False))
    out = out.withColumn("base", base).withColumn("support", F.col("base") & F.col("ratio").between(low, high))
    return out.withColumn("high_confidence", F.col("support") & (F.col("cosine") >= high_cosine))
