"""Scores and rule tables of model choice and trajectories, as CASE expressions with the highest rule first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrachron.functions.nulls import true

TINY = 2.2250738585072014e-308
#: The classes and their labels.
DEFORMATION = {0: "complex_or_uncertain", 1: "stable_or_weak_deformation", 2: "persistent_subsidence", 3: "accelerating_subsidence", 4: "decelerating_subsidence", 5: "subsidence_to_rebound"}
GROUNDWATER = {0: "uncertain_or_transition", 1: "head_decline", 2: "quasi_stable", 3: "head_recovery"}
COUPLED = {
    0: "complex_or_uncertain",
    1: "persistent_head_decline_with_subsidence",
    2: "recovery_responsive",
    3: "post_recovery_persistent_subsidence",
    4: "post_recovery_reaccelerating_subsidence",
    5: "renewed_head_decline_with_reaccelerating_subsidence",
    6: "quasi_stable",
}


def cases(*rules: tuple[Column, object], otherwise: object = 0) -> Column:
    """The value of the first rule that is true; unknown conditions are not."""
    return reduce(lambda rest, rule: F.when(true(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(otherwise))


def known(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def bic(rss: Column, n: Column, k: int) -> Column:
    return F.when(n > k, n * F.ln(F.greatest(rss / n, F.lit(TINY))) + k * F.ln(n))


def aicc(rss: Column, n: Column, k: int) -> Column:
    return F.when(n > k + 1, n * F.ln(F.greatest(rss / n, F.lit(TINY))) + 2 * k + F.lit(2.0 * k * (k + 1)) / (n - k - 1))


def nested_f(rss_small: Column, rss_large: Column, n: Column, k_small: int, k_large: int) -> Column:
    return F.when((n > k_large) & (rss_large > 0), (F.greatest(rss_small - rss_large, F.lit(0.0)) / (k_large - k_small)) / (rss_large / (n - k_large)))


def bic_preferred(delta: Column) -> Column:
    """2 where the larger model has the lower score, 1 where not, 0 where unknown."""
    return cases((delta > 0, 2), (delta <= 0, 1))


def bic_evidence(delta: Column, threshold: float = 2.0) -> Column:
    return cases((delta >= threshold, 3), (F.abs(delta) < threshold, 2), (delta <= -threshold, 1))


def rate_state(x: Column, threshold: float) -> Column:
    return cases((x > threshold, 3), (F.abs(x) <= threshold, 2), (x < -threshold, 1))


def deformation_class(early: Column, late: Column, change: Column | None = None, stable: Column | float = 5.0, meaningful: Column | float = 5.0) -> Column:
    s, c = (x if isinstance(x, Column) else F.lit(x) for x in (stable, meaningful))
    change = late - early if change is None else change
    rules = cases(
        ((early < -s) & (late >= -s), 5),
        ((early < -s) & (late < -s) & (change >= c), 4),
        ((late < -s) & (change <= -c), 3),
        (late < -s, 2),
        ((F.abs(early) <= s) & (F.abs(late) <= s), 1),
    )
    return F.when(known(early, late, change), rules).otherwise(0)


def groundwater_state(h: Column, stable: Column | float = 0.5, meaningful: Column | float = 1.0) -> Column:
    s, m = (x if isinstance(x, Column) else F.lit(x) for x in (stable, meaningful))
    return cases((h > m, 3), (F.abs(h) <= s, 2), (h < -m, 1))


def coupled_class(recovery: Column, recent: Column, declines: Column, mode: Column, late: Column, change: Column, *, least_declines: int = 2, stable_rate: Column | float = 5.0, meaningful_rate: Column | float = 5.0, stable_head: Column | float = 0.5, meaningful_head: Column | float = 1.0) -> Column:
    stable_rate, meaningful_rate = (x if isinstance(x, Column) else F.lit(x) for x in (stable_rate, meaningful_rate))
    R, D, S, A = true(recovery > meaningful_head), true(declines >= least_declines), true(late < -stable_rate), true(change <= -meaningful_rate)
    M, Q = true(mode.isin(4, 5)), true((F.abs(recent) <= stable_head) & (F.abs(late) <= stable_rate))
    rules = cases((Q, 6), (R & D & S & A, 5), (R & ~D & S & A, 4), (R & S & ~A & ~(R & M & ~A), 3), (R & M & ~A, 2), (~R & D & S, 1))
    return F.when(known(recovery, recent, declines, late, change), rules).otherwise(0)


def derivatives(b: Column, a: Column, duration: float, guard: float = 1e-4) -> dict[str, Column]:
    """What a quadratic's rate b and curvature a say over ``duration`` years: rates at both ends, change, vertex and a bounded vertex as a feature."""
    vertex = F.when(F.abs(a) > 1e-12, -b / (2 * a))
    late = F.when(b < 0, F.lit(2.0 * duration)).otherwise(F.lit(-float(duration)))  # without curvature: never
    return {
        "start_rate": b, "end_rate": b + 2 * a * duration, "rate_change": 2 * a * duration, "acceleration": 2 * a,
        "vertex_years": F.when(F.abs(a) > guard, vertex),
        "vertex_feature": F.coalesce(F.least(F.greatest(vertex, F.lit(-float(duration))), F.lit(2.0 * duration)), late),
    }


def regime_label(start: Column, end: Column, stable: float = 5.0, change: float = 5.0) -> Column:
    return cases(
        ((start < -stable) & (end > stable), "subsidence_to_rebound"),
        ((start > stable) & (end > stable), "persistent_uplift"),
        (F.abs(end) <= stable, "stable"),
        ((end < -stable) & (end - start > change), "reduced_subsidence"),
        otherwise="continuous_subsidence",
    )


def clay_fraction(sand: Column, clay: Column) -> Column:
    return F.when(sand + clay > 0, clay / (sand + clay))


def artifact_score(noise: Column, ramp: Column) -> Column:
    return F.hypot(F.greatest(noise, F.lit(0.0)), F.greatest(ramp, F.lit(0.0)))


def verdict(real: Column, artifact: Column) -> Column:
    """A rule of thumb on the numbers of findings that speak for a real signal and for an artefact."""
    return cases(((artifact == 0) & (real >= 3), "persistent_signal"), (artifact >= 2, "unresolved_quality_sensitive"), otherwise="mixed_evidence")
