"""Pieces of the oracle SQL: the same adapters and least-squares steps as text for another engine."""

from __future__ import annotations

from terrachron.functions.basis import TimeModel
from terrachron.operators.lsq import has_constant, steps_sql, sums_sql

DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"
SERIES = f"SELECT l_suppkey AS series_id, {DAY.format('l_shipdate')} AS day, CAST(l_shipdate AS DATE) AS date, l_extendedprice / 1000 AS value FROM lineitem"
HEADS = f"SELECT l_suppkey AS series_id, {DAY.format('l_shipdate')} AS day, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS value FROM lineitem"


def rounded(text: str, digits: int = 6) -> str:
    return f"round({text}, {digits}) + 0.0"


def fit_sql(source: str, keys: list[str], columns: list[str], min_obs: int = 0, y: str = "value") -> str:
    """SELECT with keys, sums, factors, beta0.., n, rss, rmse."""
    names = ", ".join(keys)
    sums = ", ".join(f"{e} AS {n}" for n, e in sums_sql(columns, y).items())
    text = f"SELECT {names + ', ' if keys else ''}{sums} FROM ({source}){' GROUP BY ' + names if keys else ''}"
    for level in steps_sql(len(columns), min_obs, centred=has_constant(columns)):
        text = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in level)} FROM ({text})"
    return text


def model_sql(source: str, keys: list[str], model: TimeModel, min_obs: int = 0) -> str:
    return fit_sql(source, keys, list(model.columns().values()), min_obs)


def harmonics_sql(source: str, keys: list[str], model: TimeModel, min_obs: int = 24) -> str:
    at, p = model.index(), model.periods[0]
    s, q = f"beta{at['s0']}", f"beta{at['q0']}"
    phase = f"(((atan2({s}, {q}) * {p!r} / (2 * pi())) % {p!r}) + {p!r}) % {p!r}"
    return f"SELECT {', '.join(keys)}, {s} AS sine, {q} AS cosine, sqrt({s} * {s} + {q} * {q}) AS amplitude, {phase} AS phase_days, beta1 AS rate, rmse, rss, n FROM ({model_sql(source, keys, model, min_obs)})"


def bic_sql(rss: str, n: str, k: int) -> str:
    return f"CASE WHEN {n} > {k} THEN {n} * ln(greatest({rss} / {n}, 2.2250738585072014e-308)) + {k} * ln({n}) END"


def aicc_sql(rss: str, n: str, k: int) -> str:
    return f"CASE WHEN {n} > {k + 1} THEN {n} * ln(greatest({rss} / {n}, 2.2250738585072014e-308)) + {2 * k} + CAST({2 * k * (k + 1)} AS DOUBLE) / ({n} - {k + 1}) END"


def deformation_sql(early: str, late: str, change: str, s: str = "5", c: str = "5") -> str:
    return (
        f"CASE WHEN {early} IS NULL OR {late} IS NULL OR {change} IS NULL THEN 0 WHEN {early} < -{s} AND {late} >= -{s} THEN 5 WHEN {early} < -{s} AND {late} < -{s} AND {change} >= {c} THEN 4 "
        f"WHEN {late} < -{s} AND {change} <= -{c} THEN 3 WHEN {late} < -{s} THEN 2 WHEN abs({early}) <= {s} AND abs({late}) <= {s} THEN 1 ELSE 0 END"
    )


def state_sql(h: str, s: str = "0.5", m: str = "1.0") -> str:
    return f"CASE WHEN {h} > {m} THEN 3 WHEN abs({h}) <= {s} THEN 2 WHEN {h} < -{m} THEN 1 ELSE 0 END"
