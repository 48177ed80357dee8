"""Masked least squares on additive sums.

A fit of k coefficients needs only the sums of x_i x_j, x_i y, y y and the count, so it is one aggregation with
partial sums before the shuffle. Where the first column is the constant, the sums with y are centred moments
(``covar_pop`` and ``var_pop``, which are merged by their means): a series far from zero would else lose the digits of
its residuals. They are what is left of the plain sums after the constant's Cholesky step. The normal equations are solved by Cholesky steps: up to ``UNROLLED`` coefficients
as columns, within generated code, and beyond by the same steps on arrays of a batch of systems. A fit is valid from
max(min_obs, k + 1) rows on; a singular one (a pivot below 1e-12 of its diagonal) is null, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.functions.basis import TimeModel

UNROLLED = 5


def has_constant(columns: list[str]) -> bool:
    """Whether the first column is the number one."""
    return columns[0].strip("() ").lower() in ("1", "1.0", "1e0", "1.0e0", "cast(1 as double")


def sums_sql(columns: list[str], y: str = "value") -> dict[str, str]:
    """Name to SQL text of the sums over rows where y and the basis are there; columns are SQL texts.

    b are sums with y and yy its square; behind a constant, c and cyy are the same about the means.
    """
    centred = has_constant(columns)
    out = {"n": f"count({y})", "cyy" if centred else "yy": f"var_pop(CAST({y} AS DOUBLE)) * count({y})" if centred else f"sum({y} * {y})"}
    for i, x in enumerate(columns):
        out[f"c{i}" if centred and i else f"b{i}"] = f"covar_pop({x}, CAST({y} AS DOUBLE)) * count({y})" if centred and i else f"sum(({x}) * {y})"
        for j in range(i + 1):
            out[f"g{i}_{j}"] = f"sum(CASE WHEN {y} IS NOT NULL THEN ({x}) * ({columns[j]}) END)"
    return out


def steps_sql(k: int, min_obs: int, prefix: str = "", at: list[int] | None = None, *, centred: bool = True) -> list[list[tuple[str, str]]]:
    """Levels of (name, SQL text): Cholesky factor, substitutions, rss, rmse. A level uses the levels before it only.

    ``at`` are the places of the k columns among those whose sums there are (all, in order, without it); names get the
    prefix. ``centred``: the sums are those behind a constant, which is the first column here too.
    """
    least = 1 if centred else 0  # the first of the columns whose sums with y still hold the others' parts
    valid, p, at = f"n >= {max(min_obs, k + 1)}", prefix, at or list(range(k))
    g = lambda i, j: f"g{max(at[i], at[j])}_{min(at[i], at[j])}"
    levels: list[list[tuple[str, str]]] = []
    for j in range(k):
        pivot = " - ".join([g(j, j), *(f"{p}l{j}_{m} * {p}l{j}_{m}" for m in range(j))])
        levels.append([(f"{p}l{j}_{j}", f"CASE WHEN {valid} AND {pivot} > 1e-12 * {g(j, j)} THEN sqrt({pivot}) END")])
        if j + 1 < k:
            levels.append([(f"{p}l{i}_{j}", f"({' - '.join([g(i, j), *(f'{p}l{i}_{m} * {p}l{j}_{m}' for m in range(j))])}) / {p}l{j}_{j}") for i in range(j + 1, k)])
    for i in range(k):
        own = f"c{at[i]}" if centred and i else f"b{at[i]}"
        levels.append([(f"{p}z{i}", f"({' - '.join([own, *(f'{p}l{i}_{m} * {p}z{m}' for m in range(least, i))])}) / {p}l{i}_{i}")])
    for i in reversed(range(k)):
        levels.append([(f"{p}beta{i}", f"({' - '.join([f'{p}z{i}', *(f'{p}l{m}_{i} * {p}beta{m}' for m in range(i + 1, k))])}) / {p}l{i}_{i}")])
    levels.append([(f"{p}rest", " - ".join(["cyy" if centred else "yy", *(f"{p}z{i} * {p}z{i}" for i in range(least, k))]))])
    levels.append([(f"{p}rss", f"CASE WHEN {p}rest > 0 THEN {p}rest WHEN {p}rest <= 0 THEN CAST(0 AS DOUBLE) END")])
    levels.append([(f"{p}rmse", f"sqrt({p}rss / n)")])
    return levels


def gram(df: DataFrame, keys: list[str], columns: list[str], y: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(*(F.expr(e).alias(n) for n, e in sums_sql(columns, y).items()))


def solve(sums: DataFrame, keys: list[str], k: int, min_obs: int = 0) -> DataFrame:
    """keys, beta0.., n, rss, rmse from the sums of ``gram``."""
    names = [*keys, *(f"beta{i}" for i in range(k)), "n", "rss", "rmse"]
    if k > UNROLLED:
        return solve_batches(sums, keys, k, min_obs).select(*names)
    for level in steps_sql(k, min_obs, centred="cyy" in sums.columns):
        sums = sums.select("*", *(F.expr(e).alias(n) for n, e in level))
    # a generator is a barrier: filters on the results would else be pushed down with every step written out
    return sums.select(*keys, F.inline(F.array(F.struct(*names[len(keys) :]))))


def cholesky_batch(G: np.ndarray, b: np.ndarray, yy: np.ndarray, ok: np.ndarray, *, centred: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and rss of systems (r x k x k, r x k) that are ``ok``, all at once by the steps of ``steps_sql``; NaN for others."""
    least = 1 if centred else 0
    k, L = b.shape[1], np.zeros_like(G)
    z, beta, ok = np.zeros_like(b), np.zeros_like(b), ok.copy()
    for j in range(k):
        pivot = G[:, j, j] - (L[:, j, :j] ** 2).sum(axis=1)
        ok &= pivot > 1e-12 * G[:, j, j]
        L[:, j, j] = np.sqrt(np.where(ok, pivot, 1.0))
        L[:, j + 1 :, j] = (G[:, j + 1 :, j] - np.einsum("rim,rm->ri", L[:, j + 1 :, :j], L[:, j, :j])) / L[:, j, j, None]
    for i in range(k):
        z[:, i] = (b[:, i] - (L[:, i, least:i] * z[:, least:i]).sum(axis=1)) / L[:, i, i]
    for i in reversed(range(k)):
        beta[:, i] = (z[:, i] - (L[:, i + 1 :, i] * beta[:, i + 1 :]).sum(axis=1)) / L[:, i, i]
    beta[~ok] = np.nan
    return beta, np.where(ok, np.maximum(yy - (z[:, least:] ** 2).sum(axis=1), 0), np.nan)


def solve_batches(sums: DataFrame, keys: list[str], k: int, min_obs: int = 0) -> DataFrame:
    """The same for any k, one batch of systems at a time."""
    least, centred = max(min_obs, k + 1), "cyy" in sums.columns
    fields = ", ".join([*(f"`{c}` {t}" for c, t in sums.dtypes if c in keys), *(f"beta{i} double" for i in range(k)), "n long", "rss double", "rmse double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[keys].copy()
            n, b, yy = f["n"].to_numpy(), f[[f"c{i}" if centred and i else f"b{i}" for i in range(k)]].to_numpy(float), f["cyy" if centred else "yy"].to_numpy(float)
            G = np.empty((len(f), k, k))
            for i in range(k):
                for j in range(i + 1):
                    G[:, i, j] = G[:, j, i] = f[f"g{i}_{j}"].to_numpy(float)
            beta, rss = cholesky_batch(G, b, yy, (n >= least) & np.isfinite(b).all(axis=1) & np.isfinite(G).all(axis=(1, 2)), centred=centred)
            for i in range(k):
                out[f"beta{i}"] = beta[:, i]
            out["n"], out["rss"], out["rmse"] = n, rss, np.sqrt(rss / np.maximum(n, 1))
            yield out.astype(object).where(out.notna(), None)

    return sums.mapInPandas(run, fields)


def fit(df: DataFrame, keys: list[str], model: TimeModel, *, y: str = "value", day: str = "day", min_obs: int = 0) -> DataFrame:
    """One fit a key. Rows with a null value or day don't count; a key without enough rows gets null coefficients."""
    return solve(gram(df.where(F.col(day).isNotNull()), keys, list(model.columns(day).values()), y), keys, model.size, min_obs)


def fit_nested(df: DataFrame, keys: list[str], large: TimeModel, small: TimeModel, *, y: str = "value", day: str = "day", min_obs: int = 0) -> DataFrame:
    """``fit`` of a model and, as small_beta0.., small_rss and small_rmse, of one whose columns are among its own: one aggregation for both."""
    columns, own = list(large.columns(day).values()), list(small.columns(day).values())
    at = [columns.index(c) for c in own]
    sums = gram(df.where(F.col(day).isNotNull()), keys, columns, y)
    for level in [*steps_sql(large.size, min_obs), *steps_sql(small.size, min_obs, "small_", at)]:
        sums = sums.select("*", *(F.expr(e).alias(n) for n, e in level))
    names = [*(f"beta{i}" for i in range(large.size)), "n", "rss", "rmse", *(f"small_beta{i}" for i in range(small.size)), "small_rss", "small_rmse"]
    return sums.select(*keys, F.inline(F.array(F.struct(*names))))


def fit_columns(df: DataFrame, keys: list[str], columns: list[str], *, y: str = "value", min_obs: int = 0) -> DataFrame:
    """The same for any basis given as SQL texts, for example a plane in x and y."""
    return solve(gram(df, keys, columns, y), keys, len(columns), min_obs)


def residuals(df: DataFrame, fits: DataFrame, keys: list[str], model: TimeModel, *, y: str = "value", day: str = "day") -> DataFrame:
    """``df`` with fitted and residual of each row."""
    value = sum((F.col(f"beta{i}") * F.expr(e) for i, e in enumerate(model.columns(day).values())), F.lit(0.0))
    joined = df.join(fits.select(*keys, *(f"beta{i}" for i in range(model.size))), keys).withColumn("fitted", value)
    return joined.withColumn("residual", F.col(y) - F.col("fitted")).drop(*(f"beta{i}" for i in range(model.size)))


def low_frequency_change(model: TimeModel, start: float, end: float) -> Column:
    """Change of the fit without its periodic part between two days."""
    a, b = model.low_frequency(start), model.low_frequency(end)
    return sum((F.col(f"beta{i}") * (y - x) for i, (x, y) in enumerate(zip(a, b, strict=True)) if y != x), F.lit(0.0))


def packed_fit(df: DataFrame, key: str, series: str, days: list[int], model: TimeModel, *, min_obs: int = 0) -> DataFrame:
    """Fits of packed series (an array of values for each key, in the order of ``days``), without a shuffle.

    Series of a batch that miss the same epochs share one pseudo-inverse. Nulls and NaN are missing. Columns: key,
    beta array<double>, rmse, n, rss; coefficients are null where there are too few values.
    """
    k, X = model.size, model.matrix(days)
    least = max(min_obs, k + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            Y = np.array([[np.nan if v is None else v for v in s] for s in f[series]], float).reshape(len(f), len(days))
            there = np.isfinite(Y)
            patterns, group = np.unique(np.packbits(there, axis=1), axis=0, return_inverse=True)
            beta, rss, n = np.full((len(f), k), np.nan), np.full(len(f), np.nan), there.sum(axis=1)
            for p in range(len(patterns)):
                rows = np.flatnonzero(group.ravel() == p)
                mask = there[rows[0]]
                if mask.sum() >= least:
                    y = Y[np.ix_(rows, np.flatnonzero(mask))]
                    beta[rows] = y @ np.linalg.pinv(X[mask]).T
                    rss[rows] = ((y - beta[rows] @ X[mask].T) ** 2).sum(axis=1)
            yield pd.DataFrame({key: f[key], "beta": [None if np.isnan(b).any() else b for b in beta], "rmse": np.sqrt(rss / np.maximum(n, 1)), "n": n, "rss": rss})

    kind = dict(df.dtypes)[key]
    return df.select(key, series).mapInPandas(run, f"`{key}` {kind}, beta array<double>, rmse double, n long, rss double")


def packed_holdout(df: DataFrame, key: str, series: str, days: list[int], model: TimeModel, first_test_day: int, *, min_obs: int = 0) -> DataFrame:
    """key, n_test, rmse: packed series fitted before a day and predicted from it on, without a shuffle.

    Series that miss the same training epochs share one prediction matrix; missing test values don't count.
    """
    X, before = model.matrix(days), np.asarray(days) < first_test_day
    least = max(min_obs, model.size + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            Y = np.array([[np.nan if v is None else v for v in s] for s in f[series]], float).reshape(len(f), len(days))
            there = np.isfinite(Y)
            patterns, group = np.unique(np.packbits(there[:, before], axis=1), axis=0, return_inverse=True)
            error = np.full((len(f), int((~before).sum())), np.nan)
            for p in range(len(patterns)):
                rows = np.flatnonzero(group.ravel() == p)
                mask = before & there[rows[0]]
                if mask.sum() >= least:
                    hat = X[~before] @ np.linalg.pinv(X[mask])
                    error[rows] = Y[np.ix_(rows, np.flatnonzero(~before))] - Y[np.ix_(rows, np.flatnonzero(mask))] @ hat.T
            n = np.isfinite(error).sum(axis=1)
            rmse = np.sqrt(np.nansum(error**2, axis=1) / np.maximum(n, 1))
            yield pd.DataFrame({key: f[key], "n_test": n, "rmse": [None if m == 0 else v for m, v in zip(n, rmse, strict=True)]})

    return df.select(key, series).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, n_test long, rmse double")
