"""The upper tail of the F distribution, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny, c = 1e-300, np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    log = np.vectorize(lgamma)
    y = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1) / (a + b + 2)
    out = np.where(low, front * _fraction(a, b, y) / a, 1 - front * _fraction(b, a, 1 - y) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def f_tail(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0)))


@F.pandas_udf(DoubleType())
def f_tail_udf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    ok = f.notna() & df1.notna() & df2.notna() & (df2 > 0)
    out = pd.Series(np.full(len(f), np.nan))
    if ok.any():
        out[ok] = f_tail(f[ok].to_numpy(), df1[ok].to_numpy(), df2[ok].to_numpy())
    return out.astype("object").where(ok, None)
