"""Linear time bases as SQL text that Spark and any SQL engine read: polynomial, hinges, harmonics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.2425


def number(x: float) -> str:
    """A double as SQL text; without an exponent it would be a decimal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


@dataclass(frozen=True)
class TimeModel:
    """Intercept and powers of t, hinges max(0, t - knot), sine and cosine of each period (days); t in years since ``origin`` (a day)."""

    origin: int
    degree: int = 1
    periods: tuple[float, ...] = (YEAR,)
    knots: tuple[int, ...] = field(default=())

    def t(self, day: str = "day") -> str:
        return f"(({day} - {self.origin}) / {number(YEAR)})"

    def columns(self, day: str = "day") -> dict[str, str]:
        """Name to SQL text, in coefficient order."""
        t, out = self.t(day), {"c0": "CAST(1 AS DOUBLE)"}
        for k in range(1, self.degree + 1):
            out[f"t{k}"] = " * ".join([t] * k)
        for i, knot in enumerate(self.knots):
            out[f"h{i}"] = f"greatest(CAST(0 AS DOUBLE), {t} - {number((knot - self.origin) / YEAR)})"
        for i, period in enumerate(self.periods):
            angle = f"(2 * pi() * ({day} - {self.origin}) / {number(period)})"
            out[f"s{i}"], out[f"q{i}"] = f"sin({angle})", f"cos({angle})"
        return out

    def matrix(self, days: Sequence[float]) -> np.ndarray:
        """The design matrix at some days, columns in coefficient order."""
        d = np.asarray(days, float)
        t = (d - self.origin) / YEAR
        waves = [g(2 * np.pi * (d - self.origin) / p) for p in self.periods for g in (np.sin, np.cos)]
        return np.column_stack([*(t**k for k in range(self.degree + 1)), *(np.maximum(0, t - (k - self.origin) / YEAR) for k in self.knots), *waves])

    @property
    def size(self) -> int:
        return 1 + self.degree + len(self.knots) + 2 * len(self.periods)

    def index(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.columns())}

    def low_frequency(self, day: float) -> list[float]:
        """The basis at a day with the periodic columns at zero."""
        t = (day - self.origin) / YEAR
        return [t**k for k in range(self.degree + 1)] + [max(0.0, t - (k - self.origin) / YEAR) for k in self.knots] + [0.0] * (2 * len(self.periods))


def day_number(c: Column | str) -> Column:
    return F.unix_date(F.to_date(c))


def decimal_years(day: Column, origin: int) -> Column:
    return (day - F.lit(origin)) / F.lit(YEAR)


def year_knots(start: int, end: int) -> tuple[int, ...]:
    """The days of January 1 strictly between two days."""
    epoch = date(1970, 1, 1).toordinal()
    first, last = date.fromordinal(epoch + start).year, date.fromordinal(epoch + end).year
    days = [date(y, 1, 1).toordinal() - epoch for y in range(first, last + 1)]
    return tuple(d for d in days if start < d < end)


def polynomial(t: Column, *coefficients: Column) -> Column:
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def amplitude(s: Column, c: Column) -> Column:
    return F.hypot(s, c)


def phase_days(s: Column, c: Column, period: float = YEAR) -> Column:
    """Day of the maximum after the origin, in [0, period)."""
    return F.pmod(F.atan2(s, c) * F.lit(period) / (2 * F.pi()), F.lit(period))


def rotate(s: Column, c: Column, lag: Column, period: float = YEAR) -> tuple[Column, Column]:
    """Sine and cosine coefficients of the same wave, ``lag`` days later."""
    a = 2 * F.pi() * lag / F.lit(period)
    return s * F.cos(a) + c * F.sin(a), c * F.cos(a) - s * F.sin(a)


def circular_distance(d: Column, period: float = YEAR) -> Column:
    m = F.pmod(F.abs(d), F.lit(period))
    return F.least(m, F.lit(period) - m)


def anniversary(d: Column, years: int = 1) -> Column:
    """Same month and day; February 29 becomes 28."""
    return F.add_months(d, 12 * years)
