"""Missing values: NaN becomes null at every source, so that comparisons with missing values are never true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def nodata_to_null(c: Column | str, nodata: float) -> Column:
    return F.nullif(nan_to_null(c), F.lit(nodata))


def clean(df: DataFrame) -> DataFrame:
    """Every float and double column with NaN as null."""
    return df.select(*(nan_to_null(n).alias(n) if t in ("float", "double") else F.col(n) for n, t in df.dtypes))


def guarded_div(a: Column, b: Column, least: float = 0.0) -> Column:
    """a / b, null where |b| <= least."""
    return F.when(F.abs(b) > least, a / b)


def true(c: Column) -> Column:
    """A condition on missing values is false."""
    return F.coalesce(c, F.lit(False))
