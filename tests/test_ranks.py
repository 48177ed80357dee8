"""Quantiles and ranks by digits against numpy, pandas and the bits of doubles."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrachron.operators import diagnostics, ranks


def test_longs_are_those_of_ieee(spark):
    rng = np.random.default_rng(3)
    raw = np.frombuffer(rng.bytes(8 * 4000), dtype="<f8")
    powers = [s * math.ldexp(m, e) for e in range(-1074, 1024, 7) for m in (1.0, 1 + 2**-52, 2 - 2**-52) for s in (1, -1) if abs(m * 0.5) and e < 1023]
    edges = [0.0, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), math.nextafter(math.inf, 0), math.inf, -math.inf, 8.0, math.nextafter(8.0, 0)]
    values = [float(v) for v in raw if not math.isnan(v)] + powers + edges
    want = [(u if v >= 0 and math.copysign(1, v) > 0 else -(u & (2**63 - 1))) for v in values for u in struct.unpack("<Q", struct.pack("<d", v))]
    got = ranks.sortable(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", "b").orderBy("i").collect()
    assert [r["b"] for r in got] == want
    nan = ranks.sortable(spark.createDataFrame([(math.nan,)], "v double"), "v", "b").first()["b"]
    assert nan > ranks.INFINITE
    ends = spark.createDataFrame([(math.inf,), (None,), (1.0,)], "v double")
    assert {(r["v"], r["rank_v"]) for r in ranks.average_ranks(ends, [], ["v"]).collect()} == {(1.0, 1.0), (math.inf, 2.0), (None, None)}


@pytest.mark.parametrize("most", [0, ranks.BROADCAST_ROWS])
def test_quantiles_by_key(spark, most):
    """A key with most rows, ties, a key of one row, a null key, nulls, no rows at all; by both ways."""
    rng = np.random.default_rng(5)
    parts = {"hot": 1 + rng.normal(size=4000) * 1e-9, "ties": np.repeat([-1.0, 0.0, 2.5], [50, 900, 50]), "one": np.array([7.0]), None: rng.integers(-3, 3, 101).astype(float)}
    rows = [(k, float(v), float(-v)) for k, vs in parts.items() for v in vs] + [("hot", None, None), ("empty", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    qs = {"_low": 0.0, "_p10": 0.1, "_mid": 0.5, "_p98": 0.98, "_high": 1.0}
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], {"a": "a", "b": F.col("b")}, qs, most=most).collect()}
    assert set(got) == {*parts, "empty"}
    for k, vs in parts.items():
        for name, sign in (("a", 1), ("b", -1)):
            assert np.allclose([got[k][name + n] for n in qs], np.quantile(sign * vs, list(qs.values())), rtol=1e-14, atol=0), k
    assert got["empty"]["a_mid"] is None and got["empty"]["b_mid"] == 1.0
    assert ranks.medians(df.limit(0), ["k"], {"m": "a"}).count() == 0
    whole = ranks.medians(df, [], {"m": "a"}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.median(np.concatenate(list(parts.values()))), rel=1e-14)
    assert [tuple(r) for r in ranks.medians(df.limit(0), [], {"m": "a"}).collect()] == [(None,)]


def test_ends_of_the_scale(spark):
    """Infinite values, NaN above them, both zeros as one."""
    df = spark.createDataFrame([(v,) for v in (-math.inf, -0.0, 0.0, math.inf, math.nan)], "v double")
    r = ranks.quantiles(df, [], {"": "v"}, {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}).first()
    assert r["a"] == -math.inf and r["b"] == r["c"] == 0.0 and r["d"] == math.inf and math.isnan(r["e"])


def test_three_scans_and_no_values_in_windows(spark, tmp_path):
    """All quantiles of all keys read the input three times, and no plan has a percentile or collects values."""
    spark.range(5000).select((F.col("id") % 7).alias("k"), F.sqrt("id").alias("value")).write.parquet(str(tmp_path / "t"))
    out = diagnostics.quantile_summary(spark.read.parquet(str(tmp_path / "t")), ["k"])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation") <= 4 and "percentile" not in text and "collect_list" not in text


def test_ranks_with_ties_and_nulls(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 900), "a": rng.integers(0, 40, 900) / 7.0, "b": rng.normal(size=900), "id": range(900)})
    pdf.loc[pdf.index % 11 == 0, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    got = ranks.average_ranks(df, ["k"], ["a", "b"]).orderBy("id").toPandas()
    assert len(got) == 900
    for c in "ab":
        assert np.allclose(got[f"rank_{c}"], pdf.groupby("k")[c].rank(), equal_nan=True)
    rho = {r["k"]: r["spearman_rho"] for r in diagnostics.spearman(df, ["k"], "a", "b").collect()}
    for k, part in pdf.dropna().groupby("k"):
        assert rho[k] == pytest.approx(part.a.rank().corr(part.b.rank()), rel=1e-9)


def test_scores_by_key_and_without(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(600), "k": rng.integers(0, 2, 600), "value": rng.normal(size=600)})
    df = spark.createDataFrame(pdf)

    def score(x):
        away = (x - x.median()).abs()
        return diagnostics.ROBUST * (x - x.median()) / away.median()

    keyed = diagnostics.mad_zscore(df, ["k"]).orderBy("id").toPandas()
    assert np.allclose(keyed.robust_z, pdf.groupby("k").value.transform(score), rtol=1e-12)
    alone = diagnostics.mad_zscore(df, []).orderBy("id").toPandas()
    assert np.allclose(alone.robust_z, score(pdf.value), rtol=1e-12)
    flat = diagnostics.mad_zscore(spark.createDataFrame([(1.0,), (1.0,), (None,)], "value double"), [])
    assert [r["robust_z"] for r in flat.collect()] == [0.0, 0.0, 0.0]
