"""Queries whose results were lost or changed on larger tables than sf0.1, on small fixtures that show it."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from terrachron.plans import place_queries, queries  # noqa: F401  (registers its queries)


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("suppliers")
    spark.createDataFrame([(s, float(s % 97)) for s in range(3000)], "s_suppkey long, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_order_is_numbered_without_a_gap(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 4000)), datetime(1995, 1, 1) + timedelta(days=int(rng.integers(0, 900))), float(i)) for i in range(60_000)]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp, o_totalprice double").repartition(8).write.parquet(f"{tmp_path}/orders.parquet")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = queries.QUERIES["canonical_order"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted({(c, str(d.date())) for c, d, _ in rows})
    assert [(x["station_id"], x["date"], x["place"]) for x in sorted(got, key=lambda x: x["place"])] == [(*k, i) for i, k in enumerate(want, 1)]


def test_state_map_far_from_all_wells(spark, suppliers):
    got = {x["pixel_id"]: (x["head_change"], x["state"]) for x in queries.QUERIES["change_and_state_map"](spark, suppliers).collect()}
    for p in range(3000):
        x, y = float(p % 10), float(p // 10)
        h = 0.5 + sum(w * math.exp(-0.5 * ((x - cx) ** 2 + (y - cy) ** 2) / 9.0) for w, cx, cy in ((1.5, 2.0, 3.0), (-2.0, 7.0, 1.0), (0.25, 4.0, 8.0)))
        assert got[p] == (round(h, 6), 3 if h > 1 else 2 if abs(h) <= 0.5 else 1 if h < -1 else 0), p
    assert got[254] == (0.5, 0) and got[2990] == (0.5, 2)


def test_weights_that_all_vanish(spark, suppliers):
    """As doubles they are 0 beyond 193 from the sites: 0 / 0 in the query's SQL, equal shares by default."""
    from terrachron.operators import spatial

    got = {}
    for x in queries.QUERIES["knn_normalised_rbf"](spark, suppliers).collect():
        got.setdefault(x["pixel_id"], []).append(x["weight"])
    assert all(len(w) == 2 for w in got.values()) and all(math.isnan(v) for v in got[2990]) and abs(sum(got[1500]) - 1) < 1e-6
    grid = queries.grid(spark, suppliers).where("pixel_id = 2990")
    assert [x["weight"] for x in spatial.knn_weights(grid, queries.sites(spark), 2, 5.0).collect()] == [0.5, 0.5]


def test_nearest_epochs_make_no_pairs(spark):
    from terrachron.operators import calendar

    rng = np.random.default_rng(7)
    days = [(k, int(d)) for k in range(6) for d in rng.integers(-50, 50, 40)] + [(6, None), (7, 5), (7, None)]
    asked = [(k, int(t)) for k in range(9) for t in rng.integers(-90, 90, 25)] + [(7, 5), (7, 5)]
    found = calendar.nearest_epoch(spark.createDataFrame(days, "k int, day int"), spark.createDataFrame(asked, "k int, target int"), ["k"])
    assert found.columns == ["k", "target", "day", "gap"] and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, t in asked:
        own = [d for i, d in days if i == k]
        if own:
            want[k, t] = min(((abs(d - t), d) for d in own if d is not None), default=(None, None))
    got = found.collect()
    assert len(got) == len(want) and {(x["k"], x["target"]): (x["gap"], x["day"]) for x in got} == want


def test_regimes_read_metrics_that_are_written(spark, monkeypatch):
    read = []
    monkeypatch.setattr(queries.models, "regimes", lambda df, features: (read.extend(df.inputFiles()) or df.selectExpr("0 AS cluster_id", *features), None))
    monkeypatch.setattr(queries, "metrics", lambda spark, sf: spark.createDataFrame([(1.0, 2.0), (3.0, None)], "early_rate double, late_rate double"))
    assert [x["pixel_count"] for x in queries.QUERIES["regime_kmeans"](spark, "").collect()] == [1] and read and all("/metrics-" in f for f in read)
