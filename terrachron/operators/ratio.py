"""The bounded ratio field: a smooth field between bounds, on nodes of a regular grid, that fits sums of cells.

The field at a cell is the weighted mean of its nearest nodes. Everything that grows with the cells is a sparse table:
weights (a row a cell and near node), normal sums (a row a pair of nodes that share a cell, by fold, so that every
training set's sums are sums of folds) and edges between neighbouring nodes. A solve holds the sparse sums of its nodes,
about a hundred numbers a node, in a task of its own for each candidate and training set; it never sees cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrachron.operators import ranks, spatial

#: The training set that leaves no fold out.
ALL = -1
#: Steps from a node to half of its neighbours; the other half follows by symmetry.
EDGES = ((1, 0), (0, 1), (1, 1), (1, -1))
SOLUTION = "spacing double, lam double, train int, site_id long, value double"


def node_table(cells: DataFrame, spacings: Sequence[float], most: float, support: Callable[[DataFrame], DataFrame] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """spacing, site_id, i, j, sx, sy of the nodes at multiples of each spacing over a box (that of the cells without one).

    Only nodes that ``support`` keeps (a filter of this table, None for no filter) and that lie within ``most`` of a
    cell stay. Ids are unique over all spacings and follow rows of nodes. Without cells there are no nodes.
    """
    spark = cells.sparkSession
    ends = tuple(box or cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    spans = [] if None in ends else [(float(s), *(int(f(v / s)) for f, v in zip((np.floor, np.ceil, np.floor, np.ceil), ends, strict=True))) for s in sorted({float(s) for s in spacings})]
    starts = np.cumsum([0] + [(b - a + 1) * (d - c + 1) for _, a, b, c, d in spans])
    table = spark.createDataFrame([(*span, int(start)) for span, start in zip(spans, starts, strict=False)], "spacing double, a long, b long, c long, d long, start long")
    rows = table.select("*", F.explode(F.sequence("c", "d")).alias("j")).select("*", F.explode(F.sequence("a", "b")).alias("i"))
    nodes = rows.select("spacing", (F.col("start") + (F.col("j") - F.col("c")) * (F.col("b") - F.col("a") + 1) + F.col("i") - F.col("a")).alias("site_id"), "i", "j", (F.col("i") * F.col("spacing")).alias("sx"), (F.col("j") * F.col("spacing")).alias("sy"))
    nodes = support(nodes) if support else nodes
    seen = cells.select(F.monotonically_increasing_id().alias("site_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    places = nodes.select(F.col("site_id").alias("node"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    near = spatial.nearest_site(places, seen, point="node").where(F.col("distance") <= most).select(F.col("node").alias("site_id"))
    return nodes.join(near, "site_id", "left_semi")


def weights(cells: DataFrame, nodes: DataFrame, sigma_factor: float = 1.5, neighbours: int = 12) -> DataFrame:
    """spacing, cell_id, site_id and w: Gaussian weights of each cell's nearest nodes of every spacing, normalised to 1.

    The sets of nodes are laid side by side, farther apart than any is wide, and searched at once. Nodes at the same
    distance go by their ids.
    """
    ends = [r for side, names in ((cells, "xy"), (nodes, ("sx", "sy"))) for r in side.agg(*(f(c) for c in names for f in (F.min, F.max))).first() if r is not None]
    width = 4 * (max(ends, default=0.0) - min(ends, default=0.0) + 1)
    sets = nodes.select("spacing").distinct().select("spacing", (F.row_number().over(Window.orderBy("spacing")) - 1).alias("at"))  # a row a spacing
    aside = F.col("at") * width
    points = cells.select("cell_id", "x", "y").crossJoin(F.broadcast(sets)).select(F.struct("cell_id", "spacing").alias("p"), (F.col("x") + aside).alias("x"), "y")
    sites = nodes.join(F.broadcast(sets), "spacing").select(F.struct("site_id", "spacing", "sx", "sy").alias("site_id"), (F.col("sx") + aside).alias("sx"), "sy")
    near = spatial.near_sites(points, sites, max(1, neighbours), point="p").where("p.spacing = site_id.spacing").select("p.*", F.col("site_id.site_id").alias("site_id"), F.col("site_id.sx").alias("sx"), F.col("site_id.sy").alias("sy"))
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    own = Window.partitionBy("spacing", "cell_id")
    placed = near.join(cells.select("cell_id", "x", "y"), "cell_id").withColumn("d2", d2).withColumn("k", F.row_number().over(own.orderBy("d2", "site_id"))).where(F.col("k") <= max(1, neighbours))
    w = F.exp(-0.5 * F.col("d2") / F.pow(F.col("spacing") * sigma_factor, 2))
    return placed.select("spacing", "cell_id", "site_id", (w / F.greatest(F.sum(w).over(own), F.lit(1e-12))).alias("w"))


def bounded_sparse(a: np.ndarray, b: np.ndarray, v: np.ndarray, h: np.ndarray, low: float, high: float, rounds: int = 20_000) -> np.ndarray:
    """min x'Gx - 2 h'x with low <= x <= high, for a symmetric G of entries v at (a, b), each pair once.

    Conjugate gradients without bounds, then accelerated projected gradients, which start anew where they turn round.
    """
    n = len(h)
    off = a != b
    rows, cols, vals = np.concatenate([a, b[off], np.arange(n)]), np.concatenate([b, a[off], np.arange(n)]), np.concatenate([v, v[off], np.zeros(n)])
    order = np.argsort(rows, kind="stable")
    cols, vals, starts = cols[order], vals[order], np.searchsorted(rows[order], np.arange(n))
    times = lambda x: np.add.reduceat(vals * x[cols], starts)
    x = np.zeros(n)
    r = h.copy()
    p, left = r.copy(), float(r @ r)
    for _ in range(2 * n):
        if left <= 1e-28 * max(float(h @ h), 1e-300):
            break
        q = times(p)
        bend = float(p @ q)
        if bend <= 0:
            break
        x, r = x + left / bend * p, r - left / bend * q
        left, before = float(r @ r), left
        p = r + left / before * p
    x = np.clip(x, low, high)
    step = 1 / max(float(np.add.reduceat(np.abs(vals), starts).max()), 1e-300)
    z, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.clip(z - step * (times(z) - h), low, high)
        if np.abs(new - z).max(initial=0) <= 1e-15 * max(high - low, 1e-300):
            return new
        if float((z - new) @ (new - x)) > 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / s * (new - x), new, s
    return x


@dataclass(frozen=True)
class Problem:
    """Tables of a ratio field: cells (cell_id, x, y, q2, qd, d2, weight, fold), nodes, basis (weights with the cells' columns) and sums by fold."""

    cells: DataFrame
    nodes: DataFrame
    basis: DataFrame
    sums: DataFrame
    folds: tuple[int, ...]

    def solve(self, lams: Sequence[float], *, low: float = 0.0, high: float = 0.05, trains: Sequence[int] = (ALL,), spacing: float | None = None) -> DataFrame:
        """spacing, lam, train, site_id and value at every node, fitted on all cells (train ALL) or all but those of fold ``train``.

        The least sum over cells of q2 / median(q2) * (qd / q2 - field) ** 2 plus lam times the sum of squared
        differences of neighbouring nodes (in a row, a column or diagonal), between the bounds.
        """
        only = F.lit(True) if spacing is None else F.col("spacing") == float(spacing)
        train = F.explode(F.array(*(F.lit(int(f)) for f in trains))).alias("train")
        own = self.cells.select("q2", "fold", train).where("fold <> train")
        scale = ranks.medians(own, ["train"], {"scale": "q2"})
        data = self.sums.where(only).select("spacing", "a", "b", "v", "fold", train).where("fold <> train").groupBy("spacing", "train", "a", "b").agg(F.sum("v").alias("v"))
        kept = self.nodes.where(only)
        along = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in EDGES)))
        to = kept.select("spacing", "i", "j", F.col("site_id").alias("b"))
        edges = kept.select("spacing", "site_id", "i", "j", along.alias("o")).select("spacing", F.col("site_id").alias("a"), (F.col("i") + F.col("o.i")).alias("i"), (F.col("j") + F.col("o.j")).alias("j")).join(to, ["spacing", "i", "j"]).select("spacing", train, "a", "b", F.lit(None).cast("double").alias("v"))
        each = kept.select("spacing", train, F.col("site_id").alias("a"), F.col("site_id").alias("b"), F.lit(0.0).alias("v"))
        lam = F.explode(F.array(*(F.lit(float(v)) for v in lams))).alias("lam")
        rows = data.unionByName(edges).unionByName(each).join(F.broadcast(scale), "train").select("spacing", lam, "train", "a", "b", "v", "scale")

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            first, smooth = frame.iloc[0], float(frame["lam"].iloc[0]) * float(frame["scale"].iloc[0])
            ids = np.sort(frame.loc[(frame["a"] == frame["b"]), "a"].unique())
            right = frame[frame["b"] < 0]  # the right-hand side: no node has this id
            h = np.bincount(np.searchsorted(ids, right["a"]), weights=right["v"], minlength=len(ids)).astype(float)
            pair = frame[(frame["b"] >= 0) & frame["v"].notna()]
            edge = frame[frame["v"].isna()]
            i, j = np.searchsorted(ids, edge["a"]), np.searchsorted(ids, edge["b"])
            a, b = np.concatenate([np.searchsorted(ids, pair["a"]), i, j, i]), np.concatenate([np.searchsorted(ids, pair["b"]), i, j, j])
            v = np.concatenate([pair["v"], np.full(2 * len(i), smooth), np.full(len(i), -smooth)])
            values = bounded_sparse(a, b, v, h, low, high)
            return pd.DataFrame({"spacing": first["spacing"], "lam": first["lam"], "train": int(first["train"]), "site_id": ids, "value": values})

        return rows.groupBy("spacing", "lam", "train").applyInPandas(fit, SOLUTION)

    def errors(self, lams: Sequence[float], *, low: float = 0.0, high: float = 0.05) -> DataFrame:
        """spacing, lam, cv_rmse, nodes and tested_cells of each candidate: what the folds' cells leave when fitted without them.

        Folds count that hold a cell and leave at least three; without one cv_rmse is null.
        """
        lam = F.explode(F.array(*(F.lit(float(v)) for v in lams))).alias("lam")
        out = self.nodes.groupBy("spacing").agg(F.count("*").cast("int").alias("nodes")).select("spacing", lam, "nodes")
        if not self.folds:
            return out.select("spacing", "lam", F.lit(None).cast("double").alias("cv_rmse"), "nodes", F.lit(0).cast("long").alias("tested_cells"))
        fitted = self.solve(lams, low=low, high=high, trains=self.folds).withColumnRenamed("train", "fold")
        met = self.basis.join(fitted, ["spacing", "fold", "site_id"])
        cell = met.groupBy("spacing", "lam", "cell_id").agg(F.sum(F.col("w") * F.col("value")).alias("s"), *(F.first(c).alias(c) for c in ("q2", "qd", "d2", "weight")))
        rest = F.greatest(F.col("d2") - 2 * F.col("s") * F.col("qd") + F.col("s") * F.col("s") * F.col("q2"), F.lit(0.0))
        found = cell.groupBy("spacing", "lam").agg(F.sum(rest).alias("e"), F.sum("weight").alias("t"), F.count("*").alias("n"))
        rmse = F.when(F.col("t") > 0, F.sqrt(F.col("e") / F.col("t")))
        return out.join(found, ["spacing", "lam"], "left").select("spacing", "lam", rmse.alias("cv_rmse"), "nodes", F.coalesce("n", F.lit(0)).alias("tested_cells"))


def problem(cells: DataFrame, spacings: Sequence[float], *, most: float = 30.0, block: float = 30.0, folds: int = 5, support: Callable[[DataFrame], DataFrame] | None = None, box: tuple[float, float, float, float] | None = None, sigma_factor: float = 1.5, neighbours: int = 12) -> Problem:
    """The tables of the ratio field of cells (x, y, q2, qd, d2, weight), written to the shared folder.

    Folds go by diagonals of blocks. Cells without a place, with a null or without a positive q2 take no part; other
    columns are not read. Spacings with fewer than three nodes are left out.
    """
    names = ["x", "y", "q2", "qd", "d2", "weight"]
    good = cells.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna().where("q2 > 0")
    fold = F.pmod(F.floor(F.col("x") / block) + 2 * F.floor(F.col("y") / block), F.lit(folds)).cast("int")
    good = ranks.stored(good.select(F.monotonically_increasing_id().alias("cell_id"), *names, fold.alias("fold")))
    count = {r["fold"]: r["count"] for r in good.groupBy("fold").count().collect()}
    nodes = ranks.stored(node_table(good, spacings, most, support, box))
    enough = nodes.groupBy("spacing").count().where("count >= 3").select("spacing")
    nodes = nodes.join(F.broadcast(enough), "spacing", "left_semi")
    basis = ranks.stored(weights(good, nodes, sigma_factor, neighbours).join(good.drop("x", "y"), "cell_id"))
    near = basis.groupBy("spacing", "cell_id").agg(F.sort_array(F.collect_list(F.struct("site_id", "w"))).alias("ws"), *(F.first(c).alias(c) for c in ("q2", "fold")))  # at most ``neighbours`` a cell
    firsts = near.select("spacing", "fold", "q2", "ws", F.explode("ws").alias("m"))
    pairs = firsts.select("spacing", "fold", "q2", "m", F.explode("ws").alias("o")).where("m.site_id <= o.site_id")
    left = pairs.groupBy("spacing", "fold", F.col("m.site_id").alias("a"), F.col("o.site_id").alias("b")).agg(F.sum(F.col("q2") * F.col("m.w") * F.col("o.w")).alias("v"))
    right = basis.groupBy("spacing", "fold", F.col("site_id").alias("a"), F.lit(-1).cast("long").alias("b")).agg(F.sum(F.col("qd") * F.col("w")).alias("v"))
    total = sum(count.values())
    return Problem(good, nodes, basis, ranks.stored(left.unionByName(right)), tuple(sorted(f for f, n in count.items() if total - n >= 3)))
