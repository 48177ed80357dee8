"""Low-rank and radial-basis models of wells, their cross-validation, k-means regimes and the bounded ratio field.

Wells are few (thousands at most) and pixels many: models are fitted on the driver or, for each candidate of a grid
search, in a task of its own; pixels only meet their results, as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.functions.classes import GROUNDWATER
from terrachron.operators import ranks
from terrachron.operators.nearest import shared_folder


def svd_impute(matrix: np.ndarray, rank: int, rounds: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Scores (rows x r) and components (r x columns) of a matrix with NaN.

    Missing cells start at their row's mean (0 without one) and take the value of the rank-r approximation, again and
    again, until they move by less than ``tolerance`` in the mean of squares, or for ``rounds`` rounds.
    """
    there = np.isfinite(matrix)
    if not there.any():
        raise ValueError("a matrix without a value")
    n, total = there.sum(axis=1), np.where(there, matrix, 0.0).sum(axis=1)
    means = np.divide(total, n, out=np.zeros(len(matrix)), where=n > 0)
    filled, r = np.where(there, matrix, means[:, None]), min(rank, min(matrix.shape), max(1, len(matrix) - 1))
    for _ in range(0 if there.all() else rounds):
        u, s, vt = np.linalg.svd(filled, full_matrices=False)
        moved = ((u[:, :r] * s[:r]) @ vt[:r])[~there]
        change = float(np.mean((moved - filled[~there]) ** 2))
        filled[~there] = moved
        if change < tolerance:
            break
    u, s, vt = np.linalg.svd(filled, full_matrices=False)
    return u[:, :r] * s[:r], vt[:r]


def spread_centres(xy: np.ndarray, most: int) -> np.ndarray:
    """Points chosen one by one, each the farthest from those before (the first of equals); the first has the least x + y."""
    chosen = [int(np.argmin(xy.sum(axis=1)))]
    far = ((xy - xy[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(max(1, most), len(xy)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((xy - xy[chosen[-1]]) ** 2).sum(axis=1))
    return xy[chosen]


def spread_sites(points: DataFrame, most: int) -> DataFrame:
    """place (from 1), x and y of ``spread_centres``, chosen on the cluster: each choice is one aggregation of points (id, x, y).

    Of equals the smallest id is chosen. Points without a place take no part; no points give no centres.
    """
    x, y = F.col("x"), F.col("y")
    at = points.select("id", x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    first = at.agg(F.count("*").alias("n"), F.min(F.struct((x + y).alias("v"), "id", "x", "y")).alias("b")).first()
    chosen = [first["b"]] if first["n"] else []
    while chosen and len(chosen) < min(max(1, most), first["n"]):
        gaps = [(x - r["x"]) * (x - r["x"]) + (y - r["y"]) * (y - r["y"]) for r in chosen]
        far = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        chosen.append(at.agg(F.min(F.struct((-far).alias("v"), "id", "x", "y")).alias("b")).first()["b"])
    return points.sparkSession.createDataFrame([(i, r["x"], r["y"]) for i, r in enumerate(chosen, 1)], "place long, x double, y double")


def rbf_basis(xy: np.ndarray, centres: np.ndarray, sigma: float) -> np.ndarray:
    d2 = ((xy[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return np.column_stack([np.ones(len(xy)), np.exp(-0.5 * d2 / sigma**2)])


def rbf_fit(xy: np.ndarray, values: np.ndarray, centres: np.ndarray, sigma: float, ridge: float) -> np.ndarray:
    B = rbf_basis(xy, centres, sigma)
    penalty = ridge * np.eye(B.shape[1])
    penalty[0, 0] = 0
    return np.linalg.lstsq(B.T @ B + penalty, B.T @ values, rcond=None)[0]


def block_folds(xy: np.ndarray, block: float, folds: int, seed: int) -> np.ndarray:
    """The fold of each point: blocks are shuffled with the seed and dealt out; points one by one if blocks are too few."""
    cell = np.floor((xy - xy.min(axis=0)) / block).astype(int)
    blocks, own = np.unique(cell, axis=0, return_inverse=True)
    if len(blocks) < 2:
        blocks, own = xy, np.arange(len(xy))
    order = np.arange(len(blocks))
    np.random.default_rng(seed).shuffle(order)
    fold = np.empty(len(blocks), int)
    fold[order] = np.arange(len(blocks)) % min(folds, len(blocks))
    return fold[own.ravel()]


def harmonics_of(series: np.ndarray, days: np.ndarray, period: float = 365.2425) -> tuple[np.ndarray, np.ndarray]:
    """Complex annual coefficients and linear trends (per year) of the rows of a matrix with NaN."""
    t = (days - days[0]) / period
    X = np.column_stack([np.ones_like(t), t, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)])
    out, trend = np.full(len(series), np.nan, complex), np.full(len(series), np.nan)
    for i, y in enumerate(series):
        m = np.isfinite(y)
        if m.sum() >= 6:
            b = np.linalg.lstsq(X[m], y[m], rcond=None)[0]
            out[i], trend[i] = b[3] + 1j * b[2], b[1]
    return out, trend


@dataclass
class FieldModel:
    """Head anomalies as scores(x, y) times components(day)."""

    centres: np.ndarray
    sigma: float
    ridge: float
    rank: int
    coefficients: np.ndarray
    components: np.ndarray
    days: np.ndarray

    def at(self, xy: np.ndarray, days: np.ndarray) -> np.ndarray:
        comp = np.array([np.interp(days, self.days, c) for c in self.components])
        return rbf_basis(xy, self.centres, self.sigma) @ self.coefficients @ comp

    def table(self, df: DataFrame) -> DataFrame:
        """The model as a one-row DataFrame."""
        return df.sparkSession.createDataFrame([(self.rank, self.sigma, self.ridge, self.centres.tolist(), self.coefficients.tolist(), self.components.tolist(), self.days.tolist())], "rank int, sigma double, ridge double, centres array<array<double>>, coefficients array<array<double>>, components array<array<double>>, days array<double>")

    @staticmethod
    def of(table: DataFrame) -> FieldModel:
        """The model whose ``table`` was stored."""
        r = table.first()
        if r is None:
            raise ValueError("no model in the table")
        return FieldModel(np.array(r["centres"]), r["sigma"], r["ridge"], r["rank"], np.array(r["coefficients"]), np.array(r["components"]), np.array(r["days"]))


def field_fit(xy: np.ndarray, matrix: np.ndarray, days: np.ndarray, rank: int, sigma: float, ridge: float, centres: int = 32, rounds: int = 20) -> FieldModel:
    scores, components = svd_impute(matrix, rank, rounds)
    c = spread_centres(xy, centres)
    return FieldModel(c, sigma, ridge, components.shape[0], rbf_fit(xy, scores, c, sigma, ridge), components, days.astype(float))


CV_SCHEMA = "rank int, sigma double, ridge double, cv_rmse double, cv_annual_amplitude_rmse double, cv_phase_mae_days double, cv_harmonic_vector_rmse double, cv_linear_trend_rmse double, n_test_values long"


def field_cv(df: DataFrame, xy: np.ndarray, matrix: np.ndarray, days: np.ndarray, *, ranks: list[int], sigmas: list[float], ridges: list[float], folds: int = 5, block: float = 30.0, seed: int = 20260919, centres: int = 32) -> DataFrame:
    """Cross-validation errors of every candidate; candidates are spread over tasks, the matrix goes with them."""
    fold = block_folds(xy, block, folds, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple, tuple] = {}
        for frame in frames:
            rows = []
            for rank, sigma, ridge in zip(frame["rank"], frame["sigma"], frame["ridge"], strict=True):
                errors, parts = [], []
                for f in np.unique(fold):
                    train, test = fold != f, fold == f
                    if train.sum() < max(4, rank + 1) or not test.any():
                        continue
                    if (rank, f) not in cache:
                        cache[rank, f] = svd_impute(matrix[train], rank)
                    scores, comp = cache[rank, f]
                    c = spread_centres(xy[train], centres)
                    predicted = rbf_basis(xy[test], c, sigma) @ rbf_fit(xy[train], scores, c, sigma, ridge) @ comp
                    own = matrix[test]
                    errors.append((predicted - own)[np.isfinite(own)])
                    (a, ta), (p, tp) = harmonics_of(own, days), harmonics_of(predicted, days)
                    ok = np.isfinite(a) & np.isfinite(p)
                    turn = np.abs(np.angle(p[ok] / np.where(a[ok] == 0, 1, a[ok]))) / (2 * np.pi) * 365.2425
                    parts.append(np.column_stack([np.abs(p[ok]) - np.abs(a[ok]), turn, np.abs(p[ok] - a[ok]), (tp - ta)[ok]]))
                e = np.concatenate(errors) if errors else np.zeros(0)
                h = np.concatenate(parts) if parts else np.zeros((0, 4))
                rms = lambda v: float(np.sqrt(np.mean(v**2))) if len(v) else None
                rows.append((int(rank), float(sigma), float(ridge), rms(e), rms(h[:, 0]), float(h[:, 1].mean()) if len(h) else None, rms(h[:, 2]), rms(h[:, 3]), len(e)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CV_SCHEMA.split(", ")])

    spark = df.sparkSession
    grid = spark.createDataFrame([(r, float(s), float(g)) for r in ranks for s in sigmas for g in ridges], "rank int, sigma double, ridge double")
    return grid.repartition(max(1, len(ranks) * len(sigmas)), "rank", "sigma").mapInPandas(run, CV_SCHEMA)


def rank_field_models(cv: DataFrame) -> DataFrame:
    """Candidates with a finite error, best first: rmse, then the harmonic vector's (missing last), rank, sigma, ridge."""
    return cv.where(F.col("cv_rmse").isNotNull() & ~F.isnan("cv_rmse")).orderBy("cv_rmse", F.asc_nulls_last("cv_harmonic_vector_rmse"), "rank", "sigma", "ridge")


def field_report(cv: DataFrame) -> DataFrame:
    """Every candidate, the selected one marked and first, then in the order of choice."""
    order = (F.asc_nulls_last("cv_rmse"), F.asc_nulls_last("cv_harmonic_vector_rmse"), "rank", "sigma", "ridge")
    best = rank_field_models(cv).limit(1).select(F.col("rank").alias("__r"), F.col("sigma").alias("__s"), F.col("ridge").alias("__g"))
    same = (F.col("rank") == F.col("__r")) & (F.col("sigma") == F.col("__s")) & (F.col("ridge") == F.col("__g"))
    marked = cv.join(F.broadcast(best), same, "left").withColumn("selected", F.col("__r").isNotNull()).drop("__r", "__s", "__g")
    return marked.orderBy(F.desc("selected"), *order)


def predict_field(pixels: DataFrame, model: FieldModel, days: list[int]) -> DataFrame:
    """pixel_id, day, head_anomaly_m of pixels (x, y): scores as columns, then a product with the few components."""
    comp = np.array([np.interp(days, model.days, c) for c in model.components])
    basis = [F.lit(1.0)] + [F.exp(-0.5 * (F.pow(F.col("x") - float(cx), 2) + F.pow(F.col("y") - float(cy), 2)) / model.sigma**2) for cx, cy in model.centres]
    scores = [sum((b * float(w) for b, w in zip(basis, column, strict=True)), F.lit(0.0)) for column in model.coefficients.T]
    scored = pixels.select("pixel_id", *(s.alias(f"__s{i}") for i, s in enumerate(scores)))
    epochs = F.array(*(F.struct(F.lit(int(d)).alias("day"), *(F.lit(float(v)).alias(f"c{i}") for i, v in enumerate(comp[:, k]))) for k, d in enumerate(days)))
    long = scored.select("*", F.explode(epochs).alias("e"))
    return long.select("pixel_id", "e.day", sum((F.col(f"__s{i}") * F.col(f"e.c{i}") for i in range(len(comp))), F.lit(0.0)).alias("head_anomaly_m"))


def head_state(v: np.ndarray, stable: float = 0.5, meaningful: float = 1.0) -> np.ndarray:
    return np.select([v < -meaningful, np.abs(v) <= stable, v > meaningful], [1, 2, 3], 0)


def change_cv(rates: DataFrame, *, sigmas: list[float], ridges: list[float], folds: int = 5, block: float = 30.0, seed: int = 20260919, stable: float = 0.5, meaningful: float = 1.0, centres: int = 32) -> DataFrame:
    """Out-of-fold predictions of each interval under each candidate: year1, sigma, ridge, station_id, fold, actual, predicted, states.

    rates: station_id, year1, x, y, rate. Wells stay rows (``validation``); fits see sums over an interval's wells.
    """
    from terrachron.operators import validation

    sigmas, ridges = [float(s) for s in sigmas], [float(r) for r in ridges]
    own = rates.where("rate IS NOT NULL").select(F.col("year1").cast("int").alias("g"), F.col("station_id").cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "rate")))
    path = f"{shared_folder(rates.sparkSession, 'change')}"
    own.write.parquet(f"{path}/rates")
    rows = validation.with_folds(rates.sparkSession.read.schema(own.schema).parquet(f"{path}/rates"), block, folds, seed)
    rows.write.parquet(f"{path}/folds")
    rows = rates.sparkSession.read.schema(rows.schema).parquet(f"{path}/folds")
    at, weights = validation.change_fits(rows, validation.training_sizes(rows), sigmas=sigmas, ridges=ridges, centres=centres)
    schema = "year1 int, sigma double, ridge double, station_id string, fold int, actual double, predicted double, error double, actual_state int, predicted_state int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (g, f), part in frame.groupby(["g", "fold"]):
                xy, v = part[["x", "y"]].to_numpy(float), part["rate"].to_numpy(float)
                for s in sigmas if (g, f) in at else ():
                    B = rbf_basis(xy, at[g, f], s)
                    for r in ridges:
                        out = B @ weights[g, f, s, r]
                        kept = np.isfinite(out)
                        yield pd.DataFrame({"year1": g, "sigma": s, "ridge": r, "station_id": part["id"], "fold": f, "actual": v, "predicted": out, "error": out - v, "actual_state": head_state(v, stable, meaningful), "predicted_state": head_state(out, stable, meaningful)})[kept]

    return rows.mapInPandas(run, schema)


def change_cv_summary(predictions: DataFrame) -> DataFrame:
    """Errors of each candidate, best first: rmse, accuracy (highest), sigma, ridge."""
    e = F.col("error")
    out = predictions.groupBy("sigma", "ridge").agg(F.count_distinct("year1").alias("n_intervals"), F.count("*").alias("n_validation"), F.sqrt(F.avg(e * e)).alias("cv_rmse"), F.avg(F.abs(e)).alias("cv_mae"), F.avg(e).alias("cv_bias"), F.avg(F.when(F.col("actual_state") > 0, (F.col("actual_state") == F.col("predicted_state")).cast("double"))).alias("cv_state_accuracy"))
    return out.orderBy("cv_rmse", F.desc_nulls_last("cv_state_accuracy"), "sigma", "ridge")


def change_cv_by_interval(predictions: DataFrame) -> DataFrame:
    e = F.col("error")
    return predictions.groupBy("year1").agg(
        F.count("*").alias("n_validation"), F.count_if(F.col("actual_state") > 0).alias("n_decisive_state"), F.median("actual").alias("actual_median"), F.median("predicted").alias("predicted_median"), F.sqrt(F.avg(e * e)).alias("cv_rmse"), F.avg(F.abs(e)).alias("cv_mae"), F.avg(e).alias("cv_bias"),
        F.avg(F.when(F.col("actual_state") > 0, (F.col("actual_state") == F.col("predicted_state")).cast("double"))).alias("state_accuracy"),
    )


def predict_change(pixels: DataFrame, xy: np.ndarray, rates: np.ndarray, sigma: float, ridge: float, year1: int, centres: int = 32, centre_points: np.ndarray | None = None) -> DataFrame:
    """pixel_id, year1 and head_change of pixels (x, y) from an interval's wells; centres are spread among them, if not given.

    Weights are kept to twelve digits: those behind are the solver's rounding, and far from all centres, where the
    first weight alone is left, they would decide on which side of a threshold all pixels lie.
    """
    c = spread_centres(xy, centres) if centre_points is None else centre_points
    w = [float(f"{v:.12g}") for v in rbf_fit(xy, rates, c, sigma, ridge)]
    value = sum((v * F.exp(-0.5 * (F.pow(F.col("x") - float(cx), 2) + F.pow(F.col("y") - float(cy), 2)) / sigma**2) for v, (cx, cy) in zip(w[1:], c, strict=True)), F.lit(w[0]))
    return pixels.select("pixel_id", F.lit(year1).alias("year1"), value.alias("head_change"))


def state_labels() -> dict[int, str]:
    return dict(GROUNDWATER)


def bounded_least_squares(A: np.ndarray, b: np.ndarray, low: float, high: float, rounds: int = 3000) -> np.ndarray:
    """min |Ax - b| with low <= x <= high, by accelerated projected gradients."""
    G, h = A.T @ A, A.T @ b
    step = 1 / max(float(np.linalg.eigvalsh(G)[-1]), 1e-300)
    x = np.clip(np.linalg.lstsq(G + 1e-12 * np.trace(G) / len(G) * np.eye(len(G)), h, rcond=None)[0], low, high)
    z, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.clip(z - step * (G @ z - h), low, high)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / s * (new - x)
        if np.abs(new - x).max(initial=0) < 1e-14 * max(1.0, high):
            return new
        x, t = new, s
    return x


def node_grid(xy: np.ndarray, spacing: float, most: float, support: Callable[[np.ndarray], np.ndarray] | None = None, box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Nodes at the multiples of ``spacing`` over a box (x0, x1, y0, y1; that of ``xy`` without one), within the support and ``most`` of a place in ``xy``."""
    x0, x1, y0, y1 = box or (xy[:, 0].min(), xy[:, 0].max(), xy[:, 1].min(), xy[:, 1].max())
    axes = [np.arange(np.floor(a / spacing), np.ceil(b / spacing) + 1) * spacing for a, b in ((x0, x1), (y0, y1))]
    nodes = np.stack(np.meshgrid(*axes), axis=-1).reshape(-1, 2)
    near = np.array([((xy - n) ** 2).sum(axis=1).min() <= most**2 for n in nodes], bool) if len(xy) else np.ones(len(nodes), bool)
    return nodes[near & (support(nodes) if support else True)]


def near_basis(xy: np.ndarray, nodes: np.ndarray, sigma: float, neighbours: int = 12) -> np.ndarray:
    """Gaussian weights of each place's nearest nodes, normalised to 1."""
    out, k = np.zeros((len(xy), len(nodes))), min(max(1, neighbours), len(nodes))
    for i, p in enumerate(xy):
        d2 = ((nodes - p) ** 2).sum(axis=1)
        at = np.argsort(d2, kind="stable")[:k]
        w = np.exp(-0.5 * d2[at] / sigma**2)
        out[i, at] = w / max(w.sum(), 1e-12)
    return out


def regularised_ratio(cells: pd.DataFrame, nodes: np.ndarray, *, spacing: float, lam: float, low: float = 0.0, high: float = 0.05, sigma_factor: float = 1.5, neighbours: int = 12) -> np.ndarray:
    """The bounded ratio at nodes that fits cells (x, y, q2, qd) best and differs little between nodes next to each other.

    Minimises the sum over cells of q2 / median(q2) * (qd / q2 - basis @ nodes) ** 2 plus ``lam`` times the sum over
    pairs of nodes within 1.5 * spacing of their squared differences.
    """
    q2 = cells["q2"].to_numpy(float)
    weight = np.sqrt(q2 / max(float(np.median(q2[q2 > 0])), 1e-12))
    A = weight[:, None] * near_basis(cells[["x", "y"]].to_numpy(float), nodes, sigma_factor * spacing, neighbours)
    b = weight * cells["qd"].to_numpy(float) / q2
    pairs = [(i, j) for i in range(len(nodes)) for j in range(i) if ((nodes[i] - nodes[j]) ** 2).sum() <= (1.5 * spacing) ** 2]
    if lam > 0 and pairs:
        L = np.zeros((len(pairs), len(nodes)))
        L[np.arange(len(pairs)), [i for i, _ in pairs]], L[np.arange(len(pairs)), [j for _, j in pairs]] = 1, -1
        A, b = np.vstack([A, np.sqrt(lam) * L]), np.concatenate([b, np.zeros(len(pairs))])
    return bounded_least_squares(A, b, low, high)


RATIO_CV = "spacing double, lam double, cv_rmse double, nodes int, tested_cells long"


def regularised_cv(spark: SparkSession, cells: pd.DataFrame, *, spacings: Sequence[float] = (10, 15, 20, 25), lams: Sequence[float] = (0.1, 1, 10, 100), block: float = 30.0, most: float = 30.0, support: Callable[[np.ndarray], np.ndarray] | None = None, box: tuple[float, float, float, float] | None = None, folds: int = 5, **options: float) -> DataFrame:
    """Errors of every candidate, each in a task of its own; folds go by diagonal blocks of ``block``.

    cells: x, y, q2, qd, d2, w. A candidate with fewer than three nodes is left out.
    """
    xy = cells[["x", "y"]].to_numpy(float)
    at = np.floor(xy / block).astype(int)
    fold = (at[:, 0] + 2 * at[:, 1]) % folds

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for spacing, lam in zip(frame["spacing"], frame["lam"], strict=True):
                nodes = node_grid(xy, spacing, most, support, box)
                if len(nodes) < 3:
                    continue
                error = weight = tested = 0.0
                for f in range(folds):
                    train, test = cells[fold != f], cells[fold == f]
                    if len(train) < 3 or not len(test):
                        continue
                    values = regularised_ratio(train, nodes, spacing=spacing, lam=lam, **options)
                    s = near_basis(test[["x", "y"]].to_numpy(float), nodes, float(options.get("sigma_factor", 1.5)) * spacing, int(options.get("neighbours", 12))) @ values
                    error += float((test["d2"] - 2 * s * test["qd"] + s * s * test["q2"]).clip(lower=0).sum())
                    weight, tested = weight + float(test["w"].sum()), tested + len(test)
                rows.append((spacing, lam, float(np.sqrt(error / weight)) if weight > 0 else None, len(nodes), int(tested)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RATIO_CV.split(", ")])

    grid = spark.createDataFrame([(float(s), float(v)) for s in spacings for v in lams], "spacing double, lam double")
    return grid.repartition(len(spacings) * len(lams), "spacing", "lam").mapInPandas(run, RATIO_CV)


def best_regularised(cv: DataFrame) -> DataFrame:
    """The candidate with the least error, then spacing, then weight of smoothness."""
    return cv.where(F.col("cv_rmse").isNotNull() & ~F.isnan("cv_rmse")).orderBy("cv_rmse", "spacing", "lam").limit(1)


def lloyd(X: np.ndarray, k: int, seed: int, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Inertia and centres of k-means from seeds drawn with a chance that grows with the squared distance to those before."""
    rng = np.random.default_rng(seed)
    centres = X[[rng.integers(len(X))]]
    far = ((X - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        new = X[rng.choice(len(X), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(X))]
        centres, far = np.vstack([centres, new]), np.minimum(far, ((X - new) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest_centre(X, centres)
        after = np.array([X[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(after, centres, atol=1e-9):
            break
        centres = after
    return float(((X - centres[nearest_centre(X, centres)]) ** 2).sum()), centres


def nearest_centre(X: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(((X[:, None] - centres[None]) ** 2).sum(axis=2), axis=1) if len(X) * len(centres) < 1 << 24 else np.concatenate([nearest_centre(x, centres) for x in np.array_split(X, 2)])


def separation(X: np.ndarray, own: np.ndarray) -> tuple[float, float]:
    """The indices of Calinski and Harabasz (between to within, higher is better) and of Davies and Bouldin (lower is better)."""
    names, n = np.unique(own, return_counts=True)
    centres = np.array([X[own == c].mean(axis=0) for c in names])
    within = np.array([((X[own == c] - m) ** 2).sum() for c, m in zip(names, centres, strict=True)])
    between = float((n * ((centres - X.mean(axis=0)) ** 2).sum(axis=1)).sum())
    k, rest = len(names), within.sum()
    wide = np.array([np.sqrt(((X[own == c] - m) ** 2).sum(axis=1)).mean() for c, m in zip(names, centres, strict=True)])
    gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    worst = ((wide[:, None] + wide[None]) / np.maximum(gaps, 1e-300)).max(axis=1)
    return float((between / (k - 1)) / (rest / (len(X) - k))) if rest > 0 else 1.0, float(worst.mean())


def silhouettes(X: np.ndarray, own: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The silhouettes of the rows ``some``: how much nearer a row is, on average, to its own cluster than to the next one."""
    names, n = np.unique(own, return_counts=True)
    place = np.searchsorted(names, own)
    member = np.eye(len(names))[place]
    out = np.zeros(len(some))
    for i in range(0, len(some), 256):
        rows = some[i : i + 256]
        d2 = (X[rows] ** 2).sum(axis=1)[:, None] + (X**2).sum(axis=1)[None] - 2 * X[rows] @ X.T
        d2[np.arange(len(rows)), rows] = 0
        total, mine = np.sqrt(np.maximum(d2, 0)) @ member, place[rows]
        inner = total[np.arange(len(rows)), mine] / np.maximum(n[mine] - 1, 1)
        other = total / n
        other[np.arange(len(rows)), mine] = np.inf
        outer = other.min(axis=1)
        out[i : i + 256] = np.where(n[mine] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0)
    return out


def balanced_sample(df: DataFrame, rows: int, cols: int, most: int, key: str = "pixel_id", seed: int = 20260919, least: int = 100) -> DataFrame:
    """Every ``rows``-th row and ``cols``-th column (all pixels if these are too few), at most ``most`` of them by a digest."""
    from terrachron.operators.spatial import hash_sample

    some = df.where((F.col("row") % rows == 0) & (F.col("col") % cols == 0))
    n = some.count()
    some, n = (some, n) if n >= least else (df, df.count())
    return hash_sample(some, key, most, seed) if n > most else some


@dataclass
class ClusterModel:
    """Clusters of standardised features: their scaler and centres, in the order of the clusters' numbers."""

    features: list[str]
    mean: np.ndarray
    spread: np.ndarray
    centres: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as a one-row DataFrame."""
        return spark.createDataFrame([(list(self.features), self.mean.tolist(), self.spread.tolist(), self.centres.tolist())], "features array<string>, mean array<double>, spread array<double>, centres array<array<double>>")

    @staticmethod
    def of(table: DataFrame) -> ClusterModel:
        """The model whose ``table`` was stored."""
        r = table.first()
        if r is None:
            raise ValueError("no model in the table")
        return ClusterModel(list(r["features"]), np.array(r["mean"]), np.array(r["spread"]), np.array(r["centres"]))

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with cluster_id (1 on) of the nearest centre, the first of equals; rows without every feature go."""
        scaled = [(F.col(c) - float(m)) / float(w) for c, m, w in zip(self.features, self.mean, self.spread, strict=True)]
        places = F.array(*(F.struct(sum((F.pow(z - float(v), 2) for z, v in zip(scaled, centre, strict=True)), F.lit(0.0)).alias("d"), F.lit(i + 1).alias("id")) for i, centre in enumerate(self.centres)))
        return df.dropna(subset=self.features).withColumn("cluster_id", F.array_min(places)["id"])


def regimes(df: DataFrame, features: list[str], *, ks: Sequence[int] = (2, 3, 4, 5, 6), k: int | None = None, starts: int = 20, final_starts: int = 30, seed: int = 20260919, sample: DataFrame | None = None, most: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """``df`` with cluster_id (1 on), and a row for each k: by ``regime_model``."""
    model, table = regime_model(df, features, ks=ks, k=k, starts=starts, final_starts=final_starts, seed=seed, sample=sample, most=most)
    return model.assign(df), table


def regime_model(df: DataFrame, features: list[str], *, ks: Sequence[int] = (2, 3, 4, 5, 6), k: int | None = None, starts: int = 20, final_starts: int = 30, seed: int = 20260919, sample: DataFrame | None = None, most: int = 50_000) -> tuple[ClusterModel, DataFrame]:
    """The clusters of ``df``, and a row for each k: silhouette, calinski_harabasz, davies_bouldin and inertia.

    k-means on standardised features is fitted on a bounded sample (``sample``, else at most ``most`` rows by a
    digest of the features), every start in a task of its own; k is the given one, else the one with the highest
    silhouette. All rows of ``df`` that have every feature get the cluster of the nearest centre. Clusters are numbered
    by the centres' last feature.
    """
    from terrachron.operators.spatial import hash_sample

    spark = df.sparkSession
    rows = df.dropna(subset=features)
    if sample is None:
        keyed = rows.select(*features, F.concat_ws(":", *(F.col(c).cast("string") for c in features)).alias("__k"))
        sample = hash_sample(keyed, "__k", most, seed)
    picked = sample.dropna(subset=features).select(*(F.col(c).cast("double") for c in features)).limit(most).toPandas().to_numpy(float)
    order = np.lexsort(picked.T[::-1])
    picked = picked[order]
    mean, spread = picked.mean(axis=0), picked.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    held = spark.sparkContext.broadcast((picked - mean) / spread)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [lloyd(held.value, int(c), int(s)) for c, s in zip(frame["k"], frame["seed"], strict=True)]
            yield pd.DataFrame({"k": frame["k"], "seed": frame["seed"], "inertia": [i for i, _ in found], "centres": [c.ravel().tolist() for _, c in found]})

    def best_of(tasks: list[tuple[int, int]]) -> dict[int, tuple[float, np.ndarray]]:
        asked = spark.createDataFrame(tasks, "k int, seed int").repartition(min(len(tasks), 200), "k", "seed")
        fits = asked.mapInPandas(run, "k int, seed int, inertia double, centres array<double>").orderBy("k", "inertia", "seed").collect()
        out: dict[int, tuple[float, np.ndarray]] = {}
        for r in fits:
            out.setdefault(r["k"], (r["inertia"], np.array(r["centres"]).reshape(r["k"], -1)))
        return out

    candidates = [c for c in ks if 2 <= c < len(picked)]
    best = best_of([(c, seed + s) for c in candidates for s in range(starts)])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        X = held.value
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "s": [float(silhouettes(X, nearest_centre(X, best[c][1]), np.arange(a, min(len(X), a + 2048))).sum()) for c, a in zip(frame["k"], frame["low"], strict=True)]})

    blocks = spark.createDataFrame([(c, a) for c in candidates for a in range(0, len(picked), 2048)], "k int, low int")
    sums = {r["k"]: r["s"] / len(picked) for r in blocks.repartition(min(blocks.count(), 200), "k", "low").mapInPandas(score, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    table = [(c, sums[c], *separation(held.value, nearest_centre(held.value, best[c][1])), best[c][0]) for c in candidates]
    chosen = k or max(candidates, key=lambda c: (sums[c], -c))
    centres = best_of([(chosen, seed + s) for s in range(final_starts)])[chosen][1]
    centres = centres[np.lexsort(centres.T)]
    return ClusterModel(list(features), mean, spread, centres), spark.createDataFrame(table, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double")


def cluster_summary(df: DataFrame, values: list[str], cluster: str = "cluster_id") -> DataFrame:
    n = df.groupBy(cluster).agg(F.count("*").alias("pixel_count"))
    return ranks.side_by_side(n, ranks.medians(df, [cluster], {f"median_{v}": v for v in values}), [cluster])
