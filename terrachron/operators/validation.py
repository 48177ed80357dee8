"""Cross-validation of radial-basis models whose wells stay on the cluster.

Wells are rows. What the driver sees are sums over wells: normal equations, products of epochs, errors, a farthest well a
task, and the occupied blocks that folds are dealt out by. Each step is a pass over the wells that adds up within a
task before the shuffle, so no task, group or driver holds all wells.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.operators.nearest import shared_folder

Sums = dict[tuple, np.ndarray]


def totals(rows: DataFrame, part: Callable[[pd.DataFrame], Iterable[tuple[tuple, np.ndarray]]], keys: str) -> Sums:
    """The sums by key of the arrays that ``part`` makes of each batch of rows; ``keys``: names and types."""
    names = [k.split()[0] for k in keys.split(", ")]

    def frame_of(sums: Sums) -> pd.DataFrame:
        return pd.DataFrame([(*k, v) for k, v in sums.items()], columns=[*names, "sums"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Sums = {}
        for frame in frames:
            for key, own in part(frame):
                sums[key] = sums[key] + own.ravel() if key in sums else own.ravel()
        if sums:
            yield frame_of(sums)

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return frame_of({key: sum(frame["sums"].iloc[1:], frame["sums"].iloc[0])})

    schema = f"{keys}, sums array<double>"
    return {tuple(r[n] for n in names): np.array(r["sums"]) for r in rows.mapInPandas(run, schema).groupBy(*names).applyInPandas(add, schema).collect()}


def with_folds(rows: DataFrame, block: float, folds: int, seed: int) -> DataFrame:
    """``rows`` (g, id, x, y and others) with the fold of ``models.block_folds`` among the wells of each g; the driver deals out the blocks."""
    spark = rows.sparkSession
    low = rows.groupBy("g").agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    celled = rows.join(F.broadcast(low), "g").withColumns({f"__c{c}": F.floor((F.col(c) - F.col(f"__{c}")) / block) for c in ("x", "y")})
    found: dict[object, list[tuple]] = defaultdict(list)
    for r in celled.select("g", "__cx", "__cy").distinct().collect():
        found[r["g"]].append((r["__cx"], r["__cy"]))
    alone, key = [g for g, own in found.items() if len(own) < 2], F.concat_ws(":", "__cx", "__cy")
    if alone:  # too few blocks: well by well, rows of one id together
        key = F.when(F.col("g").isin(alone), F.col("id").cast("string")).otherwise(key)
        found |= {g: [] for g in alone}
        for r in celled.where(F.col("g").isin(alone)).select("g", "id").distinct().collect():
            found[r["g"]].append((r["id"],))
    dealt = []
    for g, own in found.items():
        order = np.arange(len(own))
        np.random.default_rng(seed).shuffle(order)
        fold = np.empty(len(own), int)
        fold[order] = np.arange(len(own)) % min(folds, len(own))
        dealt += [(g, ":".join(map(str, k)), f) for k, f in zip(sorted(own), fold.tolist(), strict=True)]
    table = spark.createDataFrame(dealt, f"g {dict(rows.dtypes)['g']}, __key string, fold int")
    return celled.withColumn("__key", key).join(table, ["g", "__key"]).select(*rows.columns, "fold")


def training_sizes(rows: DataFrame) -> dict[tuple, int]:
    """The number of wells outside each fold, by (g, fold)."""
    n = {(r["g"], r["fold"]): r["count"] for r in rows.groupBy("g", "fold").count().collect()}
    return {(g, f): sum(v for (h, _), v in n.items() if h == g) - own for (g, f), own in n.items()}


def spread(rows: DataFrame, sizes: dict[tuple, int], most: int) -> dict[tuple, np.ndarray]:
    """``models.spread_centres`` of the wells outside each fold, by (g, fold): each choice is a pass over the wells for all folds; the smallest id among equals."""
    kinds, chosen = dict(rows.dtypes), {k: np.zeros((0, 2)) for k, n in sizes.items() if n}
    slim = rows.select("g", "fold", "id", "x", "y")
    while open_ := {k: c for k, c in chosen.items() if len(c) < min(max(1, most), sizes[k])}:

        def run(frames: Iterator[pd.DataFrame], open_: dict[tuple, np.ndarray] = open_) -> Iterator[pd.DataFrame]:
            best: dict[tuple, tuple] = {}
            for frame in frames:
                for g, own in frame.groupby("g"):
                    xy, fold, ids = own[["x", "y"]].to_numpy(float), own["fold"].to_numpy(), own["id"].to_numpy()
                    for (h, f), centres in open_.items():
                        at = np.flatnonzero(fold != f) if h == g else ()
                        if not len(at):
                            continue
                        v = -np.min([((xy[at] - c) ** 2).sum(axis=1) for c in centres], axis=0) if len(centres) else xy[at].sum(axis=1)
                        least = v.min()
                        i = min(at[v == least], key=lambda i: ids[i])
                        mine = (float(least), ids[i], float(xy[i, 0]), float(xy[i, 1]))
                        best[h, f] = min(best.get((h, f), mine), mine)
            if best:
                yield pd.DataFrame([(*k, *v) for k, v in best.items()], columns=["g", "fold", "v", "id", "x", "y"])

        found: dict[tuple, tuple] = {}
        for r in slim.mapInPandas(run, f"g {kinds['g']}, fold int, v double, id {kinds['id']}, x double, y double").collect():
            k, own = (r["g"], r["fold"]), (r["v"], r["id"], r["x"], r["y"])
            found[k] = min(found.get(k, own), own)
        for k, (_, _, x, y) in found.items():
            chosen[k] = np.vstack([chosen[k], [x, y]])
    return chosen


def basis(xy: np.ndarray, centres: np.ndarray, sigma: float) -> np.ndarray:
    from terrachron.operators.models import rbf_basis

    return rbf_basis(xy, centres, sigma)


def solved(sums: np.ndarray, size: int, ridge: float) -> np.ndarray:
    """The weights of ``models.rbf_fit`` from the sums of basis by basis and basis by values."""
    penalty = ridge * np.eye(size)
    penalty[0, 0] = 0
    return np.linalg.lstsq(sums[: size * size].reshape(size, size) + penalty, sums[size * size :].reshape(size, -1), rcond=None)[0]


def normal_sums(B: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.concatenate([(B.T @ B).ravel(), (B.T @ values).ravel()])


def change_fits(rows: DataFrame, sizes: dict[tuple, int], *, sigmas: list[float], ridges: list[float], centres: int) -> tuple[dict[tuple, np.ndarray], dict[tuple, np.ndarray]]:
    """The centres by (g, fold) and the weights by (g, fold, sigma, ridge) of fits to the rates outside each fold; folds with fewer than four wells outside have none."""
    at = spread(rows, {k: n for k, n in sizes.items() if n >= 4}, centres)

    def part(frame: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
        for g, own in frame.groupby("g"):
            xy, v, fold = own[["x", "y"]].to_numpy(float), own["rate"].to_numpy(float), own["fold"].to_numpy()
            for (h, f), c in at.items():
                train = fold != f
                if h == g and train.any():
                    for s in sigmas:
                        yield (int(g), int(f), s), normal_sums(basis(xy[train], c, s), v[train])

    sums = totals(rows.select("g", "fold", "x", "y", "rate"), part, "g int, fold int, sigma double")
    return at, {(g, f, s, r): solved(own, 1 + len(at[g, f]), r)[:, 0] for (g, f, s), own in sums.items() for r in ridges}


def replay(matrix: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filled rows after the rounds of ``models.svd_impute`` whose leading directions of epochs are ``turns``; also those of the round before, and which cells are there."""
    there = np.isfinite(matrix)
    n, total = there.sum(axis=1), np.where(there, matrix, 0.0).sum(axis=1)
    filled = np.where(there, matrix, np.divide(total, n, out=np.zeros(len(matrix)), where=n > 0)[:, None])
    before = filled
    for v in turns:
        before, filled = filled, np.where(there, matrix, filled @ v @ v.T)
    return filled, before, there


def directions(rows: DataFrame, sizes: dict[tuple, int], ranks: list[int], width: int, rounds: int, tolerance: float) -> dict[tuple, list[np.ndarray]]:
    """By (rank, fold) the directions of each round of ``models.svd_impute`` on the wells outside the fold, then the last ones.

    A row's next filling is its projection on the leading right singular vectors, which are eigenvectors of the sum of
    products of epochs. So a round is a pass that adds up those products; rows go through the rounds before again.
    """
    turns: dict[tuple, list[np.ndarray]] = {(k, f): [] for k in ranks for (_, f), n in sizes.items() if n >= max(4, k + 1)}
    done: dict[tuple, list[np.ndarray]] = {}
    for i in range(rounds + 1):
        if not turns:
            break

        def part(frame: pd.DataFrame, turns: dict[tuple, list[np.ndarray]] = turns) -> Iterator[tuple[tuple, np.ndarray]]:
            matrix, fold = np.stack(frame["series"].to_numpy()), frame["fold"].to_numpy()
            for (k, f), own in turns.items():
                filled, before, there = replay(matrix[fold != f], own)
                yield (k, int(f)), np.concatenate([(filled.T @ filled).ravel(), [((filled - before) ** 2).sum(), (~there).sum(), there.sum()]])

        for key, sums in totals(rows.select("fold", "series"), part, "rank int, fold int").items():
            moved, missing, there = sums[-3:]
            if not there:
                raise ValueError("a matrix without a value")
            n = sizes[0, key[1]]
            r = min(key[0], n, width, max(1, n - 1))
            turns[key].append(np.linalg.eigh(sums[:-3].reshape(width, width))[1][:, ::-1][:, :r])
            if not missing or i == rounds or i and moved / missing < tolerance:
                done[key] = turns[key]
        turns = {k: v for k, v in turns.items() if k not in done}
    return done


def harmonics(matrix: np.ndarray, days: np.ndarray, period: float = 365.2425) -> tuple[np.ndarray, np.ndarray]:
    """``models.harmonics_of``, a batch of rows at once."""
    t = (days - days[0]) / period
    X, there = np.column_stack([np.ones_like(t), t, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)]), np.isfinite(matrix)
    n = there.sum(axis=1)
    if there.all():  # one basis for all rows
        b = matrix @ np.linalg.pinv(X).T
        return (b[:, 3] + 1j * b[:, 2], b[:, 1]) if len(t) >= 6 else (np.full(len(b), np.nan, complex), np.full(len(b), np.nan))
    b = (np.linalg.pinv(X * there[:, :, None], rcond=np.finfo(float).eps * np.maximum(n, 4)) @ np.where(there, matrix, 0.0)[:, :, None])[:, :, 0]
    return np.where(n >= 6, b[:, 3] + 1j * b[:, 2], np.nan), np.where(n >= 6, b[:, 1], np.nan)


def field_cv(wells: DataFrame, days: np.ndarray, *, ranks: list[int], sigmas: list[float], ridges: list[float], folds: int = 5, block: float = 30.0, seed: int = 20260919, centres: int = 32, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """``models.field_cv`` of wells that are rows: id, x, y and series, an array of values at ``days`` with NaN for none."""
    from terrachron.operators.models import CV_SCHEMA

    spark, width, days = wells.sparkSession, len(days), np.asarray(days, float)
    if wells.isEmpty():
        raise ValueError("no wells")
    rows = with_folds(wells.select(F.lit(0).alias("g"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "series"), block, folds, seed)
    path = shared_folder(spark, "folds")  # read by every pass
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes = training_sizes(rows)
    turns = directions(rows, sizes, ranks, width, rounds, tolerance)
    at = {f: c for (_, f), c in spread(rows, {k: n for k, n in sizes.items() if n >= 4}, centres).items()}

    def fit(frame: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
        matrix, xy, fold = np.stack(frame["series"].to_numpy()), frame[["x", "y"]].to_numpy(float), frame["fold"].to_numpy()
        for f in {f for _, f in turns}:
            train = fold != f
            B = {s: basis(xy[train], at[f], s) for s in sigmas}
            for k in [k for k, g in turns if g == f]:
                scores = replay(matrix[train], turns[k, f][:-1])[0] @ turns[k, f][-1]
                for s in sigmas:
                    yield (k, int(f), s), normal_sums(B[s], scores)

    slim = rows.select("x", "y", "fold", "series")
    fitted = totals(slim, fit, "rank int, fold int, sigma double")
    weights = {(k, f, s, r): solved(own, 1 + len(at[f]), r) for (k, f, s), own in fitted.items() for r in ridges}

    def test(frame: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
        for f, own in frame.groupby("fold"):
            matrix, xy = np.stack(own["series"].to_numpy()), own[["x", "y"]].to_numpy(float)
            a, ta = harmonics(matrix, days)
            for (k, g, s, r), w in weights.items():
                if g != f:
                    continue
                predicted = basis(xy, at[f], s) @ w @ turns[k, f][-1].T
                e = (predicted - matrix)[np.isfinite(matrix)]
                p, tp = harmonics(predicted, days)
                ok = np.isfinite(a) & np.isfinite(p)
                turn = np.abs(np.angle(p[ok] / np.where(a[ok] == 0, 1, a[ok]))) / (2 * np.pi) * 365.2425
                yield (k, s, r), np.array([(e**2).sum(), len(e), ((np.abs(p[ok]) - np.abs(a[ok])) ** 2).sum(), turn.sum(), (np.abs(p[ok] - a[ok]) ** 2).sum(), ((tp - ta)[ok] ** 2).sum(), ok.sum()])

    sums, out = totals(slim, test, "rank int, sigma double, ridge double"), []
    for k, s, r in [(k, float(s), float(r)) for k in ranks for s in sigmas for r in ridges]:
        e2, n, amplitude, turn, vector, trend, m = sums.get((k, s, r), np.zeros(7)).tolist()
        rms = lambda v, n: (v / n) ** 0.5 if n else None
        out.append((k, s, r, rms(e2, n), rms(amplitude, m), turn / m if m else None, rms(vector, m), rms(trend, m), int(n)))
    return spark.createDataFrame(out, CV_SCHEMA)
