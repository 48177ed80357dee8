"""Models, near sites, solvers and rasters against independent computations on small inputs."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from terrachron.functions.basis import TimeModel
from terrachron.operators import diagnostics, lsq, models, spatial
from terrachron.sources import rasters, tables


def test_imputation_goes_on_until_missing_cells_stand_still():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=(8, 2)) @ rng.normal(size=(2, 30))
    seen = np.where(rng.random(truth.shape) < 0.15, np.nan, truth)
    missing = np.isnan(seen)
    filled = np.where(missing, np.nanmean(seen, axis=1)[:, None], seen)
    for _ in range(200):  # written out: replace, compare with the values before
        u, s, vt = np.linalg.svd(filled, full_matrices=False)
        new = (u[:, :2] * s[:2]) @ vt[:2]
        moved = np.mean((new - filled)[missing] ** 2)
        filled = np.where(missing, new, seen)
        if moved < 1e-6:
            break
    scores, components = models.svd_impute(seen, 2, rounds=200)
    u, s, vt = np.linalg.svd(filled, full_matrices=False)
    assert np.allclose(scores @ components, (u[:, :2] * s[:2]) @ vt[:2], atol=1e-9)
    assert np.abs(scores @ components - truth)[missing].max() < 0.05 * np.abs(truth).max()
    with pytest.raises(ValueError):
        models.svd_impute(np.full((2, 2), np.nan), 1)


def test_centres_start_at_the_least_sum():
    xy = np.array([[5.0, 5], [0, 9], [1, 1], [9, 9], [9, 0]])
    assert models.spread_centres(xy, 3).tolist() == [[1, 1], [9, 9], [0, 9]]
    assert len(models.spread_centres(xy, 99)) == 5


def test_change_models_are_validated_out_of_fold(spark):
    """Each station's prediction comes from a model that has not seen its fold; written again from the formulas."""
    rng = np.random.default_rng(11)
    xy = np.array([(3.0 * i, 3.0 * j) for i in range(4) for j in range(3)])
    v = 1 + 0.2 * xy[:, 0] - 0.1 * xy[:, 1] + rng.normal(0, 0.05, 12)
    rows = [(f"S{k:02d}", year, float(x), float(y), float(r) * (year - 1999)) for year in (2000, 2001) for k, ((x, y), r) in enumerate(zip(xy, v, strict=True))]
    out = models.change_cv(spark.createDataFrame(rows, "station_id string, year1 int, x double, y double, rate double"), sigmas=[4.0], ridges=[0.1], block=3.0, folds=3)
    got = {(r["station_id"], r["year1"]): (r["predicted"], r["fold"]) for r in out.collect()}
    assert len(got) == 24 and {f for _, f in got.values()} == {0, 1, 2}
    for (name, year), (predicted, fold) in got.items():
        train = np.array([got[f"S{k:02d}", year][1] != fold for k in range(12)])
        centres = models.spread_centres(xy[train], 32)
        B = lambda p, c=centres: np.column_stack([np.ones(len(p)), np.exp(-0.5 * ((p[:, None] - c[None]) ** 2).sum(axis=2) / 16)])
        A, y = B(xy[train]), v[train] * (year - 1999)
        w = np.linalg.solve(A.T @ A + 0.1 * np.diag([0.0, *np.ones(len(centres))]), A.T @ y)
        assert predicted == pytest.approx(float((B(xy[[int(name[1:])]]) @ w)[0]), abs=1e-8)
    summary = models.change_cv_summary(out).first()
    errors = [p - v[int(n[1:])] * (y - 1999) for (n, y), (p, _) in got.items()]
    assert summary["n_validation"] == 24 and summary["n_intervals"] == 2 and summary["cv_rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_majority_of_f_tests(spark):
    """The share of series whose larger model is significant, by a numerical integral of the F density."""
    rng = np.random.default_rng(12)
    t = np.arange(0, 3000, 60)
    rows = [(k, int(d), float(rng.normal() + (k % 3 == 0) * (d / 600) ** 2)) for k in range(30) for d in t]
    df = spark.createDataFrame(rows, "k int, day int, value double")
    small, large = (lsq.fit(df, ["k"], TimeModel(0, n)) for n in (1, 2))
    got = diagnostics.f_test_share(small, large, ["k"], 4, 5).first()
    a, b = ({r["k"]: r["rss"] for r in f.collect()} for f in (small, large))
    m = len(t) - 5
    x = np.linspace(0, 1, 400_001)[1:-1]
    density = x ** (m / 2 - 1) * (1 - x) ** -0.5  # of the beta distribution that F with 1 and m degrees goes over to
    whole = np.cumsum(density) / density.sum()
    tail = [np.interp(m / (m + (a[k] - b[k]) / (b[k] / m)), x, whole) for k in a]
    assert got["n_valid"] == 30 and got["share"] == pytest.approx(np.mean(np.array(tail) < 0.05)) and got["degree"] == (2 if got["share"] > 0.5 else 1)


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_exact_quantiles(spark, most):
    """The same as numpy's, with ties, few values and rounds of narrowing."""
    rng = np.random.default_rng(13)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 7.0], [500, 1, 499]), np.array([3.0]), np.full(200, 4.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "value double")
        qs = [0.0, 0.02, 0.5, 0.9, 1.0]
        assert np.allclose(diagnostics.exact_quantiles(df, "value", qs, most=most), np.quantile(values, qs), rtol=1e-12, atol=0)
    assert diagnostics.exact_quantiles(df.limit(0), "value", [0.5]) == [None]


def test_scores_of_clusters():
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(c, 0.4, size=(n, 3)) for c, n in ((0, 20), (3, 35), (6, 11))])
    own = np.repeat([0, 1, 2], [20, 35, 11])
    own[0] = 1
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    want = []
    for i in range(len(X)):
        a = D[i][(own == own[i]) & (np.arange(len(X)) != i)].mean()
        b = min(D[i][own == c].mean() for c in range(3) if c != own[i])
        want.append((b - a) / max(a, b))
    assert np.allclose(models.silhouettes(X, own, np.arange(len(X))), want, atol=1e-6)
    centres = np.array([X[own == c].mean(axis=0) for c in range(3)])
    wide = [np.sqrt(((X[own == c] - centres[c]) ** 2).sum(axis=1)).mean() for c in range(3)]
    db = np.mean([max((wide[i] + wide[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i) for i in range(3)])
    between = sum((own == c).sum() * ((centres[c] - X.mean(axis=0)) ** 2).sum() for c in range(3)) / 2
    within = sum(((X[own == c] - centres[c]) ** 2).sum() for c in range(3)) / (len(X) - 3)
    assert np.allclose(models.separation(X, own), (between / within, db))


def test_regimes_find_clusters_and_take_a_fixed_number(spark):
    rng = np.random.default_rng(3)
    truth = np.repeat([0, 1, 2], 60)
    X = rng.normal(size=(180, 2)) * 0.3 + np.array([[0, 0], [8, 1], [1, 9]])[truth]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)] + [(999, None, 1.0)], "pixel_id long, a double, b double")
    out, table = models.regimes(df, ["a", "b"], ks=(2, 3, 4), starts=4, final_starts=4)
    got = {r["pixel_id"]: r["cluster_id"] for r in out.collect()}
    assert 999 not in got and len({(truth[i], c) for i, c in got.items()}) == 3
    assert [r["k"] for r in table.orderBy("silhouette", ascending=False).collect()][0] == 3
    two, _ = models.regimes(df, ["a", "b"], ks=(2, 3), k=2, starts=2, final_starts=2)
    assert {r["cluster_id"] for r in two.collect()} == {1, 2}


def test_balanced_sample(spark):
    df = spatial.pixel_grid(spark.range(400).withColumnRenamed("id", "pixel_id"), 20)
    assert models.balanced_sample(df, 2, 4, 1000, least=10).count() == 50
    assert models.balanced_sample(df, 2, 4, 30, least=10).count() == 30
    assert models.balanced_sample(df, 10, 10, 1000, least=100).count() == 400  # too few: all


def test_bounded_ratio(spark):
    """The same minimum by another way: every subset of bounds tried out on few nodes."""
    rng = np.random.default_rng(4)
    cells = pd.DataFrame({"x": rng.uniform(0, 30, 40), "y": rng.uniform(0, 30, 40), "q2": rng.uniform(0.5, 3, 40)})
    cells["qd"] = cells["q2"] * (0.002 + 0.06 * (cells["x"] > 15)) + rng.normal(0, 1e-3, 40)
    cells["d2"], cells["w"] = cells["qd"] ** 2 / cells["q2"] + 1e-6, 1.0
    xy = cells[["x", "y"]].to_numpy()
    nodes = models.node_grid(xy, 15.0, 30.0)
    assert {tuple(n) for n in nodes} == {(x, y) for x in (0.0, 15, 30) for y in (0.0, 15, 30)}
    assert {tuple(n) for n in models.node_grid(np.array([[1.0, 1]]), 15.0, 16.0, None, (0, 60, 0, 60))} == {(0, 0), (15, 0), (0, 15)}
    got = models.regularised_ratio(cells, nodes, spacing=15.0, lam=0.1, high=0.05)
    d = np.sqrt(((xy[:, None] - nodes[None]) ** 2).sum(axis=2))
    B = np.exp(-0.5 * (d / 22.5) ** 2)
    B /= B.sum(axis=1, keepdims=True)  # nine nodes: all are among the twelve nearest

    def loss(v):
        fit = (cells["q2"] / cells["q2"].median() * (cells["qd"] / cells["q2"] - B @ v) ** 2).sum()
        smooth = sum((v[i] - v[j]) ** 2 for i in range(9) for j in range(i) if np.hypot(*(nodes[i] - nodes[j])) <= 22.5)
        return fit + 0.1 * smooth

    best = loss(got)
    assert (got >= 0).all() and (got <= 0.05).all() and got.max() > 0.0499
    for _ in range(3000):
        assert loss(np.clip(got + rng.normal(0, 10 ** rng.uniform(-6, -2), 9), 0, 0.05)) >= best - 1e-12
    cv = models.regularised_cv(spark, cells, spacings=(10, 15), lams=(0.1, 10), block=10.0)
    rows = {(r["spacing"], r["lam"]): r for r in cv.collect()}
    assert len(rows) == 4 and all(r["tested_cells"] == 40 and r["cv_rmse"] > 0 for r in rows.values())
    assert models.best_regularised(cv).first()["cv_rmse"] == min(r["cv_rmse"] for r in rows.values())


@pytest.mark.parametrize("kind", ["spread", "clustered", "one", "line"])
def test_near_sites_against_all_pairs(spark, kind):
    rng = np.random.default_rng(5)
    sites = {"spread": rng.uniform(0, 100, (60, 2)), "clustered": np.vstack([rng.normal(20, 0.01, (50, 2)), [[90, 90], [20, 90]]]), "one": np.array([[3.0, 4]]), "line": np.column_stack([np.arange(30) * 2.0, np.zeros(30)])}[kind]
    points = np.vstack([rng.uniform(-50, 150, (80, 2)), sites[:3], [[1e4, -1e4]]])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "pixel_id long, x double, y double")
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "site_id int, sx double, sy double")
    d = np.hypot(points[:, None, 0] - sites[None, :, 0], points[:, None, 1] - sites[None, :, 1])
    got = {r["pixel_id"]: (r["site_id"], r["distance"]) for r in spatial.nearest_site(p, s).collect()}
    assert len(got) == len(points)
    for i in range(len(points)):
        assert got[i][1] == pytest.approx(d[i].min(), rel=1e-12) and d[i][got[i][0]] == pytest.approx(d[i].min(), rel=1e-12)
    k = min(7, len(sites))
    near = spatial.knn_weights(p, s, 7, 10.0).toPandas()
    for i, own in near.groupby("pixel_id"):
        assert np.allclose(np.sort(own["distance"]), np.sort(d[i])[:k]) and abs(own["weight"].sum() - 1) < 1e-9
    assert near["pixel_id"].nunique() == len(points)
    assert spatial.nearest_site(p, s.limit(0)).count() == 0 and spatial.nearest_site(p.limit(0), s).count() == 0


def test_one_rule_for_singular_fits(spark):
    """A rank-deficient design is null with few and with many coefficients; a regular one is the least-squares fit."""
    rng = np.random.default_rng(6)
    days = np.arange(40) * 9.0
    rows = [("good", float(t), float(v)) for t, v in zip(days, rng.normal(size=40), strict=True)] + [("same", 5.0, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, day double, value double")
    for n in (2, 5, 6, 8):
        columns = ["CAST(1 AS DOUBLE)", "day / 100", *(f"{'sin' if i % 2 else 'cos'}(day / {20 + 9 * i})" for i in range(n - 2))]
        got = {r["k"]: r for r in lsq.fit_columns(df, ["k"], columns).collect()}
        X = np.column_stack([np.ones(40), days / 100, *((np.sin if i % 2 else np.cos)(days / (20 + 9 * i)) for i in range(n - 2))])
        y = np.array([v for k, _, v in rows if k == "good"])
        want = np.linalg.lstsq(X, y, rcond=None)[0]
        assert np.allclose([got["good"][f"beta{i}"] for i in range(n)], want, atol=1e-8)
        assert got["good"]["rss"] == pytest.approx(((y - X @ want) ** 2).sum(), rel=1e-8)
        assert got["same"]["beta0"] is None and got["same"]["rss"] is None and got["same"]["n"] == 40


def test_nested_fits_are_the_two_fits(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(k, int(t), float(v)) for k in (1, 2) for t, v in zip(range(0, 3000, 40), rng.normal(size=75), strict=True)], "k int, day int, value double")
    large, small = TimeModel(0, 2), TimeModel(0, 1)
    both = {r["k"]: r for r in lsq.fit_nested(df, ["k"], large, small, min_obs=20).collect()}
    for model, prefix in ((large, ""), (small, "small_")):
        for r in lsq.fit(df, ["k"], model, min_obs=20).collect():
            assert both[r["k"]][f"{prefix}rss"] == pytest.approx(r["rss"], rel=1e-12)
            assert all(both[r["k"]][f"{prefix}beta{i}"] == pytest.approx(r[f"beta{i}"], rel=1e-9) for i in range(model.size))


def pack_lzw(data: bytes) -> bytes:
    """An LZW strip by the text of the format: 9 bits on, one code early, a clear code when the table is full."""
    codes, table, wide, bits, size = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, 0, 258
    held = b""
    for b in data:
        if held + bytes([b]) in table:
            held += bytes([b])
            continue
        codes.append((table[held], wide))
        table[held + bytes([b])] = size
        size += 1
        wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, wide))
            table, size, wide = {bytes([i]): i for i in range(256)}, 258, 9
        held = bytes([b])
    if held:
        codes.append((table[held], wide))
        size += 1
        wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, wide))
    for code, w in codes:
        bits = bits << w | code
    total = sum(w for _, w in codes)
    return (bits << -total % 8).to_bytes((total + 7) // 8, "big")


def pack_bits(data: bytes) -> bytes:
    out, i = b"", 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out, i = out + bytes([257 - run, data[i]]), i + run
        else:
            part = data[i : i + 3]
            out, i = out + bytes([len(part) - 1]) + part, i + len(part)
    return out


def make_tiff(bands: np.ndarray, *, order: str = "<", packing: int = 1, predictor: int = 1, tile: int | None = None, rows: int = 5, apart: bool = False, big: bool = False) -> bytes:
    """A TIFF of bands x height x width, as the format describes it."""
    n, h, w = bands.shape
    dtype = bands.dtype.newbyteorder(order)
    th, tw = (tile, tile) if tile else (rows, w)
    parts = []
    for group in ([bands[i : i + 1] for i in range(n)] if apart else [bands]):
        for top in range(0, h, th):
            for left in range(0, w, tw):
                block = group[:, top : top + th, left : left + tw].transpose(1, 2, 0)
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                raw = np.ascontiguousarray(block.astype(dtype)).tobytes()
                if predictor == 3:
                    size, deep = bands.dtype.itemsize, block.shape[2]
                    octets = np.frombuffer(np.ascontiguousarray(block.astype(bands.dtype.newbyteorder(">"))).tobytes(), np.uint8).reshape(block.shape[0], -1, size)
                    planes = octets.transpose(0, 2, 1).reshape(block.shape[0], -1, deep)
                    raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8).tobytes()
                parts.append({1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}[packing](raw))
    start = 16 if big else 8
    offsets = [start + sum(map(len, parts[:i])) for i in range(len(parts))]
    at = start + sum(map(len, parts))
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [bands.dtype.itemsize * 8] * n), 259: (3, [packing]), 277: (3, [n]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [kind] * n)}
    entries |= {322: (4, [tw]), 323: (4, [th]), 324: (4, offsets), 325: (4, list(map(len, parts)))} if tile else {278: (4, [th]), 273: (4, offsets), 279: (4, list(map(len, parts)))}
    body, extra, inline, word = b"", b"", 8 if big else 4, "Q" if big else "I"
    after = at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
    for tag, (form, values) in sorted(entries.items()):
        raw = struct.pack(order + {3: "H", 4: "I"}[form] * len(values), *values)
        if len(raw) > inline:
            field, extra = struct.pack(order + word, after + len(extra)), extra + raw
        else:
            field = raw.ljust(inline, b"\0")
        body += struct.pack(order + "HH" + word, tag, form, len(values)) + field
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + b"".join(parts) + struct.pack(order + ("Q" if big else "H"), len(entries)) + body + b"\0" * inline + extra


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiffs_of_every_form(packing, order):
    rng = np.random.default_rng(8)
    smooth = np.cumsum(np.cumsum(rng.normal(size=(3, 23, 37)), axis=1), axis=2)
    for dtype in ("f4", "f8", "u1", "i2", "u2"):
        bands = smooth.astype(dtype) if dtype[0] == "f" else np.abs(smooth * 9 % 120).astype(dtype)
        for predictor in (1, 3) if dtype[0] == "f" else (1, 2):
            for options in ({}, {"tile": 16}, {"apart": True}, {"tile": 16, "apart": True, "big": True}):
                data = make_tiff(bands, order=order, packing=packing, predictor=predictor, **options)
                for band in range(3):
                    assert np.array_equal(rasters.decode_tiff(data, band)[0], bands[band])
                file = rasters.Tiff(lambda o, s, data=data: data[o : o + s])
                assert np.array_equal(file.window(7, 19, 11, 30, 1), bands[1, 7:19, 11:30])
    with pytest.raises(ValueError, match="bands"):
        rasters.decode_tiff(make_tiff(smooth.astype("f4")))
    with pytest.raises(ValueError):
        rasters.decode_tiff(make_tiff(smooth[:1].astype("f4")).replace(struct.pack("<HHII", 317, 3, 1, 1), struct.pack("<HHII", 317, 3, 1, 7)))


def test_long_lzw_strips_clear_their_table():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 40, 60_000, dtype=np.uint8).tobytes()
    assert rasters.unpack_lzw(pack_lzw(data)) == data
    with pytest.raises(ValueError):
        rasters.unpack_lzw(b"\xff" * 40)


def test_a_window_reads_its_strips_only(spark, tmp_path):
    values = np.arange(2000 * 30, dtype="f4").reshape(2000, 30)
    grid = rasters.Grid(2000, 30, (0.5, 0.0, 10.0, 0.0, -0.5, 50.0), "EPSG:4326", -9999.0)
    data, asked = rasters.encode_tiff(values, grid), []
    file = rasters.Tiff(lambda o, s: (asked.append(s), data[o : o + s])[1])
    asked.clear()
    assert np.array_equal(file.window(706, 720, 3, 9), values[706:720, 3:9]) and len(asked) == 1
    (tmp_path / "r.tif").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "r.tif"),)], "path string")
    got = rasters.read_rasters(files, grid, window=(500, 520, 0, 30)).toPandas()
    assert np.array_equal(got.sort_values("pixel_id")["value"], values[500:520].ravel())
    assert rasters.read_rasters(files, grid).count() == 60_000
    with pytest.raises(Exception, match="geometry"):
        rasters.read_rasters(files, rasters.Grid(2000, 31, grid.affine)).count()


def test_rasters_and_notes_go_where_spark_writes(spark, tmp_path):
    grid = rasters.Grid(150, 7, (0.5, 0.0, 10.0, 0.0, -0.5, 50.0), "EPSG:32650")
    rows = [(i, float(i * i)) for i in range(0, 1050, 3)] + [(5000, 1.0), (4, None)]
    rasters.write_raster(spark.createDataFrame(rows, "pixel_id long, value double"), f"file://{tmp_path}/out.tif", grid)
    values, own = rasters.decode_tiff((tmp_path / "out.tif").read_bytes())
    assert own.crs == "EPSG:32650" and own.affine == grid.affine
    want = np.full(1050, np.nan, "f4")
    want[0:1050:3] = [i * i for i in range(0, 1050, 3)]
    assert np.array_equal(values.ravel(), want, equal_nan=True) and [p.name for p in tmp_path.iterdir() if "strips" in p.name] == []
    tables.write_json({"lag": 5, "text": "ä"}, f"file://{tmp_path}/a/b.json", spark)
    assert tables.read_json(f"file://{tmp_path}/a/b.json", spark) == tables.read_json(str(tmp_path / "a" / "b.json")) == {"lag": 5, "text": "ä"}


def test_block_sample_is_evenly_spaced(spark):
    df = spark.range(1000).selectExpr("id AS pixel_id", "id % 3 AS block_id").crossJoin(spark.range(12).withColumnRenamed("id", "day")).selectExpr("*", "CASE WHEN pixel_id = 30 THEN NULL ELSE 1.0 END AS value")
    got = spatial.block_sample(df, 12, 1000, each=50).collect()
    for b in range(3):
        own = sorted(r["pixel_id"] for r in got if r["block_id"] == b)
        every = [i for i in range(1000) if i % 3 == b and i != 30]
        assert own == [every[int(i)] for i in np.floor(np.arange(50) * (len(every) - 1) / 49)]
    assert spatial.block_sample(df, 12, 70, each=50).count() == 70
