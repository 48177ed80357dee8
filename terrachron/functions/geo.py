"""Grids, areas, projections and kernels as Columns."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = sqrt(E2)
N = FLATTENING / (2 - FLATTENING)


def centre(row: Column, col: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = affine
    x, y = col + 0.5, row + 0.5
    return a * x + b * y + c, d * x + e * y + f


def row_col(x: Column, y: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """The pixel that holds a point."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return F.floor((a * (y - f) - d * (x - c)) / det), F.floor((e * (x - c) - b * (y - f)) / det)


def projected_area(affine: tuple[float, ...], unit: float = 1.0) -> float:
    a, b, _, d, e, _ = affine
    return abs(a * e - b * d) * unit**2


def zone_area(lat: Column) -> Column:
    """Authalic integral: the area between the equator and a latitude, for a radian of longitude."""
    s = F.sin(F.radians(lat))
    return F.lit(A * A * (1 - E2) / 2) * (s / (1 - E2 * s * s) + F.lit(0.5 / E) * F.ln((1 + E * s) / (1 - E * s)))


def geographic_area(lat_top: Column, lat_bottom: Column, width_degrees: float) -> Column:
    return F.abs(zone_area(lat_top) - zone_area(lat_bottom)) * F.radians(F.lit(abs(width_degrees)))


def utm_zone(lon: float) -> int:
    return int((lon + 180) // 6) + 1


def utm_epsg(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + utm_zone(lon)


def utm_epsg_of(lon: Column, lat: Column) -> Column:
    """``utm_epsg`` of each row."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + F.floor((lon + 180) / 6) + 1


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the third order in n."""
    k0, a1 = 0.9996, A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
    alpha = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
    s = F.sin(F.radians(lat))
    c = 2 * sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    dl = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + k0 * a1 * east, (10_000_000 if south else 0) + k0 * a1 * north


def lonlat(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing: the inverse of ``utm``, by Krueger's inverse series to the third order in n."""
    k0, a1 = 0.9996, A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
    beta = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
    delta = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
    xi, eta = (north - (10_000_000 if south else 0)) / (k0 * a1), (east - 500000) / (k0 * a1)
    x1 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    e1 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(x1) / F.cosh(e1))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return F.lit(zone * 6 - 183) + F.degrees(F.atan2(F.sinh(e1), F.cos(x1))), F.degrees(lat)


def gaussian(distance: Column, sigma: Column | float) -> Column:
    return F.exp(-0.5 * F.pow(distance / sigma, 2))


def block_id(v: Column, low: Column, size: float) -> Column:
    return F.floor((v - low) / size)


def legacy_fold(ix: Column, iy: Column, folds: int = 5) -> Column:
    return F.pmod(ix + 2 * iy, F.lit(folds))


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Crossing parity; the ring may be open or closed."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 != y1:
            hit = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise, by monotone chain."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(q: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return half(p) + half(p[::-1])


def inside_hull(x: Column, y: Column, hull: list[tuple[float, float]], tolerance: float = 1e-9) -> Column:
    """On or inside a convex hull; with fewer than three corners everything is."""
    if len(hull) < 3:
        return F.lit(True)
    out = F.lit(True)
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1], strict=True):
        out = out & ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) >= -tolerance)
    return out


