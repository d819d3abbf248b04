"""Plane and globe geometry: corridors, grid keys, Web Mercator, UTM, polygon clipping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The WGS 84 ellipsoid and the metres of a degree that the corridor's local metric uses.
WGS84_A, WGS84_F, DEGREE_M = 6378137.0, 1 / 298.257223563, 111_320.0


def segment_distance(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance to a segment, by the clamped projection; to the point where the segment has no length."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    squared = dx * dx + dy * dy
    t = F.when(squared == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a[0]) * dx + (py - a[1]) * dy) / squared)))
    ex, ey = px - (a[0] + t * dx), py - (a[1] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def inside_corridor(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column], half: float) -> Column:
    """A band of square ends, half its width past both; a square where the ends are one point."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = F.sqrt(dx * dx + dy * dy)
    along = ((px - a[0]) * dx + (py - a[1]) * dy) / length
    across = ((px - a[0]) * dy - (py - a[1]) * dx) / length
    square = (F.abs(px - a[0]) <= half) & (F.abs(py - a[1]) <= half)
    return F.when(length == 0, square).otherwise((along >= -half) & (along <= length + half) & (F.abs(across) <= half))


def local_metres(lat: Column, lon: Column, lat0: float, lon0: float, mean_lat: float) -> tuple[Column, Column]:
    """Metres east and north of a point, in the local metric of a mean latitude."""
    scale = max(math.cos(math.radians(mean_lat)), 0.1)
    return (lon - lon0) * F.lit(DEGREE_M * scale), (lat - lat0) * F.lit(DEGREE_M)


def mercator(lon: Column, lat: Column, radius: float = WGS84_A) -> tuple[Column, Column]:
    """Web Mercator metres."""
    return F.radians(lon) * radius, F.asinh(F.tan(F.radians(lat))) * radius


def mercator_inverse(x: Column, y: Column, radius: float = WGS84_A) -> tuple[Column, Column]:
    return F.degrees(x / radius), F.degrees(F.atan(F.sinh(y / radius)))


def norwegian_zone(lon: Column) -> Column:
    """UTM zone 31 to 36 by longitude; zone 34 is mapped in 33."""
    z = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(31)), F.lit(36)).cast("int")
    return F.when(z == 34, 33).otherwise(z)


def _krueger() -> tuple[float, list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, alpha, beta


def utm_forward(lon: np.ndarray, lat: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """easting and northing by Krueger's series, to a tenth of a millimetre within a zone; south of the equator
    northings run on below zero from the northern origin."""
    radius, alpha, _ = _krueger()
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * x, 0.9996 * radius * y


def utm_inverse(east: np.ndarray, north: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    radius, _, beta = _krueger()
    e2 = WGS84_F * (2 - WGS84_F)
    xi, eta = north / (0.9996 * radius), (east - 500_000) / (0.9996 * radius)
    x, y = xi.copy(), eta.copy()
    for j, b in enumerate(beta, 1):
        x -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        y -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    tau = np.sin(x) / np.hypot(np.sinh(y), np.cos(x))
    goal = tau.copy()
    for _ in range(6):
        sigma = np.sinh(math.sqrt(e2) * np.arctanh(math.sqrt(e2) * tau / np.hypot(1, tau)))
        back = tau * np.hypot(1, sigma) - sigma * np.hypot(1, tau)
        tau += (goal - back) / np.hypot(1, back) * (1 + (1 - e2) * tau**2) / ((1 - e2) * np.hypot(1, tau))
    return np.degrees(np.arctan2(np.sinh(y), np.cos(x))) + (6 * zone - 183), np.degrees(np.arctan(tau))


@pandas_udf(T.StructType([T.StructField("east", T.DoubleType()), T.StructField("north", T.DoubleType())]))
def utm(lon: pd.Series, lat: pd.Series, zone: pd.Series) -> pd.DataFrame:
    e, n = utm_forward(lon.to_numpy(float), lat.to_numpy(float), zone.to_numpy(float))
    return pd.DataFrame({"east": e, "north": n})


def clip_area(ring: list[tuple[float, float]], west: float, south: float, east: float, north: float) -> float:
    """Area of a polygon within a rectangle, by clipping at each side in turn. Holes are rings to be taken off."""
    points = list(ring)
    for axis, limit, keep_less in ((0, west, False), (0, east, True), (1, south, False), (1, north, True)):
        inside = (lambda p: p[axis] <= limit) if keep_less else (lambda p: p[axis] >= limit)  # noqa: B023
        out = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            if inside(p) != inside(q):
                t = (limit - p[axis]) / (q[axis] - p[axis])
                cross = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                cross[axis] = limit
                out += [p, tuple(cross)] if inside(p) else [tuple(cross)]
            elif inside(p):
                out.append(p)
        points = out
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def overlap_udf(ring: list[tuple[float, float]]):
    """Area of a polygon over each cell's rectangle, as an Arrow function."""

    @pandas_udf("double")
    def area(west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
        return pd.Series([clip_area(ring, *r) for r in zip(west, south, east, north, strict=True)])

    return area


def buffer_ring(x: float, y: float, radius: float, corners: int = 64) -> list[tuple[float, float]]:
    """a round buffer as a polygon of so many corners."""
    return [(x + radius * math.cos(2 * math.pi * k / corners), y + radius * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def nice_resolution(least: float) -> float:
    """the least of 1, 2, 5 times a power of ten that isn't below `least`."""
    power = 10.0 ** math.floor(math.log10(least))
    return next(m * power for m in (1.0, 2.0, 5.0, 10.0) if m * power >= least * (1 - 1e-12))


def axis_pixels(low: float, high: float, resolution: float) -> int:
    """pixels along an axis; a remainder of rounding makes no pixel."""
    n = (high - low) / resolution
    return max(1, round(n) if abs(n - round(n)) < 1e-6 else math.ceil(n))


def download_tiles(west: float, south: float, east: float, north: float, resolution: float, most_pixels: int = 2048, most_tiles: int = 64) -> tuple[float, list[tuple[float, float, float, float]]]:
    """Tiles of at most so many pixels a side that cover the bounds; the resolution is coarsened along the
    ladder until there are few enough."""
    for _ in range(12):
        side = most_pixels * resolution
        nx, ny = max(1, math.ceil((east - west) / side - 1e-9)), max(1, math.ceil((north - south) / side - 1e-9))
        if nx * ny <= most_tiles:
            break
        resolution = nice_resolution(resolution * 1.01)
    return resolution, [(west + i * side, south + j * side, min(west + (i + 1) * side, east), min(south + (j + 1) * side, north)) for j in range(ny) for i in range(nx)]


def simplify(line: list[tuple[float, float]], tolerance: float = 7.0) -> list[tuple[float, float]]:
    """Douglas-Peucker, then the direction that begins at the lesser end."""

    def keep(a: int, b: int) -> list[int]:
        (x1, y1), (x2, y2) = line[a], line[b]
        norm = math.hypot(x2 - x1, y2 - y1)
        far = [(abs((x2 - x1) * (y1 - line[i][1]) - (x1 - line[i][0]) * (y2 - y1)) / norm if norm else math.hypot(line[i][0] - x1, line[i][1] - y1), -i) for i in range(a + 1, b)]
        if not far or max(far)[0] <= tolerance:
            return []
        at = -max(far)[1]
        return [*keep(a, at), at, *keep(at, b)]

    out = [line[0], *(line[i] for i in keep(0, len(line) - 1)), line[-1]]
    return out if out[0] <= out[-1] else out[::-1]


def backoff_seconds(failures: int, retry_after: float | None = None) -> float:
    """a minute, doubled with every failure up to an hour; never less than the server asks for."""
    return max(min(60.0 * 2 ** (max(failures, 1) - 1), 3600.0), retry_after or 0.0)
