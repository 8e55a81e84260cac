"""Coordinate systems by formula: geographic, Mercator, transverse Mercator and Lambert conformal conic.

A code stands for a ``System``; ``define`` adds one from its published parameters.  Between datums
coordinates pass through the geocentric system of WGS 84 by the seven parameters of each datum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Datum:
    """Half axis in metres, inverse flattening, and the shift to WGS 84: metres, arc seconds (position vector), parts a million."""

    a: float
    invf: float
    shift: tuple[float, ...] = (0.0,) * 7

    @property
    def e2(self) -> float:
        return (2 - 1 / self.invf) / self.invf

    def geocentric(self, lon, lat):
        l, p = np.radians(lon), np.radians(lat)
        n = self.a / np.sqrt(1 - self.e2 * np.sin(p) ** 2)
        return np.stack([n * np.cos(p) * np.cos(l), n * np.cos(p) * np.sin(l), n * (1 - self.e2) * np.sin(p)])

    def geographic(self, xyz):
        x, y, z = xyz
        r, p = np.hypot(x, y), np.arctan2(z, np.hypot(x, y) * (1 - self.e2))
        for _ in range(8):  # each round gains more than two digits
            p = np.arctan2(z + self.e2 * self.a / np.sqrt(1 - self.e2 * np.sin(p) ** 2) * np.sin(p), r)
        return np.degrees(np.arctan2(y, x)), np.degrees(p)

    def matrix(self) -> np.ndarray:
        x, y, z = np.radians(np.array(self.shift[3:6]) / 3600)
        return (1 + self.shift[6] * 1e-6) * np.array([[1, -z, y], [z, 1, -x], [-y, x, 1]])

    def to_wgs84(self, lon, lat):
        if not any(self.shift):
            return lon, lat
        xyz = self.geocentric(lon, lat)
        return WGS84.geographic(np.tensordot(self.matrix(), xyz, 1) + np.reshape(self.shift[:3], (3,) + (1,) * np.ndim(lon)))

    def from_wgs84(self, lon, lat):
        if not any(self.shift):
            return lon, lat
        xyz = WGS84.geocentric(lon, lat) - np.reshape(self.shift[:3], (3,) + (1,) * np.ndim(lon))
        return self.geographic(np.tensordot(np.linalg.inv(self.matrix()), xyz, 1))


# Ellipsoids and datum shifts as published.
WGS84 = Datum(6378137.0, 298.257223563)
GRS80 = Datum(6378137.0, 298.257222101)
OSGB36 = Datum(6377563.396, 299.3249646, (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489))


@dataclass(frozen=True)
class System:
    """Geographic degrees; the projections add ``forward`` and ``inverse`` to metres."""

    datum: Datum = WGS84

    def forward(self, lon, lat):
        return lon, lat

    def inverse(self, x, y):
        return x, y


@dataclass(frozen=True)
class WebMercator(System):
    def forward(self, lon, lat):
        return self.datum.a * np.radians(lon), self.datum.a * np.log(np.tan(math.pi / 4 + np.radians(np.clip(lat, -89.99, 89.99)) / 2))

    def inverse(self, x, y):
        return np.degrees(x / self.datum.a), np.degrees(2 * np.arctan(np.exp(y / self.datum.a)) - math.pi / 2)


@dataclass(frozen=True)
class TransverseMercator(System):
    """Krueger series to the third order in the third flattening."""

    lon0: float = 0.0
    lat0: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0

    def _series(self) -> dict:
        n = 1 / (2 * self.datum.invf - 1)
        return {
            "a": self.scale * self.datum.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
            "alpha": (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240),
            "beta": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
            "delta": (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
        }

    def _raw(self, l, p):
        k, e = self._series(), math.sqrt(self.datum.e2)
        t = np.sinh(np.arctanh(np.sin(p)) - e * np.arctanh(e * np.sin(p)))
        xi, eta = np.arctan2(t, np.cos(l)), np.arctanh(np.sin(l) / np.sqrt(1 + t * t))
        x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(k["alpha"], 1))
        y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(k["alpha"], 1))
        return k["a"] * x, k["a"] * y

    def _origin(self) -> float:
        return float(self._raw(0.0, math.radians(self.lat0))[1]) if self.lat0 else 0.0

    def forward(self, lon, lat):
        x, y = self._raw(np.radians(lon - self.lon0), np.radians(lat))
        return self.x0 + x, self.y0 - self._origin() + y

    def inverse(self, x, y):
        k = self._series()
        xi, eta = (y - self.y0 + self._origin()) / k["a"], (x - self.x0) / k["a"]
        u, v = xi, eta
        for j, b in enumerate(k["beta"], 1):
            u, v = u - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta), v - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        chi = np.arcsin(np.sin(u) / np.cosh(v))
        lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(k["delta"], 1))
        return np.degrees(np.arctan2(np.sinh(v), np.cos(u))) + self.lon0, np.degrees(lat)


@dataclass(frozen=True)
class LambertConic(System):
    """Conformal, on two standard parallels, or on one (lat1 = lat2) with a scale."""

    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0

    def _t(self, p):
        e = math.sqrt(self.datum.e2)
        return np.tan(math.pi / 4 - p / 2) / ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2)

    def _cone(self) -> tuple[float, float, float]:
        """n, a F and the radius at the origin."""
        p1, p2 = math.radians(self.lat1), math.radians(self.lat2)
        m = lambda p: math.cos(p) / math.sqrt(1 - self.datum.e2 * math.sin(p) ** 2)
        n = math.sin(p1) if self.lat1 == self.lat2 else math.log(m(p1) / m(p2)) / math.log(self._t(p1) / self._t(p2))
        f = self.scale * self.datum.a * m(p1) / (n * self._t(p1) ** n)
        return n, f, f * self._t(math.radians(self.lat0)) ** n

    def forward(self, lon, lat):
        n, f, r0 = self._cone()
        r, angle = f * self._t(np.radians(lat)) ** n, n * np.radians(lon - self.lon0)
        return self.x0 + r * np.sin(angle), self.y0 + r0 - r * np.cos(angle)

    def inverse(self, x, y):
        n, f, r0 = self._cone()
        x, y, sign, e = x - self.x0, r0 - (y - self.y0), math.copysign(1, n), math.sqrt(self.datum.e2)
        t = (sign * np.hypot(x, y) / f) ** (1 / n)
        p = math.pi / 2 - 2 * np.arctan(t)
        for _ in range(8):
            p = math.pi / 2 - 2 * np.arctan(t * ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2))
        return np.degrees(np.arctan2(sign * x, sign * y) / n) + self.lon0, np.degrees(p)


# Codes and parameters as published.
SYSTEMS: dict[int, System] = {
    4326: System(),
    4258: System(GRS80),
    4269: System(GRS80),
    4277: System(OSGB36),
    3857: WebMercator(),
    2154: LambertConic(GRS80, 3.0, 46.5, 49.0, 44.0, 1.0, 700000.0, 6600000.0),
    27700: TransverseMercator(OSGB36, -2.0, 49.0, 0.9996012717, 400000.0, -100000.0),
}


def _zone(n: int) -> System | None:
    """UTM zones of WGS 84, ETRS89 and NAD83."""
    for first, last, zone, datum, south in ((32601, 32660, 1, WGS84, 0.0), (32701, 32760, 1, WGS84, 1e7), (25828, 25838, 28, GRS80, 0.0), (26901, 26923, 1, GRS80, 0.0)):
        if first <= n <= last:
            return TransverseMercator(datum, 6.0 * (n - first + zone) - 183, 0.0, 0.9996, 5e5, south)
    return None


def define(n: int, system: System) -> None:
    """Let "EPSG:n" stand for ``system`` in this session's driver."""
    SYSTEMS[n] = system


def code(crs: str) -> int:
    """EPSG number of "EPSG:n"; anything unsupported raises."""
    n = int(str(crs).upper().removeprefix("EPSG:"))
    if n in SYSTEMS or _zone(n):
        return n
    raise ValueError(f"unsupported coordinate system {crs}")


def system(crs: str | System) -> System:
    """The system itself, which travels to the workers while definitions do not."""
    return crs if isinstance(crs, System) else SYSTEMS.get(code(crs)) or _zone(code(crs))


def utm_for(lon: float, lat: float) -> str:
    return f"EPSG:{(32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)}"


def transform_xy(x, y, source: str | System, target: str | System):
    s, t = system(source), system(target)
    if s == t:
        return x, y
    lon, lat = s.inverse(np.asarray(x, float), np.asarray(y, float))
    if s.datum != t.datum:
        lon, lat = t.datum.from_wgs84(*s.datum.to_wgs84(lon, lat))
    return t.forward(lon, lat)


def transform_columns(x: Column, y: Column, source: str | System, target: str | System) -> tuple[Column, Column]:
    s, t = system(source), system(target)
    if s == t:
        return x, y

    @F.pandas_udf("x double, y double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u, v = transform_xy(a.to_numpy(), b.to_numpy(), s, t)
        return pd.DataFrame({"x": u, "y": v})

    p = run(x, y)
    return p["x"], p["y"]


def transform_geometry(geom, source: str, target: str):
    return [[np.stack(transform_xy(r[:, 0], r[:, 1], source, target), axis=1) for r in part] for part in geom]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    p = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * 6371008.8) * F.asin(F.sqrt(p))
