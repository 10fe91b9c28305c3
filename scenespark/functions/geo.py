"""WGS84 geodesy as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the WGS84 ellipsoid
SEMI_MAJOR, ECCENTRICITY2 = 6378137.0, 6.69437999014e-3


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    normal = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY2 * F.sin(p) * F.sin(p))
    return (normal + alt) * F.cos(p) * F.cos(q), (normal + alt) * F.cos(p) * F.sin(q), (normal * (1 - ECCENTRICITY2) + alt) * F.sin(p)


class Origin:
    """A local east-north-up frame."""

    def __init__(self, lat: float, lon: float, alt: float):
        p, q = math.radians(lat), math.radians(lon)
        normal = SEMI_MAJOR / math.sqrt(1 - ECCENTRICITY2 * math.sin(p) ** 2)
        self.lat, self.lon, self.alt = lat, lon, alt
        self.center = ((normal + alt) * math.cos(p) * math.cos(q), (normal + alt) * math.cos(p) * math.sin(q), (normal * (1 - ECCENTRICITY2) + alt) * math.sin(p))
        self.axes = (
            (-math.sin(q), math.cos(q), 0.0),
            (-math.sin(p) * math.cos(q), -math.sin(p) * math.sin(q), math.cos(p)),
            (math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)),
        )

    def enu(self, lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
        d = [c - o for c, o in zip(ecef(lat, lon, alt), self.center)]
        return tuple(sum((x * w for x, w in zip(d[1:], axis[1:])), d[0] * axis[0]) for axis in self.axes)

    def geodetic(self, e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
        x, y, z = (o + e * self.axes[0][k] + n * self.axes[1][k] + u * self.axes[2][k] for k, o in enumerate(self.center))
        return geodetic(x, y, z)


def geodetic(x: Column, y: Column, z: Column, rounds: int = 8) -> tuple[Column, Column, Column]:
    """Latitude, longitude and altitude by fixed-point rounds, folded over an array so that the
    expression keeps its size."""
    flat = F.sqrt(x * x + y * y)
    start = F.struct(F.atan2(z, flat * (1 - ECCENTRICITY2)).alias("lat"), F.lit(0.0).alias("alt"))

    def step(s: Column, _: Column) -> Column:
        normal = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY2 * F.sin(s["lat"]) * F.sin(s["lat"]))
        alt = flat / F.cos(s["lat"]) - normal
        return F.struct(F.atan2(z, flat * (1 - ECCENTRICITY2 * normal / (normal + alt))).alias("lat"), alt.alias("alt"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.degrees(s["lat"]), F.degrees(F.atan2(y, x)), s["alt"]


def heading_vector(heading: Column) -> tuple[Column, Column, Column]:
    return F.sin(F.radians(heading)), F.cos(F.radians(heading)), F.lit(0.0)


def lerp_heading(a: Column, b: Column, w: Column) -> Column:
    """Along the shorter arc, in [0, 360)."""
    return F.pmod(a + w * (F.pmod(b - a + 180, F.lit(360.0)) - 180), F.lit(360.0))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Row-major rotation of a quaternion of any length but 0."""
    s = 2 / (w * w + x * x + y * y + z * z)
    return [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)]


def camera_center(rotation: Column, t: Column) -> list[Column]:
    """Minus the transposed rotation (nine numbers, row-major) times the translation."""
    return [-(rotation[k] * t[0] + rotation[3 + k] * t[1] + rotation[6 + k] * t[2]) for k in range(3)]
