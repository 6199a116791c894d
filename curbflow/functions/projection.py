"""Inverse map projections as column arithmetic: plane feet to degrees.

Closed-form and series formulas from the public map-projection literature. The
datum shift between the source datum and WGS 84 (below a metre here) is ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS 1980 ellipsoid and the US survey foot.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
US_FOOT = 0.3048006096012192

FLATTENING = 1 / INVERSE_FLATTENING
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)

@dataclass(frozen=True)
class LambertConic:
    """Lambert conformal conic with two standard parallels."""

    false_easting: float
    false_northing: float
    central_meridian: float
    parallel_1: float
    parallel_2: float
    latitude_of_origin: float
    unit: float = US_FOOT

    def constants(self) -> tuple[float, float, float]:
        def m(phi: float) -> float:
            return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)

        def t(phi: float) -> float:
            slip = (1 - E1 * math.sin(phi)) / (1 + E1 * math.sin(phi))
            return math.tan(math.pi / 4 - phi / 2) / slip ** (E1 / 2)

        p1, p2, p0 = map(math.radians, (self.parallel_1, self.parallel_2, self.latitude_of_origin))
        cone = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
        scale = m(p1) / (cone * t(p1) ** cone)
        return cone, scale, SEMI_MAJOR * scale * t(p0) ** cone

    def to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a point in projected units."""
        cone, scale, rho_0 = self.constants()
        east = (x - F.lit(self.false_easting)) * F.lit(self.unit)
        south = F.lit(rho_0) - (y - F.lit(self.false_northing)) * F.lit(self.unit)
        rho = F.sqrt(east * east + south * south)
        t = F.pow(rho / F.lit(SEMI_MAJOR * scale), F.lit(1 / cone))
        lon = F.lit(self.central_meridian) + F.degrees(F.atan2(east, south) / F.lit(cone))

        chi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(t)
        # the series leaves some 1e-11 rad; one step of the exact equation removes it
        bent = F.lit(E1) * F.sin(_geodetic(chi))
        slip = F.pow((F.lit(1.0) - bent) / (F.lit(1.0) + bent), F.lit(E1 / 2))
        return lon, F.degrees(F.lit(math.pi / 2) - F.lit(2.0) * F.atan(t * slip))

def _geodetic(chi: Column) -> Column:
    """Geodetic latitude from conformal latitude, series in the eccentricity."""
    e2, e4, e6, e8 = E2, E2**2, E2**3, E2**4
    terms = [
        (2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360),
        (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520),
        (6, 7 * e6 / 120 + 81 * e8 / 1120),
        (8, 4279 * e8 / 161280),
    ]
    out = chi
    for multiple, factor in terms:
        out = out + F.lit(factor) * F.sin(chi * F.lit(float(multiple)))
    return out

@dataclass(frozen=True)
class TransverseMercator:
    false_easting: float
    false_northing: float
    central_meridian: float
    scale_factor: float
    latitude_of_origin: float
    unit: float = US_FOOT

    @staticmethod
    def meridian_arc(phi: float) -> float:
        e2, e4, e6 = E2, E2**2, E2**3
        return SEMI_MAJOR * (
            (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
            - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * math.sin(2 * phi)
            + (15 * e4 / 256 + 45 * e6 / 1024) * math.sin(4 * phi)
            - (35 * e6 / 3072) * math.sin(6 * phi)
        )

    def to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        arc_0 = self.meridian_arc(math.radians(self.latitude_of_origin))
        arc = F.lit(arc_0) + (y - F.lit(self.false_northing)) * F.lit(self.unit / self.scale_factor)
        mu = arc / F.lit(SEMI_MAJOR * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
        e = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
        foot = mu
        for multiple, factor in [
            (2, 3 * e / 2 - 27 * e**3 / 32),
            (4, 21 * e**2 / 16 - 55 * e**4 / 32),
            (6, 151 * e**3 / 96),
            (8, 1097 * e**4 / 512),
        ]:
            foot = foot + F.lit(factor) * F.sin(mu * F.lit(float(multiple)))

        second = E2 / (1 - E2)
        sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
        c, t = F.lit(second) * cos * cos, tan * tan
        bend = F.lit(1.0) - F.lit(E2) * sin * sin
        across = F.lit(SEMI_MAJOR) / F.sqrt(bend)
        along = F.lit(SEMI_MAJOR * (1 - E2)) / (bend * F.sqrt(bend))
        d = (x - F.lit(self.false_easting)) * F.lit(self.unit / self.scale_factor) / across
        d2 = d * d
        lat = foot - (across * tan / along) * d2 * (
            F.lit(0.5)
            - d2 * (5 + 3 * t + 10 * c - 4 * c * c - F.lit(9 * second)) / 24
            + d2 * d2 * (61 + 90 * t + 298 * c + 45 * t * t - F.lit(252 * second) - 3 * c * c) / 720
        )
        lon = (
            d
            * (
                F.lit(1.0)
                - d2 * (1 + 2 * t + c) / 6
                + d2 * d2 * (5 - 2 * c + 28 * t - 3 * c * c + F.lit(8 * second) + 24 * t * t) / 120
            )
            / cos
        )
        return F.lit(self.central_meridian) + F.degrees(lon), F.degrees(lat)

# The two state-plane zones of the polygon layers.
LONG_ISLAND_ZONE = LambertConic(
    false_easting=984250.0,
    false_northing=0.0,
    central_meridian=-74.0,
    parallel_1=40.66666666666666,
    parallel_2=41.03333333333333,
    latitude_of_origin=40.16666666666666,
)
NEW_JERSEY_ZONE = TransverseMercator(
    false_easting=492125.0,
    false_northing=0.0,
    central_meridian=-74.5,
    scale_factor=0.9999,
    latitude_of_origin=38.83333333333334,
)
