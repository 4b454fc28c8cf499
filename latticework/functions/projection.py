"""The transverse Mercator projection by Krüger's series, both ways, as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """An ellipsoid (semi-major axis, flattening), a central meridian and an origin in degrees, a scale and false coordinates in metres.

    The series goes to the fourth power of the third flattening, which leaves an error below a micrometre within 30 degrees of the meridian.
    """

    meridian: float
    latitude: float = 0.0
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    axis: float = 6_378_137.0
    flattening: float = 1 / 298.257223563

    @classmethod
    def utm(cls, zone: int, south: bool = False) -> TransverseMercator:
        return cls(meridian=zone * 6 - 183, northing=10_000_000.0 if south else 0.0)

    @property
    def _series(self) -> tuple[float, list[float], list[float]]:
        """The rectifying radius and the coefficients of both directions (fixed values of the series)."""
        n = self.flattening / (2 - self.flattening)
        radius = self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return radius, forward, back

    @property
    def _eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @property
    def _latitudes(self) -> list[float]:
        """The coefficients of the series that gives the latitude of a conformal latitude, to the sixth power (rest below 1e-17)."""
        n = self.flattening / (2 - self.flattening)
        return [
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
            56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
            4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
            4174 * n**5 / 315 - 144838 * n**6 / 6237,
            601676 * n**6 / 22275,
        ]

    def _origin(self) -> float:
        """The rectified latitude of the origin."""
        phi, e = math.radians(self.latitude), self._eccentricity
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi = math.atan(t)
        return xi + sum(a * math.sin(2 * (k + 1) * xi) for k, a in enumerate(self._series[1]))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing of degrees."""
        radius, series, _ = self._series
        e = self._eccentricity
        sine, turn = F.sin(F.radians(lat)), F.radians(lon - self.meridian)
        t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
        xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
        north, east = xi, eta
        for k, a in enumerate(series):
            m = 2.0 * (k + 1)
            north = north + a * F.sin(m * xi) * F.cosh(m * eta)
            east = east + a * F.cos(m * xi) * F.sinh(m * eta)
        return self.easting + self.scale * radius * east, self.northing + self.scale * radius * (north - self._origin())

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees."""
        radius, _, series = self._series
        e = self._eccentricity
        north, east = (y - self.northing) / (self.scale * radius) + self._origin(), (x - self.easting) / (self.scale * radius)
        xi, eta = north, east
        for k, b in enumerate(series):
            m = 2.0 * (k + 1)
            xi = xi - b * F.sin(m * north) * F.cosh(m * east)
            eta = eta - b * F.cos(m * north) * F.sinh(m * east)
        turn = F.atan2(F.sinh(eta), F.cos(xi))
        conformal = F.atan(F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi)))
        phi = conformal
        for k, d in enumerate(self._latitudes):
            phi = phi + d * F.sin(2.0 * (k + 1) * conformal)
        return self.meridian + F.degrees(turn), F.degrees(phi)
