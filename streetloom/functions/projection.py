"""Transverse Mercator between longitude/latitude and metres, as Column expressions.

The Krüger series in the third flattening, to third order, on the GRS80 ellipsoid. Southern zones: false northing 10,000 km.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ellipsoid and of the projection.
A, FLATTENING = 6378137.0, 1 / 298.257222101
K0, EASTING, NORTHING = 0.9996, 500_000.0, 10_000_000.0
EPSG_SOUTH = 31960

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_Q = 2 * _N**0.5 / (1 + _N)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_INVERSE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone_of(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def epsg_of(zone: Column) -> Column:
    return (zone + EPSG_SOUTH).cast("int")


def zone_of_table(df: DataFrame, lon: str = "lon") -> DataFrame:
    """One row: the zone of the middle of the table's longitudes."""
    return df.agg(((F.min(lon) + F.max(lon)) / 2).alias("centre")).select(zone_of(F.col("centre")).alias("zone"))


def _sum(terms) -> Column:
    total = None
    for t in terms:
        total = t if total is None else total + t
    return total


def forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _Q * F.atanh(_Q * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + _sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    y = xi + _sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    return EASTING + K0 * _RADIUS * x, NORTHING + K0 * _RADIUS * y


def inverse(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = (y - NORTHING) / (K0 * _RADIUS), (x - EASTING) / (K0 * _RADIUS)
    xi0 = xi - _sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_INVERSE, 1))
    eta0 = eta - _sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_INVERSE, 1))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi + _sum(d * F.sin(2 * j * chi) for j, d in enumerate(_LATITUDE, 1))
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (zone * 6 - 183), F.degrees(phi)


def project_line(line: Column, zone: Column) -> Column:
    """array<struct<lon, lat>> -> array<struct<x, y>>."""

    def point(p):
        x, y = forward(p["lon"], p["lat"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, point)


def unproject_line(line: Column, zone: Column) -> Column:
    """array<struct<x, y>> -> array<struct<lon, lat>>."""

    def point(p):
        lon, lat = inverse(p["x"], p["y"], zone)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.transform(line, point)
