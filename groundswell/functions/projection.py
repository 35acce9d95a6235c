"""Transverse Mercator zones of the WGS 84 ellipsoid as column expressions, by Krueger's series to the fourth order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid, the scale on the central meridian, the false easting and the southern false northing.
AXIS, FLATTENING, SCALE, EAST, SOUTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * SCALE
#: Coefficients of the series in the third flattening: to the plane, from it, and from conformal to geodetic latitude.
TO_PLANE = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
FROM_PLANE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = 2 * math.sqrt(_N) / (1 + _N)


def zone_of(epsg: int) -> tuple[int, bool]:
    """(zone, southern) of the codes 32601 to 32660 and 32701 to 32760."""
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG:{epsg} isn't a transverse Mercator zone of WGS 84")
    return epsg % 100, epsg // 100 == 327


def _series(terms: tuple[float, ...], a: Column, b: Column, outer, inner) -> Column:
    out = F.lit(0.0)
    for j, k in enumerate(terms, 1):
        out = out + F.lit(k) * outer(a * (2 * j)) * inner(b * (2 * j))
    return out


def to_plane(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """(x, y) in metres of a longitude and latitude in degrees."""
    zone, south = zone_of(epsg)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = F.lit(EAST) + F.lit(RADIUS) * (eta + _series(TO_PLANE, xi, eta, F.cos, F.sinh))
    y = F.lit(SOUTH if south else 0.0) + F.lit(RADIUS) * (xi + _series(TO_PLANE, xi, eta, F.sin, F.cosh))
    return x, y


def from_plane(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of metres in a zone."""
    zone, south = zone_of(epsg)
    xi, eta = (y - F.lit(SOUTH if south else 0.0)) / F.lit(RADIUS), (x - F.lit(EAST)) / F.lit(RADIUS)
    xi, eta = xi - _series(FROM_PLANE, xi, eta, F.sin, F.cosh), eta - _series(FROM_PLANE, xi, eta, F.cos, F.sinh)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, k in enumerate(LATITUDE, 1):
        lat = lat + F.lit(k) * F.sin(chi * (2 * j))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(lat)


def buffered(box: tuple[Column, Column, Column, Column], epsg: int, buffer: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """(left, bottom, right, top) in degrees around a box in a zone's metres grown by ``buffer``: its corners' extremes."""
    left, bottom, right, top = box
    corners = [from_plane(x, y, epsg) for x in (left - buffer, right + buffer) for y in (bottom - buffer, top + buffer)]
    lons, lats = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*lons), F.least(*lats), F.greatest(*lons), F.greatest(*lats)


def pixel_centre(index: Column, origin: float, step: float) -> Column:
    """The coordinate of a pixel's centre along an axis."""
    return F.lit(origin) + (index + F.lit(0.5)) * F.lit(step)
