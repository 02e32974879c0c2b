"""Coordinates between degrees, UTM zones and Web Mercator, as column expressions.

Transverse Mercator by Krueger's series in the third flattening (fourth order), which is good
to well under a millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid, UTM's scale and false origin.
A, INVERSE_F = 6378137.0, 298.257223563
SCALE, EAST, NORTH = 0.9996, 500_000.0, 10_000_000.0

_f = 1 / INVERSE_F
_n = _f / (2 - _f)
_e = math.sqrt(_f * (2 - _f))
_radius = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
#: Series of the forward and inverse mapping, by powers of n.
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)


def _zone(crs: str) -> tuple[float, float]:
    code = int(crs.removeprefix("EPSG:"))
    north, south = 32601 <= code <= 32660, 32701 <= code <= 32760
    if not (north or south):
        raise ValueError(f"{crs} is neither EPSG:4326, EPSG:3857 nor a UTM zone")
    return math.radians((code % 100 - 1) * 6 - 177), NORTH if south else 0.0


def from_degrees(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        return F.radians(lon) * A, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A
    middle, north = _zone(crs)
    s, lam = F.sin(F.radians(lat)), F.radians(lon) - middle
    t = F.sinh(F.atanh(s) - F.atanh(s * _e) * _e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
        y = y + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
    return x * (SCALE * _radius) + EAST, y * (SCALE * _radius) + north


def to_degrees(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        return F.degrees(x / A), F.degrees(F.atan(F.sinh(y / A)))
    middle, north = _zone(crs)
    xi, eta = (y - north) / (SCALE * _radius), (x - EAST) / (SCALE * _radius)
    u, v = xi, eta
    for k, b in enumerate(_BETA, 1):
        u = u - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * b
        v = v - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * b
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + F.sin(chi * (2 * k)) * d
    return F.degrees(F.atan2(F.sinh(v), F.cos(u)) + middle), F.degrees(lat)


def convert(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    return (x, y) if source == target else from_degrees(*to_degrees(x, y, source), target)
