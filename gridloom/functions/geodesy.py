"""Rational polynomial cameras and the Gauss-Krueger projection, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: The ellipsoid of CGCS2000, and the zones' numbering.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ZONES, FIRST_EPSG, FALSE_EAST = (25, 45), 4519, 500000.0


def terms(p: Column, l: Column, h: Column) -> list[Column]:  # noqa: E741
    """The twenty cubic terms of latitude p, longitude l and height h, in the order of the RPC00B standard."""
    one = F.lit(1.0)
    return [one, l, p, h, l * p, l * h, p * h, l * l, p * p, h * h, p * l * h, l * l * l, l * p * p, l * h * h, l * l * p, p * p * p, p * h * h, l * l * h, p * p * h, h * h * h]


def polynomial(coeff: Column, x: list[Column]) -> Column:
    out = coeff[0] * x[0]
    for i in range(1, 20):
        out = out + coeff[i] * x[i]
    return out


def image_point(rpc: Column, lon: Column, lat: Column, h: Column) -> tuple[Column, Column]:
    """(line, samp) of a point on the ground; rpc is a struct of the ten scalars and four arrays."""
    p, l, z = (lat - rpc["lat_off"]) / rpc["lat_scale"], (lon - rpc["long_off"]) / rpc["long_scale"], (h - rpc["height_off"]) / rpc["height_scale"]  # noqa: E741
    x = terms(p, l, z)
    ratio = lambda a, b: polynomial(rpc[a], x) / polynomial(rpc[b], x)
    return ratio("line_num_coeff", "line_den_coeff") * rpc["line_scale"] + rpc["line_off"], ratio("samp_num_coeff", "samp_den_coeff") * rpc["samp_scale"] + rpc["samp_off"]


def zone(lon: Column) -> Column:
    """The three-degree zone's number, half to even, within the numbered ones."""
    return F.greatest(F.lit(ZONES[0]), F.least(F.lit(ZONES[1]), F.rint((lon - 1.5) / 3).cast("int")))


def gk_epsg(lon: Column) -> Column:
    return zone(lon) + FIRST_EPSG


def central_meridian(z: Column) -> Column:
    return z * 3.0


_n = FLATTENING / (2 - FLATTENING)
_A = AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
#: Krueger's series, to the fourth power of the third flattening.
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def gk_forward(lon: Column, lat: Column, meridian: Column) -> tuple[Column, Column]:
    """(east, north) in metres, scale 1 on the meridian, false easting 500 km."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(_ALPHA, 1):
        north = north + F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.lit(FALSE_EAST) + F.lit(_A) * east, F.lit(_A) * north


def gk_inverse(east: Column, north: Column, meridian: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = north / F.lit(_A), (east - F.lit(FALSE_EAST)) / F.lit(_A)
    x, e = xi, eta
    for k, b in enumerate(_BETA, 1):
        x = x - F.lit(b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        e = e - F.lit(b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for k, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + meridian, F.degrees(phi)
