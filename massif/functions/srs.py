"""Coordinates: EPSG 4326, 3857 and 4978 in closed form, as Column functions. Others raise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from massif.functions.quadtree import HALF

# Semi-major axis and flattening of WGS 84, and the square of its eccentricity.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
SUPPORTED = {4326: "WGS 84", 3857: "WGS 84 / Pseudo-Mercator", 4978: "WGS 84 (geocentric)", 4312: "MGI"}
# The Bessel ellipsoid, and the shift (metres), rotation (arc seconds) and scale (millionths) from MGI to WGS 84.
BESSEL_A, BESSEL_E2 = 6377397.155, (2 - 1 / 299.1528128) / 299.1528128
MGI_SHIFT, MGI_TURN, MGI_SCALE = (577.326, 90.129, 463.919), (5.137, 1.474, 5.297), 2.4232


def require(epsg: int) -> str:
    if epsg not in SUPPORTED:
        raise ValueError(f"Unsupported: EPSG:{epsg}")
    return SUPPORTED[epsg]


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing; past a pole, and at the south pole, northing is null."""
    return lon * (HALF / 180), F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * (180 / HALF), F.degrees(F.atan(F.exp(y / A)) * 2 - math.pi / 2)


def to_ecef(lon: Column, lat: Column, h: Column, a: float = A, e2: float = E2) -> tuple[Column, Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + h) * F.sin(phi)


def mgi_to_ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    """Geographic MGI to WGS 84 geocentric, by the seven parameters of a position vector transformation."""
    x, y, z = to_ecef(lon, lat, h, BESSEL_A, BESSEL_E2)
    rx, ry, rz = (math.radians(t / 3600) for t in MGI_TURN)
    k = 1 + MGI_SCALE * 1e-6
    dx, dy, dz = MGI_SHIFT
    return (x - y * rz + z * ry) * k + dx, (x * rz + y - z * rx) * k + dy, (y * rx - x * ry + z) * k + dz


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude (-180 to 180), latitude (-90 to 90), height by the closed form with a reduced latitude, then one step of refinement."""
    p = F.sqrt(x * x + y * y)
    b = A * (1 - FLAT)
    t = F.atan2(z * A, p * b)
    ep2 = E2 / (1 - E2)
    phi = F.atan2(z + ep2 * b * F.pow(F.sin(t), 3), p - E2 * A * F.pow(F.cos(t), 3))
    h = p * F.cos(phi) + z * F.sin(phi) - A * F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), h


def sphere(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a direction, in degrees."""
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(z / F.sqrt(x * x + y * y + z * z)))


def zoom_of(pixel_ratio: Column) -> Column:
    """Zoom estimate: log2 of a mean ratio to the nearest integer, half to even."""
    return F.rint(F.log2(pixel_ratio)).cast("long")
