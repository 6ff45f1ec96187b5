"""Geodesy as column expressions: ECEF, UTM by the Krueger series, ellipsoidal distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS84 and UTM.
A = 6378137.0
INVERSE_FLATTENING = 298.257223563
SCALE = 0.9996

FLAT = 1 / INVERSE_FLATTENING
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)
N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)

# Coefficients of the Krueger series to sixth order, forward and inverse.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def _central(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6 - 183)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of epsg."""
    e = math.sqrt(E2)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon) - _central(epsg)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000 + SCALE * RECTIFYING * east, F.when(epsg >= 32700, 10000000.0).otherwise(0.0) + SCALE * RECTIFYING * north


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = (north - F.when(epsg >= 32700, 10000000.0).otherwise(0.0)) / (SCALE * RECTIFYING)
    eta = (east - 500000) / (SCALE * RECTIFYING)
    x, y = xi, eta
    for k, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    # the loop's state is bound once for each turn, so that the expressions do not multiply
    e = math.sqrt(E2)
    start = F.struct((F.sin(x) / F.sqrt(F.sinh(y) ** 2 + F.cos(x) ** 2)).alias("goal"), F.lit(None).cast("double").alias("tau"), F.lit(None).cast("double").alias("sigma"))

    def sigma(s: Column, _: Column) -> Column:
        tau = F.coalesce(s["tau"], s["goal"])
        return F.struct(s["goal"].alias("goal"), tau.alias("tau"), F.sinh(e * F.atanh(e * tau / F.sqrt(1 + tau * tau))).alias("sigma"))

    def newton(s: Column, k: Column) -> Column:
        tau = s["tau"]
        held = tau * F.sqrt(1 + s["sigma"] * s["sigma"]) - s["sigma"] * F.sqrt(1 + tau * tau)
        new = tau + (s["goal"] - held) / F.sqrt(1 + held * held) * (1 + (1 - E2) * tau * tau) / ((1 - E2) * F.sqrt(1 + tau * tau))
        return F.struct(s["goal"].alias("goal"), new.alias("tau"), s["sigma"].alias("sigma"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, lambda s, k: F.when(k % 2 == 1, sigma(s, k)).otherwise(newton(s, k)))
    return F.degrees(_central(epsg) + F.atan2(F.sinh(y), F.cos(x))), F.degrees(F.atan(done["tau"]))


def to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    n = A / F.sqrt(1 - E2 * F.sin(F.radians(lat)) ** 2)
    across = (n + height) * F.cos(F.radians(lat))
    return across * F.cos(F.radians(lon)), across * F.sin(F.radians(lon)), (n * (1 - E2) + height) * F.sin(F.radians(lat))


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height: Bowring's start and one fixed refinement."""
    p = F.sqrt(x * x + y * y)
    u = F.atan2(z * A, p * B)
    for _ in range(2):
        lat = F.atan2(z + E2 / (1 - E2) * B * F.sin(u) ** 3, p - E2 * A * F.cos(u) ** 3)
        u = F.atan2((1 - FLAT) * F.sin(lat), F.cos(lat))
    n = A / F.sqrt(1 - E2 * F.sin(lat) ** 2)
    height = p * F.cos(lat) + z * F.sin(lat) - A * A / n
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def _vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int) -> np.ndarray:
    """Distances by Vincenty's inverse iteration, all rows together."""
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = d = np.radians(lon2 - lon1)
    for _ in range(rounds):
        sin_l, cos_l = np.sin(lam), np.cos(lam)
        sin_s = np.sqrt((c2 * sin_l) ** 2 + (c1 * s2 - s1 * c2 * cos_l) ** 2)
        cos_s = s1 * s2 + c1 * c2 * cos_l
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sin_l / np.where(sin_s == 0, 1.0, sin_s))
        cos2a = 1 - sin_a * sin_a
        c2m = np.where(cos2a == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2a == 0, 1.0, cos2a))
        c = FLAT / 16 * cos2a * (4 + FLAT * (4 - 3 * cos2a))
        lam = d + (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (c2m + c * cos_s * (2 * c2m * c2m - 1)))
    u = cos2a * (A * A - B * B) / (B * B)
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    delta = big_b * sin_s * (c2m + big_b / 4 * (cos_s * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * sin_s**2 - 3) * (4 * c2m**2 - 3)))
    return B * big_a * (sigma - delta)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """Distance on the ellipsoid by Vincenty's inverse iteration, over Arrow batches; null where a coordinate is missing. For points
    that are not antipodal."""

    def distance(*places: pd.Series) -> pd.Series:
        return pd.Series(_vincenty(*(p.to_numpy(float) for p in places), rounds))

    return F.pandas_udf(distance, "double")(lon1, lat1, lon2, lat2)


# Published parameters from ITRF2014 to ITRF2008 at 2010.0: shifts in mm, scale in parts of 1e9, rotations in
# thousandths of a second of arc, and the yearly rates of all seven.
ITRF2014_TO_ITRF2008 = {"shift": (1.6, 1.9, 2.4), "scale": -0.02, "turn": (0.0, 0.0, 0.0), "shift_rate": (0.0, 0.0, -0.1), "scale_rate": 0.03, "turn_rate": (0.0, 0.0, 0.0), "epoch": 2010.0}
MAS = 3.141592653589793 / (180 * 3600 * 1000)


def change_frame(x: Column, y: Column, z: Column, epoch: Column, parameters: dict = ITRF2014_TO_ITRF2008, inverse: bool = False, coordinate_frame: bool = False) -> tuple[Column, Column, Column]:
    """Geocentric coordinates in another frame, by fourteen parameters at a decimal year: shift + (1 + scale) turn x, where turn is I plus
    the skew matrix of the rotations (of the position vector, or of the frame). The time of the coordinates stays what it is.
    The inverse solves the same equation exactly, so a round trip gives the start."""
    p = parameters
    years = epoch - p["epoch"]
    shift = [(a + b * years) * 1e-3 for a, b in zip(p["shift"], p["shift_rate"], strict=True)]
    sign = -1.0 if coordinate_frame else 1.0
    rx, ry, rz = ((a + b * years) * (sign * MAS) for a, b in zip(p["turn"], p["turn_rate"], strict=True))
    scale = 1.0 + (p["scale"] + p["scale_rate"] * years) * 1e-9
    if not inverse:
        return shift[0] + scale * (x - rz * y + ry * z), shift[1] + scale * (rz * x + y - rx * z), shift[2] + scale * (rx * y - ry * x + z)
    u, v, w = ((c - s) / scale for c, s in zip((x, y, z), shift, strict=True))
    # inverse of I plus a skew matrix: (q + r (r . q) - r x q) / (1 + r . r)
    dot, norm = rx * u + ry * v + rz * w, 1.0 + rx * rx + ry * ry + rz * rz
    return (u + rx * dot - (ry * w - rz * v)) / norm, (v + ry * dot - (rz * u - rx * w)) / norm, (w + rz * dot - (rx * v - ry * u)) / norm
