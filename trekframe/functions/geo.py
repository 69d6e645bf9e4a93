"""Geodesic Column functions. All but the iterated ellipsoidal ones stay in the JVM; angles are in degrees, lengths in metres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trekframe.sources.shared import ship

#: Mean and equatorial radius of the Earth, WGS84 flattening and polar axis.
R_MEAN, R_EQUATOR, FLATTENING = 6371000.0, 6378137.0, 1 / 298.257223563
POLAR = R_EQUATOR * (1 - FLATTENING)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = R_MEAN) -> Column:
    """Great-circle distance; null where a coordinate is unknown."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2.0 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    dlon = F.radians(lon2) - F.radians(lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, azimuth: Column, distance: Column, radius: float = R_MEAN) -> Column:
    """Struct latitude, longitude reached on a sphere."""
    d, phi, az = distance / radius, F.radians(lat), F.radians(azimuth)
    lat2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(az))
    lon2 = F.radians(lon) + F.atan2(F.sin(az) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("latitude"), F.degrees(lon2).alias("longitude"))


def web_mercator(lat: Column, lon: Column) -> Column:
    """Struct x, y of EPSG:3857."""
    return F.struct((R_EQUATOR * F.radians(lon)).alias("x"), (R_EQUATOR * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(2 * F.atan(F.exp(y / R_EQUATOR)) - math.pi / 2).alias("latitude"), F.degrees(x / R_EQUATOR).alias("longitude"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = R_EQUATOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Krueger's series to the sixth order, forward and inverse.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_SCALE, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def utm(lat: Column, lon: Column) -> Column:
    """Struct easting, northing, zone, epsg (326zz north, 327zz south)."""
    zone = utm_zone(lon)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct(
        (_EAST + _SCALE * _RECTIFYING * east).alias("easting"),
        (F.when(lat >= 0, 0.0).otherwise(_SOUTH) + _SCALE * _RECTIFYING * north).alias("northing"),
        zone.alias("zone"),
        (F.when(lat >= 0, 32600).otherwise(32700) + zone).alias("epsg"),
    )


def from_utm(easting: Column, northing: Column, zone: Column, northern: Column) -> Column:
    xi = (northing - F.when(northern, 0.0).otherwise(_SOUTH)) / (_SCALE * _RECTIFYING)
    eta = (easting - _EAST) / (_SCALE * _RECTIFYING)
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    start = F.struct(F.tan(F.asin(F.sin(x) / F.cosh(e))).alias("tau"), F.degrees(F.atan2(F.sinh(e), F.cos(x))).alias("lon"))

    def newton(p: Column) -> Column:
        """The geographic latitude of a conformal one; four steps reach double precision."""

        def step(t: Column, _: Column) -> Column:
            s = F.sinh(_E * F.atanh(_E * t / F.sqrt(1 + t * t)))
            ti = t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)
            return t + (p["tau"] - ti) / F.sqrt(1 + ti * ti) * (1 + (1 - _E**2) * t * t) / ((1 - _E**2) * F.sqrt(1 + t * t))

        t = F.aggregate(F.sequence(F.lit(1), F.lit(4)), p["tau"], step)
        return F.struct(F.degrees(F.atan(t)).alias("latitude"), (p["lon"] + zone * 6 - 183).alias("longitude"))

    return F.transform(F.array(start), newton)[0]


def metres_per_degree_longitude(lat: Column) -> Column:
    return math.pi / 180 * R_MEAN * F.cos(F.radians(lat))


def metres_per_degree_latitude() -> float:
    return math.pi / 180 * R_MEAN


def slerp(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int) -> Column:
    """Array of n structs latitude, longitude on the great circle, both ends included; the two ends alone where they nearly coincide."""
    sigma = haversine(lat1, lon1, lat2, lon2, 1.0)
    p1, l1, p2, l2 = F.radians(lat1), F.radians(lon1), F.radians(lat2), F.radians(lon2)

    def at(i: Column) -> Column:
        f = i / F.lit(float(n - 1))
        a, b = F.sin((1 - f) * sigma) / F.sin(sigma), F.sin(f * sigma) / F.sin(sigma)
        x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
        y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
        z = a * F.sin(p1) + b * F.sin(p2)
        return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("latitude"), F.degrees(F.atan2(y, x)).alias("longitude"))

    ends = F.array(F.struct(lat1.alias("latitude"), lon1.alias("longitude")), F.struct(lat2.alias("latitude"), lon2.alias("longitude")))
    return F.when(sigma < 1e-6, ends).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def vincenty_place(lat, lon, azimuth, distance, steps: int = 8):
    """Latitudes and longitudes on the WGS84 ellipsoid of arrays of points, azimuths and distances."""
    a1, tan_u = np.radians(azimuth), (1 - FLATTENING) * np.tan(np.radians(lat))
    cos_u, cos_a1, sin_a1 = 1 / np.sqrt(1 + tan_u * tan_u), np.cos(a1), np.sin(a1)
    sin_u, sin_a = tan_u * cos_u, cos_u * sin_a1
    sigma1, cos2_a = np.arctan2(tan_u, cos_a1), 1 - sin_a * sin_a
    u2 = cos2_a * (R_EQUATOR**2 - POLAR**2) / POLAR**2
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    s = base = distance / (POLAR * big_a)
    for _ in range(steps):
        m, sin_s = np.cos(2 * sigma1 + s), np.sin(s)
        s = base + big_b * sin_s * (m + big_b / 4 * (np.cos(s) * (2 * m * m - 1) - big_b / 6 * m * (4 * sin_s * sin_s - 3) * (4 * m * m - 3)))
    m, sin_s, cos_s = np.cos(2 * sigma1 + s), np.sin(s), np.cos(s)
    t = sin_u * sin_s - cos_u * cos_s * cos_a1
    lat2 = np.arctan2(sin_u * cos_s + cos_u * sin_s * cos_a1, (1 - FLATTENING) * np.sqrt(sin_a * sin_a + t * t))
    lam = np.arctan2(sin_s * sin_a1, cos_u * cos_s - sin_u * sin_s * cos_a1)
    c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
    delta = lam - (1 - c) * FLATTENING * sin_a * (s + c * sin_s * (m + c * cos_s * (2 * m * m - 1)))
    return np.degrees(lat2), np.degrees(np.radians(lon) + delta)


def vincenty_direct(lat: Column, lon: Column, azimuth: Column, distance: Column, steps: int = 8) -> Column:
    """Struct latitude, longitude on the WGS84 ellipsoid, in Arrow batches; eight steps of the iteration settle any distance below a micrometre. Both are null where an argument is."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)

    @F.arrow_udf("latitude double, longitude double")
    def place(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([v.is_valid().to_numpy(zero_copy_only=False) for v in (a, b, c, d)])
        with np.errstate(invalid="ignore"):
            found = vincenty_place(*(v.to_numpy(zero_copy_only=False) for v in (a, b, c, d)), steps)
        return pa.StructArray.from_arrays([pa.array(v, mask=~known) for v in found], ["latitude", "longitude"])

    return place(*(x.cast("double") for x in (lat, lon, azimuth, distance)))


#: Eccentricity that the legacy distance takes where the textbook has the flattening.
_LEGACY_E = 0.0818192


def vincenty_metres(lat1, lon1, lat2, lon2, legacy: bool = False, most: int = 200):
    """Distances of arrays of points on the WGS84 ellipsoid, iterated until the longitude's change is below 1e-12; NaN where it isn't after most steps (near antipodes)."""
    reduced = 1 - (_LEGACY_E**2 if legacy else FLATTENING)
    third = _LEGACY_E if legacy else FLATTENING
    u1, u2 = (np.arctan(reduced * np.tan(np.radians(x))) for x in (lat1, lat2))
    away = np.radians(lon2) - np.radians(lon1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def parts(lam, at):
        ss = np.hypot(cu2[at] * np.sin(lam), cu1[at] * su2[at] - su1[at] * cu2[at] * np.cos(lam))
        cs = su1[at] * su2[at] + cu1[at] * cu2[at] * np.cos(lam)
        with np.errstate(divide="ignore", invalid="ignore"):
            sa = np.where(ss == 0, 0.0, cu1[at] * cu2[at] * np.sin(lam) / ss)
            c2 = 1 - sa * sa
            m = np.where(c2 == 0, 0.0, cs - 2 * su1[at] * su2[at] / c2)
        return ss, cs, np.arctan2(ss, cs), sa, c2, m

    lam, left = away.copy(), np.flatnonzero(~np.isnan(away))
    for _ in range(most):
        if not len(left):
            break
        ss, cs, s, sa, c2, m = parts(lam[left], left)
        c = third**2 / 16 * c2 * (4 + third**2 * c2) if legacy else third / 16 * c2 * (4 + third * (4 - 3 * c2))
        new = away[left] + (1 - c) * third * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1)))
        moved = ~(np.abs(new - lam[left]) < 1e-12)
        lam[left] = new
        left = left[moved]
    ss, cs, s, sa, c2, m = parts(lam, slice(None))
    v2 = c2 * (R_EQUATOR**2 - POLAR**2) / POLAR**2
    a = 1 + v2 / 16384 * (4096 + v2 * (-768 + v2 * (320 - 175 * v2)))
    b = v2 / 1024 * (256 + v2 * (-128 + v2 * (74 - 47 * v2)))
    d = b * ss * (m + b / 4 * (cs * (2 * m * m - 1) - b / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))
    out = POLAR * a * (s - d)
    out[left] = np.nan
    return out


def vincenty_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, legacy: bool = False) -> Column:
    """Distance on the WGS84 ellipsoid, in Arrow batches: how many steps a pair needs isn't known before. Points that coincide have distance 0; null where a coordinate is null or the iteration doesn't converge.

    legacy gives the non-standard variant of older track tools, which takes the
    eccentricity for the flattening and is about one percent too long.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)

    @F.pandas_udf("double")
    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        found = pd.Series(vincenty_metres(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (a, b, c, d)), legacy))
        return found.astype("object").where(found.notna(), None)

    return metres(*(x.cast("double") for x in (lat1, lon1, lat2, lon2)))
