"""Geo columns: distances on a sphere and on the ellipsoid, bearing, destination, boxes, sun position, coordinates from text."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along a great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def metres_per_degree_lon(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * (math.pi / 180 * EARTH_M)


def box_around(lat: Column, lon: Column, radius_m: float) -> Column:
    """struct(south, west, north, east) that holds a circle."""
    dlat = radius_m / (math.pi / 180 * EARTH_M)
    dlon = radius_m / F.greatest(metres_per_degree_lon(lat), F.lit(1.0))
    return F.struct((lat - dlat).alias("south"), (lon - dlon).alias("west"), (lat + dlat).alias("north"), (lon + dlon).alias("east"))


def destination(lat: Column, lon: Column, bearing_deg: Column, metres: Column) -> Column:
    """struct(lat, lon) of the point so many metres away in a direction."""
    d, way, p = metres / EARTH_M, F.radians(bearing_deg), F.radians(lat)
    there = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(way))
    turn = F.atan2(F.sin(way) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(there))
    return F.struct(F.degrees(there).alias("lat"), (F.pmod(lon + F.degrees(turn) + 540, F.lit(360.0)) - 180).alias("lon"))


@F.pandas_udf(T.DoubleType())
def ellipsoid_distance(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres on WGS84 by Vincenty's inverse iteration; on the sphere where it doesn't converge (nearly opposite points)."""
    major, flat = 6378137.0, 1 / 298.257223563
    minor = (1 - flat) * major
    a, b, c, d = (np.radians(x.to_numpy(float)) for x in (lat1, lon1, lat2, lon2))
    u, v, wide = np.arctan((1 - flat) * np.tan(a)), np.arctan((1 - flat) * np.tan(c)), d - b
    lam, sure = wide.copy(), np.zeros(len(wide), bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sin_s = np.hypot(np.cos(v) * np.sin(lam), np.cos(u) * np.sin(v) - np.sin(u) * np.cos(v) * np.cos(lam))
            cos_s = np.sin(u) * np.sin(v) + np.cos(u) * np.cos(v) * np.cos(lam)
            arc = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u) * np.cos(v) * np.sin(lam) / sin_s)
            square = 1 - sin_a**2
            middle = np.where(square == 0, 0.0, cos_s - 2 * np.sin(u) * np.sin(v) / square)
            part = flat / 16 * square * (4 + flat * (4 - 3 * square))
            new = wide + (1 - part) * flat * sin_a * (arc + part * sin_s * (middle + part * cos_s * (2 * middle**2 - 1)))
            sure = np.abs(new - lam) < 1e-12
            lam = new
            if sure.all():
                break
        k = square * (major**2 - minor**2) / minor**2
        one = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        two = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        less = two * sin_s * (middle + two / 4 * (cos_s * (2 * middle**2 - 1) - two / 6 * middle * (4 * sin_s**2 - 3) * (4 * middle**2 - 3)))
        out = minor * one * (arc - less)
        plain = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin(wide / 2) ** 2)))
    return pd.Series(np.where(sin_s == 0, 0.0, np.where(sure, out, plain)))


def proximity(metres: Column, scale_m: float = 5000.0) -> Column:
    """1 at the same place, falling to 0 at scale_m."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - metres / scale_m))


def sun_angles(ts: Column, lon: Column) -> tuple[Column, Column]:
    """Declination and hour angle in radians, from the day of the year and the time in UTC."""
    day = F.dayofyear(ts)
    hour = F.hour(ts) + F.minute(ts) / 60.0
    b = F.radians(360.0 / 365.0 * (day - 81))
    declination = F.radians(F.lit(23.45) * F.sin(b))
    equation = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    return declination, F.radians(15 * (hour - 12) + lon + equation / 4)


def sun_elevation(ts: Column, lat: Column, lon: Column) -> Column:
    """Degrees above the horizon."""
    declination, angle = sun_angles(ts, lon)
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(angle)))


def sun_azimuth(ts: Column, lat: Column, lon: Column) -> Column:
    """Degrees from north by east, 0 to 360."""
    declination, angle = sun_angles(ts, lon)
    east = -F.cos(declination) * F.sin(angle)
    north = F.sin(declination) * F.cos(F.radians(lat)) - F.cos(declination) * F.sin(F.radians(lat)) * F.cos(angle)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def shadow_verdict(observed_bearing: Column, azimuth: Column, tolerance_deg: float = 25.0) -> Column:
    """Whether a shadow can point where it was seen: away from the sun."""
    return F.when(angular_difference(observed_bearing, azimuth + 180) > tolerance_deg, "IMPOSSIBLE").otherwise("CONSISTENT")


def shadow_factor(elevation: Column) -> Column:
    """Length of a shadow over the object's height; null at half a degree or less."""
    return F.when(elevation > 0.5, 1 / F.tan(F.radians(elevation)))


# Metres of uncertainty by decimals of a degree.
UNCERTAINTY_M = {6: 0.11, 5: 1.1, 4: 11.0, 3: 110.0, 2: 1100.0, 1: 11000.0}
_PAIR = r"^\s*([+-]?[0-9]{1,3}(?:\.[0-9]+)?)\s*[,;]\s*([+-]?[0-9]{1,3}(?:\.[0-9]+)?)\s*$"
_DMS = r"([0-9]{1,3})°\s*([0-9]{1,2})'\s*(?:([0-9]{1,2}(?:\.[0-9]+)?)\")?\s*([NSEW])"


def uncertainty(decimals: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in UNCERTAINTY_M.items() for x in (F.lit(k), F.lit(v))]), decimals)


def decimal_pair(text: Column) -> Column:
    """struct(lat, lon, decimals) of "lat, lon"; swapped if only that is a place; null if it is neither."""
    number = lambda k: F.regexp_extract(text, _PAIR, k).try_cast("double")
    places = lambda k: F.length(F.regexp_extract(F.regexp_extract(text, _PAIR, k), r"\.([0-9]+)$", 1))
    fine = lambda a, b: (F.abs(a) <= 90) & (F.abs(b) <= 180)
    point = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"), F.least(places(1), places(2)).alias("decimals"))
    return F.when(fine(number(1), number(2)), point(number(1), number(2))).when(fine(number(2), number(1)), point(number(2), number(1)))


def degrees_minutes(text: Column) -> Column:
    """struct(lat, lon) of two parts in degrees, minutes and seconds with their hemispheres, in either order; null otherwise."""
    part = lambda k: F.regexp_extract_all(text, F.lit(_DMS), k)
    value = lambda k: F.get(part(1), k).cast("double") + F.get(part(2), k).cast("double") / 60 + F.coalesce(F.get(part(3), k).try_cast("double"), F.lit(0.0)) / 3600
    signed = lambda k: F.when(F.get(part(4), k).isin("S", "W"), -value(k)).otherwise(value(k))
    north = F.get(part(4), 0).isin("N", "S")
    point = F.struct(F.when(north, signed(0)).otherwise(signed(1)).alias("lat"), F.when(north, signed(1)).otherwise(signed(0)).alias("lon"))
    sides = F.array_join(part(4), "")
    fine = sides.rlike("^([NS][EW]|[EW][NS])$")
    return F.when(fine & (F.abs(point["lat"]) <= 90) & (F.abs(point["lon"]) <= 180), point)
