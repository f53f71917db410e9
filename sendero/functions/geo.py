"""Geometry: projections, distances, bearings, cells, Morton keys."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fx
from .text import as_col, let

_NUMBER = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def to_number(c: Column | str) -> Column:
    """Finite number or null. Accepts numbers and plain decimal text, not '1d' or 'Infinity'."""
    text = as_col(c).cast("string")
    value = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def valid_coords(lat: Column | str, lng: Column | str) -> Column:
    lat, lng = to_number(lat), to_number(lng)
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lng) <= 180), F.lit(False))


def utm_to_wgs84(x: Column | str, y: Column | str, zone: int = fx.UTM_ZONE) -> Column:
    """Inverse transverse Mercator series on GRS80 -> struct<lat, lng> in degrees."""
    a, f = fx.GRS80_A, fx.GRS80_F
    e2 = f * (2.0 - f)
    ep2 = e2 / (1.0 - e2)
    root = math.sqrt(1.0 - e2)
    n = (1.0 - root) / (1.0 + root)
    rectifying = a * (1.0 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    series = {
        2: 3 * n / 2 - 27 * n**3 / 32,
        4: 21 * n**2 / 16 - 55 * n**4 / 32,
        6: 151 * n**3 / 96,
        8: 1097 * n**4 / 512,
    }

    mu = as_col(y) / F.lit(fx.UTM_K0 * rectifying)
    foot = mu
    for multiple, weight in series.items():
        foot = foot + F.sin(mu * multiple) * weight

    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    t, c = tan * tan, cos * cos * ep2
    w = F.lit(1.0) - sin * sin * e2
    prime = F.lit(a) / F.sqrt(w)
    meridian = F.lit(a * (1.0 - e2)) / (w * F.sqrt(w))
    d = (as_col(x) - fx.UTM_FALSE_EASTING) / (prime * fx.UTM_K0)

    d2 = d * d
    lat_4 = t * 3 + c * 10 - c * c * 4 + (5 - 9 * ep2)
    lat_6 = t * 90 + c * 298 + t * t * 45 - c * c * 3 + (61 - 252 * ep2)
    lat = foot - prime * tan / meridian * d2 * (
        F.lit(0.5) - d2 * lat_4 / 24 + d2 * d2 * lat_6 / 720
    )
    lng_3 = t * 2 + c + 1
    lng_5 = t * 28 - c * 2 - c * c * 3 + t * t * 24 + (5 + 8 * ep2)
    lng = d * (F.lit(1.0) - d2 * lng_3 / 6 + d2 * d2 * lng_5 / 120) / cos
    meridian_deg = zone * 6 - 183
    return F.struct(
        F.degrees(lat).alias("lat"), (F.degrees(lng) + meridian_deg).alias("lng")
    )


def round_coord(c: Column | str) -> Column:
    return F.bround(as_col(c), fx.COORD_DECIMALS)


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = (as_col(c) for c in (lat1, lng1, lat2, lng2))
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lng2 - lng1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    # not least(1, h): that would turn a missing coordinate into half the globe
    return F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h))) * (2 * fx.EARTH_RADIUS_M)


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing, clockwise from north, in [-180, 180]."""
    lat1, lng1, lat2, lng2 = (F.radians(as_col(c)) for c in (lat1, lng1, lat2, lng2))
    east = F.sin(lng2 - lng1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lng2 - lng1)
    return F.degrees(F.atan2(east, north))


def heading_deg(lat1, lng1, lat2, lng2) -> Column:
    """Bearing as a compass course in [0, 360)."""
    return (bearing_deg(lat1, lng1, lat2, lng2) + 360) % 360


def turn_deg(inbound: Column | str, outbound: Column | str) -> Column:
    delta = as_col(outbound) - as_col(inbound)
    return F.when(delta > 180, delta - 360).when(delta < -180, delta + 360).otherwise(delta)


def classify_turn(delta: Column | str) -> Column:
    delta = as_col(delta)
    size = F.abs(delta)
    side = F.when(delta > 0, F.lit("right")).otherwise(F.lit("left"))
    return (
        F.when(size < fx.TURN_MIN_DEG, F.lit("none"))
        .when(size < fx.TURN_SLIGHT_MAX_DEG, F.concat(F.lit("slight-"), side))
        .when(size < fx.TURN_NORMAL_MAX_DEG, side)
        .otherwise(F.concat(F.lit("sharp-"), side))
    )


def edge_cost_cs(length_m: Column | str, speed_kmh: Column | str) -> Column:
    """Travel time in whole centiseconds, at least one."""
    return F.greatest(F.lit(1), F.rint(as_col(length_m) * 360.0 / as_col(speed_kmh)).cast("int"))


def cell(lat: Column | str, lng: Column | str, deg: float) -> Column:
    return F.struct(
        F.floor(as_col(lng) / deg).alias("cx"), F.floor(as_col(lat) / deg).alias("cy")
    )


def micro(c: Column | str) -> Column:
    """Integer micro-degrees."""
    return F.rint(as_col(c) * fx.COORD_SCALE).cast("bigint")


def _spread_bits(c: Column) -> Column:
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return c


def morton(lat: Column | str, lng: Column | str) -> Column:
    """Z-order key of micro-degrees shifted into the positive range (60 bits)."""
    shift = fx.MORTON_SHIFT_DEG * fx.COORD_SCALE
    y = _spread_bits(micro(lat) + shift)
    x = _spread_bits(micro(lng) + shift)
    return y.bitwiseOR(F.shiftleft(x, 1))


def segment_dist_m(lat, lng, lat_a, lng_a, lat_b, lng_b) -> Column:
    """Distance of a point to a segment in its local metre plane, projection clamped."""
    lat, lng, lat_a, lng_a, lat_b, lng_b = (
        as_col(c) for c in (lat, lng, lat_a, lng_a, lat_b, lng_b)
    )
    m_lat = F.lit(fx.METRES_PER_DEGREE)

    # steps are bound, or the cosine would be taken for each of the 28 places it is used in
    def from_plane(v: Column) -> Column:
        ax, ay, dx, dy = (v[c] for c in ("ax", "ay", "dx", "dy"))
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, -(ax * dx + ay * dy) / len2).otherwise(F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        ends = let(t, lambda t: F.struct((ax + t * dx).alias("ex"), (ay + t * dy).alias("ey")))
        return let(ends, lambda e: F.sqrt(e["ex"] * e["ex"] + e["ey"] * e["ey"]))

    def plane(m_lng: Column) -> Column:
        return F.struct(
            ((lng_a - lng) * m_lng).alias("ax"),
            ((lat_a - lat) * m_lat).alias("ay"),
            ((lng_b - lng_a) * m_lng).alias("dx"),
            ((lat_b - lat_a) * m_lat).alias("dy"),
        )

    return let(let(F.cos(F.radians(lat)) * fx.METRES_PER_DEGREE, plane), from_plane)


def _c_segment_dists_m(
    lat: pd.Series, lng: pd.Series, lat_a: pd.Series, lng_a: pd.Series, lat_b: pd.Series, lng_b: pd.Series
) -> pd.Series:
    """``segment_dist_m`` to each of the segments of an array, with cos and pow of the C library; null for null.

    The JVM rounds cos otherwise in the last bit, and pow(x, 2) of C is not always the product.
    """

    def one(y, x, m_lng, y_a, x_a, y_b, x_b):
        m_lat = fx.METRES_PER_DEGREE
        ax, ay = (x_a - x) * m_lng, (y_a - y) * m_lat
        dx, dy = (x_b - x_a) * m_lng, (y_b - y_a) * m_lat
        len2 = dx * dx + dy * dy
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / len2)) if len2 > 0 else 0.0
        return math.sqrt(math.pow(ax + t * dx, 2.0) + math.pow(ay + t * dy, 2.0))

    def row(y, x, *ends):
        if ends[0] is None:
            return None
        m_lng = fx.METRES_PER_DEGREE * math.cos(y * (math.pi / 180))
        return [one(y, x, m_lng, *map(float, segment)) for segment in zip(*ends)]

    return pd.Series([row(*r) for r in zip(lat.tolist(), lng.tolist(), lat_a, lng_a, lat_b, lng_b)], dtype=object)


# called nondeterministic, so that conditions on its result are not moved to where Spark cannot run it
c_segment_dists_m = F.pandas_udf(_c_segment_dists_m, T.ArrayType(T.DoubleType())).asNondeterministic()
