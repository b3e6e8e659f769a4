"""Distances, boxes, plume geometry and projected coordinates as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import as_col, half_up


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius: float = C.EARTH_KM_RESPONDERS) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = (F.sin(dlat / 2.0) * F.sin(dlat / 2.0)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.sin(dlon / 2.0) * F.sin(dlon / 2.0))
    return 2.0 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def equirectangular_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Planar distance with longitude shrunk at the second point's latitude."""
    dy = (lat - lat0) * C.KM_PER_DEGREE
    apart = F.abs(lon - lon0)
    dx = F.least(apart, 360.0 - apart) * C.KM_PER_DEGREE * F.cos(F.radians(lat0))
    return F.sqrt(dx * dx + dy * dy)


def box_around(lat: Column, lon: Column, radius_km: Column | float) -> Column:
    """struct(west, south, east, north) holding a circle, six decimals."""
    r = F.lit(radius_km) if isinstance(radius_km, (int, float)) else radius_km
    dlat = r / C.KM_PER_DEGREE
    dlon = r / (C.KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return F.struct(
        half_up(lon - dlon, 6).alias("west"), half_up(lat - dlat, 6).alias("south"),
        half_up(lon + dlon, 6).alias("east"), half_up(lat + dlat, 6).alias("north"))


def indicative_travel(distance_km: Column) -> Column:
    road = distance_km * C.CIRCUITY
    return F.struct(
        half_up(road, 2).alias("road_km"),
        half_up(road / C.RESPONSE_KMH * 60.0, 1).alias("minutes"),
        F.lit(False).alias("is_routed"), F.lit(C.TRAVEL_BASIS).alias("basis"))


def plume_length_deg(frp: Column) -> Column:
    reach = 0.02 + F.sqrt(F.greatest(frp, F.lit(1.0))) * 0.008
    return F.least(F.greatest(reach, F.lit(0.03)), F.lit(0.20))


def hazard_km(frp: Column) -> Column:
    return half_up(plume_length_deg(frp) * C.KM_PER_DEGREE, 1)


def evacuation_km(frp: Column) -> Column:
    return F.greatest(F.lit(0.5), half_up(hazard_km(frp) * 0.35, 1))


def compass(degrees: Column) -> Column:
    """Sixteen-point name of a bearing."""
    slot = F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in C.COMPASS]), slot + 1)


def smoke_cone(lat: Column, lon: Column, frp: Column, wind_from_deg: Column,
               wind_kmh: Column) -> Column:
    """Closed ring origin-left-tip-right-origin opening downwind."""
    bearing = F.radians(F.pmod(wind_from_deg + 180.0, F.lit(360.0)))
    half = F.radians(F.greatest(F.lit(12.0), 26.0 - wind_kmh * 0.4))
    length = plume_length_deg(frp)

    def vertex(angle, reach):
        return F.struct(half_up(lon + reach * F.sin(angle), 5).alias("x"),
                        half_up(lat + reach * F.cos(angle), 5).alias("y"))

    origin = F.struct(lon.alias("x"), lat.alias("y"))
    return F.array(origin, vertex(bearing - half, length), vertex(bearing, length * 1.15),
                   vertex(bearing + half, length), origin)


def utm(lat: Column | str, lon: Column | str) -> Column:
    """WGS84 transverse Mercator: zone, hemisphere, band, easting, northing, coarse grid text."""
    lat, lon = as_col(lat), as_col(lon)
    a, flat, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = 2 * flat - flat * flat
    ep2 = e2 / (1 - e2)
    zone = (F.floor((lon + 180.0) / 6.0) + 1).cast("int")
    phi = F.radians(lat)
    lam0 = F.radians(((zone - 1) * 6 - 180 + 3).cast("double"))
    n = a / F.sqrt(1.0 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    q = F.cos(phi) * (F.radians(lon) - lam0)
    arc = a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
               - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * F.sin(2.0 * phi)
               + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * F.sin(4.0 * phi)
               - (35 * e2 ** 3 / 3072) * F.sin(6.0 * phi))
    east = 500000.0 + k0 * n * (
        q + (1.0 - t + c) * F.pow(q, 3) / 6.0
        + (5.0 - 18.0 * t + t * t + 72.0 * c - 58.0 * ep2) * F.pow(q, 5) / 120.0)
    north = k0 * (arc + n * F.tan(phi) * (
        q * q / 2.0 + (5.0 - t + 9.0 * c + 4.0 * c * c) * F.pow(q, 4) / 24.0
        + (61.0 - 58.0 * t + t * t + 600.0 * c - 330.0 * ep2) * F.pow(q, 6) / 720.0))
    north = F.when(lat < 0, north + 10000000.0).otherwise(north)
    band_no = F.least(F.greatest(F.floor((lat + 80.0) / 8.0), F.lit(0)), F.lit(19)).cast("int")
    band = F.substring(F.lit(C.UTM_BANDS), band_no + 1, F.lit(1))

    def grid(metres):
        return F.floor(F.pmod(F.floor(metres), F.lit(100000)) / 10).cast("long")

    return F.struct(
        zone.alias("utm_zone"), F.when(lat >= 0, "N").otherwise("S").alias("hemisphere"),
        band.alias("band"), half_up(east, 1).alias("easting_m"),
        half_up(north, 1).alias("northing_m"),
        F.format_string("%d%s %04d %04d", zone, band, grid(east), grid(north))
        .alias("grid_ref_approx"))


def ring(lat: Column, lon: Column, radius_km: float, vertices: int = 48) -> Column:
    """Closed vertex ring around a point."""
    step = 2.0 * math.pi / vertices
    dlat = radius_km / C.KM_PER_DEGREE

    def vertex(i):
        angle = i.cast("double") * step
        return F.struct(
            (lon + dlat / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)) * F.cos(angle)).alias("x"),
            (lat + dlat * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), vertex)


# --- polygons held as ARRAY<ARRAY<STRUCT<x, y>>> ---------------------------------

# An edge keeps its ends, its direction and the inverse of its squared length. The predicates
# below are SQL text over an edge array and two coordinate columns: nested lambdas are shorter
# that way, and one expression costs one call into the JVM.

_EPS = "1e-12D"


def ring_edges(rings: str = "rings") -> Column:
    """All edges of all rings of a polygon, holes and parts included."""
    pairs = "arrays_zip(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1))"
    edge = ("named_struct('x1', q.`0`.x, 'y1', q.`0`.y, 'x2', q.`1`.x, 'y2', q.`1`.y, "
            "'dx', q.`1`.x - q.`0`.x, 'dy', q.`1`.y - q.`0`.y, 'inv', "
            "CASE WHEN q.`0` = q.`1` THEN 0D ELSE 1D / (pow(q.`1`.x - q.`0`.x, 2) "
            "+ pow(q.`1`.y - q.`0`.y, 2)) END)")
    return F.expr(f"flatten(transform(filter({rings}, r -> size(r) >= 2), "
                  f"r -> transform({pairs}, q -> {edge})))")


def squared_edge_distance(x: str, y: str) -> str:
    """Squared planar distance in degrees from a point to the edge ``e``."""
    t = f"least(greatest((({x} - e.x1) * e.dx + ({y} - e.y1) * e.dy) * e.inv, 0D), 1D)"
    ex, ey = f"({x} - e.x1 - {t} * e.dx)", f"({y} - e.y1 - {t} * e.dy)"
    return f"({ex} * {ex} + {ey} * {ey})"


def covers(edges: str, x: str, y: str) -> str:
    """Point in polygon by crossing parity; points on an edge count as covered."""
    crossing = (f"(e.y1 > {y}) <> (e.y2 > {y}) AND "
                f"{x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1")
    touching = (f"greatest(e.y1, e.y2) >= {y} - {_EPS} AND least(e.y1, e.y2) <= {y} + {_EPS} "
                f"AND greatest(e.x1, e.x2) >= {x} - {_EPS} AND least(e.x1, e.x2) <= {x} + {_EPS} "
                f"AND {squared_edge_distance(x, y)} <= {_EPS} * {_EPS}")
    return (f"(size(filter({edges}, e -> {crossing})) % 2 = 1 "
            f"OR exists({edges}, e -> {touching}))")


def min_squared_distance(edges: str, x: str, y: str) -> str:
    return f"array_min(transform({edges}, e -> {squared_edge_distance(x, y)}))"


def squared_box_distance(p: str, x: str, y: str) -> str:
    """Squared distance to the bounding box minx..maxy of an item; 0 inside it."""
    return (f"(pow(greatest({p}.minx - {x}, {x} - {p}.maxx, 0D), 2) "
            f"+ pow(greatest({p}.miny - {y}, {y} - {p}.maxy, 0D), 2))")


def in_box(p: str, x: str, y: str, reach: str) -> str:
    return (f"({x} >= {p}.minx - {reach} AND {x} <= {p}.maxx + {reach} "
            f"AND {y} >= {p}.miny - {reach} AND {y} <= {p}.maxy + {reach})")


def interior_point(rings: str = "rings") -> Column:
    """A point inside the polygon: middle of the widest run along the central latitude."""
    edges = ring_edges(rings)
    ys = F.transform(edges, lambda e: e["y1"])
    y = (F.array_min(ys) + F.array_max(ys)) / 2.0
    hits = F.array_sort(F.transform(
        F.filter(edges, lambda e: (e["y1"] > y) != (e["y2"] > y)),
        lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    runs = F.transform(
        F.filter(F.transform(hits, lambda h, i: F.struct(h.alias("a"), i.alias("i"))),
                 lambda s: s["i"] % 2 == 0),
        lambda s: F.struct((F.get(hits, s["i"] + 1) - s["a"]).alias("w"), s["a"].alias("a")))
    widest = F.array_max(runs)
    return F.struct((widest["a"] + widest["w"] / 2.0).alias("x"), y.alias("y"))
