"""Distances, travel times and map framing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# They must equal those of the engine whose results are matched.
EARTH_KM = 6371.0
METRES_PER_DEGREE = 111_320.0
#: mode -> (km/h, minutes added per leg, routing profile)
MODES = {"walking": (4.5, 0.0, "foot"), "driving": (25.0, 8.0, "car")}
HYBRID_WALK_KM = 1.2
MAP_WIDTH, MAP_HEIGHT, MAP_PADDING, MAP_MOST_ZOOM = 300.0, 460.0, 0.82, 16.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / F.lit(2.0)), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def bounding_box(lat: Column, lon: Column, radius_m: Column) -> Column:
    """struct(south, west, north, east) of a radius; a prefilter that range predicates can push to Parquet."""
    dy = radius_m / F.lit(METRES_PER_DEGREE)
    dx = radius_m / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat)))
    return F.struct((lat - dy).alias("south"), (lon - dx).alias("west"), (lat + dy).alias("north"), (lon + dx).alias("east"))


def known_mode(mode: Column) -> Column:
    """Unknown and null modes are walking."""
    return F.when(mode.isin("walking", "driving", "hybrid"), mode).otherwise(F.lit("walking"))


def _minutes(km: Column, mode: str) -> Column:
    speed, overhead, _ = MODES[mode]
    return km / F.lit(speed) * F.lit(60.0) + F.lit(overhead)


def leg_minutes(km: Column, mode: Column) -> Column:
    """A leg's minutes; hybrid walks up to 1.2 km and drives beyond."""
    drives = (known_mode(mode) == "driving") | ((known_mode(mode) == "hybrid") & (km > HYBRID_WALK_KM))
    return F.when(drives, _minutes(km, "driving")).otherwise(_minutes(km, "walking"))


def profiles(mode: str) -> list[str]:
    """The routing profiles whose matrices a mode needs."""
    return {"driving": ["car"], "hybrid": ["car", "foot"]}.get(mode, ["foot"])


def fit_view(south: Column, north: Column, west: Column, east: Column) -> Column:
    """struct(zoom, lat, lon) of the Web Mercator view that shows the box; a point gets the greatest zoom."""
    lat, lon = (south + north) / F.lit(2.0), (west + east) / F.lit(2.0)
    span = lambda a, b: F.greatest(b - a, F.lit(1e-6))
    wide = F.log2(F.lit(MAP_WIDTH * 360.0 / 512.0) / span(west, east))
    high = F.log2(F.lit(MAP_HEIGHT * 360.0 / 512.0) * F.cos(F.radians(lat)) / span(south, north))
    zoom = F.least(wide, high) + F.lit(math.log2(MAP_PADDING))
    return F.struct(F.least(F.lit(MAP_MOST_ZOOM), zoom).alias("zoom"), lat.alias("lat"), lon.alias("lon"))
