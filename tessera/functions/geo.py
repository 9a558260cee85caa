"""Columns on coordinates and view angles."""

from __future__ import annotations

from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.constants import EARTH_RADIUS_M

METERS_PER_DEGREE = EARTH_RADIUS_M * radians(1)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def wrap_heading(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def thumbnail_fov(zoom: Column) -> Column:
    """Field of view in degrees, 30 to 120; a missing zoom counts as 0."""
    z = F.coalesce(zoom, F.lit(0.0))
    return F.greatest(F.lit(30.0), F.least(F.lit(120.0), F.degrees(F.atan(0.75 * F.pow(F.lit(2.0), 1 - z))) * 2))


def synthetic_lat_lon(key: Column) -> tuple[Column, Column]:
    """Coordinates from the digest of a key."""
    digest = F.sha2(key, 256)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 4294967296.0
    return F.round(part(1) * 140 - 70, 6), F.round(part(9) * 360 - 180, 6)


def own_cell(lat: Column, lon: Column, meters: float) -> Column:
    """The cell (row, column) of a point, in a grid whose cells are at least meters wide; rows have their own column counts."""
    row = F.floor(lat / _step(meters))
    return F.struct(row.alias("row"), _column(lon, row, meters).alias("column"))


def _step(meters: float) -> float:
    return meters / METERS_PER_DEGREE * 1.001


def _columns(row: Column, meters: float) -> Column:
    """How many columns a row has: by the parallel of its edge farther from the equator.

    Beside a pole a chord of that length spans up to pi / 3 times the longitude that the arc does, hence the 1.05; a row
    that comes within that length of the pole is one cell.
    """
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row * _step(meters)), F.abs((row + 1) * _step(meters))))
    many = F.greatest(F.lit(1), F.floor(F.lit(360.0) / (1.05 * _step(meters) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6)))))
    return F.when(edge > 90.0 - _step(meters), F.lit(1).cast("long")).otherwise(many.cast("long"))


def _column(lon: Column, row: Column, meters: float) -> Column:
    n = _columns(row, meters)
    return F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n)


def near_cells(lat: Column, lon: Column, meters: float) -> Column:
    """The distinct cells, at most nine, that hold every point within meters; the grid wraps at the date line."""
    row = F.floor(lat / _step(meters))
    cells = [
        F.struct((row + dy).alias("row"), F.pmod(_column(lon, row + dy, meters) + dx, _columns(row + dy, meters)).alias("column"))
        for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    ]
    return F.array_distinct(F.array(*cells))


def view_plan(lane: Column, heading: Column, pitch: Column, zoom: Column) -> Column:
    """The six views of a panorama: four quarter turns, up and down."""
    scene = lane == "scene"
    fov = F.when(scene, thumbnail_fov(zoom)).otherwise(F.lit(90.0))
    tilt = F.when(scene, F.coalesce(pitch, F.lit(0.0))).otherwise(F.lit(0.0))
    view = lambda k, h, p, f: F.struct(F.lit(k).alias("face"), wrap_heading(h).alias("heading"), p.alias("pitch"), f.alias("fov"))
    turns = [view(k, heading + 90.0 * k, tilt, fov) for k in range(4)]
    return F.array(*turns, view(4, heading, F.lit(90.0), F.lit(90.0)), view(5, heading, F.lit(-90.0), F.lit(90.0)))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals: the scaled value goes to the nearest whole number, halves away from zero.

    round(x, digits) goes by the decimal text of x instead, which is another number where the scaled value falls short of a half.
    """
    return F.round(x * float(10**digits), 0) / float(10**digits)
