"""Distance joins on a grid of cells, and the order-dependent pruning of near hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import DUPLICATE_M, EARTH_RADIUS_M, MAX_EXCLUDED, MAX_RESULTS, PRUNE_M, USED_M
from tessera.functions.geo import haversine_m, near_cells, own_cell


def within(left: DataFrame, right: DataFrame, meters: float, on: tuple[str, ...] = (), kind: str = "left_semi", extra=None, inclusive: bool = True) -> DataFrame:
    """left joined with right (columns renamed r_...) where on agrees and the points (lat, lon) lie within meters.

    right's points are put into their cell and left's look into at most nine; the rest is an equi-join with a residual
    condition, so no pair of far cells is ever formed. kind is left_semi (distinct rows of left) or inner.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], own_cell(F.col("lat"), F.col("lon"), meters).alias("r_cell"))
    looked = left.withColumn("_cell", F.explode(near_cells(F.col("lat"), F.col("lon"), meters)))
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    near = distance <= meters if inclusive else distance < meters
    condition = (F.col("_cell") == F.col("r_cell")) & near
    for c in on:
        condition &= F.col(c) == F.col(f"r_{c}")
    if extra is not None:
        condition &= extra
    if kind == "inner":
        return looked.join(r, condition, "inner").drop("_cell", "r_cell")
    return looked.join(r, condition, "left_semi").select(*left.columns).distinct()


def duplicate_flags(locations: DataFrame, meters: float = DUPLICATE_M) -> DataFrame:
    """locations with deferred: an earlier row (by id) of the same lane, capture and model and another asset lies within meters.

    Earlier rows count whether or not they are deferred themselves, so this is a plain semi-join and not a chain.
    """
    keys = ("lane", "capture", "model")
    points = locations.select("location_id", "asset_id", "lat", "lon", *keys)
    # of the rows at one place only two can matter to a later one: the first, and the first of another asset than that
    place = (*keys, "lat", "lon")
    first = points.groupBy(*place).agg(F.min(F.struct("location_id", "asset_id")).alias("_first"))
    other = points.join(first, list(place)).where(F.col("asset_id") != F.col("_first.asset_id")).groupBy(*place).agg(F.min(F.struct("location_id", "asset_id")).alias("_first"))
    early = first.unionByName(other).select(*place, "_first.location_id", "_first.asset_id")
    late = within(points, early, meters, keys, "left_semi", (F.col("r_location_id") < F.col("location_id")) & (F.col("r_asset_id") != F.col("asset_id")))
    return locations.join(late.select("location_id", F.lit(True).alias("deferred")), "location_id", "left").withColumn("deferred", F.coalesce("deferred", F.lit(False)))


#: Fixed value: meters a degree of the box that stored rows are looked up in; it is a little narrower than the distance.
BOX_METERS = 111_320.0


def import_flags(arrivals: DataFrame, stored: DataFrame, meters: float = DUPLICATE_M) -> DataFrame:
    """arrivals (asset_id, lat, lon, lane, capture, model, position) with deferred: whether a near row of another asset was there first.

    Stored rows count within a box of meters around the arrival that also lie within the distance; the box has BOX_METERS
    to a degree, so the last few centimeters north and south are out of it, and it doesn't go around the date line.
    Arrivals at a smaller position count by the distance alone, deferred or not.
    """
    keys = ("lane", "capture", "model")
    north = F.lit(meters / BOX_METERS)
    east = F.lit(meters) / F.greatest(F.lit(1.0), BOX_METERS * F.abs(F.cos(F.radians("lat"))))
    box = F.col("r_lat").between(F.col("lat") - north, F.col("lat") + north) & F.col("r_lon").between(F.col("lon") - east, F.col("lon") + east)
    points = arrivals.select("position", "asset_id", "lat", "lon", *keys)
    # of the stored rows at one place two assets are enough
    places = stored.groupBy(*keys, "lat", "lon").agg(F.min("asset_id").alias("a"), F.max("asset_id").alias("b")).select(*keys, "lat", "lon", F.explode(F.array_distinct(F.array("a", "b"))).alias("asset_id"))
    old = within(points, places, meters, keys, "left_semi", box & (F.col("r_asset_id") != F.col("asset_id"))).select("position")
    own = duplicate_flags(points.withColumnRenamed("position", "location_id"), meters).where("deferred").select(F.col("location_id").alias("position"))
    flagged = old.union(own).distinct().withColumn("deferred", F.lit(True))
    return arrivals.join(flagged, "position", "left").withColumn("deferred", F.coalesce("deferred", F.lit(False)))


def excluded_points(points: DataFrame, limit: int = MAX_EXCLUDED) -> DataFrame:
    """At most limit used points with numeric coordinates, the first by position."""
    return points.where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("position").limit(limit)


def exclude_used(hits: DataFrame, used: DataFrame, meters: float = USED_M) -> DataFrame:
    """hits without those whose panorama was used or that lie closer than meters to a used point."""
    fresh = hits.join(used.where("pano_id IS NOT NULL AND pano_id <> ''").select("pano_id").distinct(), "pano_id", "left_anti")
    near = within(fresh.select("location_id", "lat", "lon"), used.select("lat", "lon"), meters, inclusive=False)
    return fresh.join(near.select("location_id"), "location_id", "left_anti")


def _kept(lat: np.ndarray, lon: np.ndarray, pano: list, meters: float) -> np.ndarray:
    """Greedy in order: a row goes if a kept one has its panorama or lies closer than meters."""
    phi, lam = np.radians(lat), np.radians(lon)
    xyz = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=1)
    side = 2 * np.sin(meters / EARTH_RADIUS_M / 2) * 1.0001  # chord length: cells of space, without seams or poles
    cells: dict[tuple[int, int, int], list[int]] = {}
    seen, keep = set(), np.zeros(len(lat), dtype=bool)
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for i, cell in enumerate(map(tuple, np.floor(xyz / side).astype(np.int64).tolist())):
        if pano[i] and pano[i] in seen:
            continue
        near = [j for a, b, c in steps for j in cells.get((cell[0] + a, cell[1] + b, cell[2] + c), ())]
        if near:
            j = np.array(near)
            a = np.sin((phi[j] - phi[i]) / 2) ** 2 + np.cos(phi[i]) * np.cos(phi[j]) * np.sin((lam[j] - lam[i]) / 2) ** 2
            if (2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(a))) < meters).any():
                continue
        keep[i] = True
        seen.add(pano[i])
        cells.setdefault(cell, []).append(i)
    return keep


def prune_nearby(hits: DataFrame, meters: float = PRUNE_M, by: str = "query_id") -> DataFrame:
    """hits, ranked within each query, without those closer than meters to a better kept one or with its panorama.

    A hit depends on kept hits only, so each query's list is walked in order; queries run in parallel. A list of more than
    MAX_RESULTS hits, which no search makes, is an error.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_RESULTS:
            raise ValueError(f"{len(pdf)} hits of one query")
        pdf = pdf.sort_values("rank", kind="stable")
        return pdf[_kept(pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float), pdf["pano_id"].tolist(), meters)]

    return hits.groupBy(by).applyInPandas(walk, hits.schema)
