"""Search filters: normalised on the driver, applied as columns that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import CONFIDENCE_FLOORS, COUNTRY_ALIASES, GENERATIONS, MAX_RESULTS, SCENE_FLOORS
from tessera.functions.text import canonical_country, is_street_pano


@dataclass(frozen=True)
class Filters:
    mode: str = "all"
    countries: tuple[str, ...] = ()
    generations: tuple[str, ...] = ()


def normal_filters(mode: str | None = None, countries=None, generations=None, every_country: frozenset[str] | None = None) -> Filters:
    """Unknown modes mean all; excluding nothing means all; including nothing stays so; a full or empty generation set is no filter.

    With every_country given, including all of these means all.
    """
    names = [COUNTRY_ALIASES.get(c.strip(), c.strip()) for c in countries or () if isinstance(c, str) and c.strip()] if isinstance(countries, (list, tuple)) else []
    names = tuple(sorted(set(names)))
    chosen = tuple(dict.fromkeys(g for g in generations if g in GENERATIONS)) if isinstance(generations, (list, tuple)) else ()
    if len(chosen) == len(GENERATIONS):
        chosen = ()
    if mode not in ("include", "exclude") or (mode == "exclude" and not names) or (mode == "include" and every_country and set(names) >= every_country):
        return Filters("all", (), chosen)
    return Filters(mode, names, chosen)


def accepted(filters: Filters, country: Column, generation: Column) -> Column:
    """Null countries and generations count as empty strings, so that excluding keeps them."""
    out = F.lit(True)
    if filters.generations:
        out &= F.coalesce(generation, F.lit("")).isin(*filters.generations)
    if filters.mode == "include":
        out &= canonical_country(country).isin(*filters.countries) if filters.countries else F.lit(False)
    elif filters.mode == "exclude":
        out &= ~canonical_country(country).isin(*filters.countries)
    return out


def clamped(value, default: int) -> int:
    """Whole numbers within 1 and the largest result; anything else is the default."""
    return min(MAX_RESULTS, max(1, value)) if type(value) is int else default


def overfetch(count: int, per_country: int, excluding: bool = False) -> int:
    """How many hits to take before pruning and capping; with excluding, a list without a cap is overfetched too."""
    return count if per_country >= count and not excluding else min(MAX_RESULTS, max(count, 4 * count))


def similarity_floor(lane: str, weight: int = 0, confidence: str = "balanced") -> float:
    """The smallest score that a search keeps: by description weight for scenes, by confidence for objects."""
    return SCENE_FLOORS[weight] if lane == "scene" else CONFIDENCE_FLOORS[confidence]


def without_road_names(rows: DataFrame, column: str = "road_name_state") -> DataFrame:
    return rows.where(F.col(column) == "no road name")


def claimable(locations: DataFrame, now: int, drop_invented: bool = False) -> DataFrame:
    """Pending rows and leased ones that have expired, unless they were set aside; with drop_invented, street panoramas only."""
    fit = F.coalesce("queue_state", F.lit("pending")) == "pending"
    fit &= is_street_pano(F.col("asset_id")) if drop_invented else F.lit(True)
    return locations.where(fit & ((F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("lease_until") <= now))))
