"""Columns that check names, numbers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of coordinates, length of an exclude key.
TOLERANCE, EXCLUDE_DIGITS = 1e-5, 16


def near(left: Column, right: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two values are finite numbers no farther apart than the tolerance; texts count as the numbers that they spell."""
    a, b = left.try_cast("double"), right.try_cast("double")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite(a) & finite(b) & (F.abs(a - b) <= tolerance), F.lit(False))


def safe_file(name: Column) -> Column:
    """Whether a bundle's file name is a plain .bin name: letters, digits, points and hyphens, no leading point."""
    return F.coalesce(name.rlike(r"^(?!\.)[\p{L}\p{N}.-]*\.bin$"), F.lit(False))


def safe_key(key: Column) -> Column:
    """Whether a store's key stays below its root: not absolute and without a part that climbs."""
    climbs = F.exists(F.split(key, "/"), lambda part: part == "..")
    return F.coalesce((key != "") & ~key.startswith("/") & ~climbs, F.lit(False))


def source_name(lease: Column, prefix: str) -> Column:
    """The name of the source that a lease of 32 hexadecimal digits makes, else null."""
    return F.when(lease.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(prefix), lease))


def class_file(kind: str, number: Column, name: Column) -> Column:
    """kind-NN-name.bin, with hyphens for spaces."""
    digits = F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    return F.concat(F.lit(f"{kind}-"), digits, F.lit("-"), F.replace(name, F.lit(" "), F.lit("-")), F.lit(".bin"))


def exclude_key(points: Column) -> Column:
    """A short digest of an ordered list of used points (lat, lng, panoId); empty for an empty list."""
    text = F.to_json(F.transform(points, lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), p["panoId"].alias("panoId"))))
    return F.when(F.size(points) > 0, F.concat(F.lit(":exclude:"), F.substring(F.sha2(text, 256), 1, EXCLUDE_DIGITS))).otherwise("")


def model_identity(manifest: dict) -> dict:
    """A model's manifest with the digest of its sorted, compact JSON."""
    import hashlib
    import json

    text = json.dumps(manifest, sort_keys=True, separators=(",", ":"))
    return {**manifest, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def rounded_hit(score: Column) -> Column:
    """Six decimals, ties to even."""
    return F.bround(score, 6)


def rounded_map(score: Column) -> Column:
    """Seven decimals, ties away from zero."""
    return F.round(score, 7)
