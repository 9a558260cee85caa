"""JSON catalogues and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constants import MAX_EXCLUDED
from tessera.functions.geo import synthetic_lat_lon
from tessera.operators.catalog import first_wins

BANNED = ("image", "images", "faces", "jpeg", "png", "url", "tileUrl")
_NUMBERS = "lat double, lng double, lon double, heading double, pitch double, zoom double"
_RECORD = f"struct<assetId: string, panoId: string, pano_id: string, capture: string, lane: string, model: string, {_NUMBERS.replace(' double', ': double')}, country: string, cameraGeneration: string, {', '.join(f'{b}: string' for b in BANNED)}>"
_POINT = f"struct<panoId: string, pano_id: string, pano: string, {_NUMBERS.replace(' double', ': string')}>"


def problem(pano: Column, banned: tuple[Column, ...] = ()) -> Column:
    """Why a metadata record is refused, or null."""
    out = F
    for b in banned:
        out = out.when(F.coalesce(b, F.lit("")) != "", "imagery_payload_forbidden")
    out = out.when(pano.isNull() | ~F.length(pano).between(4, 80), "invalid_pano_id")
    return out.when(pano.contains("maps.googleapis.com") | pano.startswith("http"), "imagery_url_forbidden")


def missing_as(*names: str, otherwise: float = 0.0) -> Column:
    """The first of the columns that is neither null nor zero."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit(0.0)) for n in names], F.lit(otherwise))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents with a list of locations; the first of a repeated identity stays, refused ones are an error.

    First is by the documents' paths, then by the place within the document.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", f"persistImagery boolean, locations array<{_RECORD}>, records array<{_RECORD}>").alias("d"))
    docs = docs.select("_file", F.when(F.coalesce("d.persistImagery", F.lit(False)), F.raise_error(F.lit("persistImagery")).cast("array<string>")).alias("_stop"), F.coalesce("d.locations", "d.records").alias("r"))
    rows = docs.select("_file", "_stop", F.posexplode("r").alias("position", "r")).select("_file", "_stop", "position", "r.*")
    pano = F.coalesce("panoId", "pano_id", "assetId")
    why = problem(pano, tuple(F.col(b) for b in BANNED))
    rows = rows.withColumn("asset_id", F.when(why.isNull(), pano).otherwise(F.raise_error(why)))
    jobs = rows.select(
        "asset_id", F.coalesce("capture", F.lit("unknown")).alias("capture"), F.coalesce("lane", F.lit("scene")).alias("lane"), F.coalesce("model", F.lit("")).alias("model"), "position",
        F.coalesce("lat", F.lit(0.0)).alias("lat"), missing_as("lng", "lon").alias("lon"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("heading", "pitch", "zoom")], "country", F.col("cameraGeneration").alias("camera_generation"), F.col("_stop"), F.struct("_file", "position").alias("_order"),
    )
    return first_wins(jobs, position="_order").drop("_stop", "_order")


def map_points(docs: DataFrame, column: str = "value") -> DataFrame:
    """(document, position, pano_id, lat, lon, heading, pitch, zoom) of maps: a bare list or a list under one of three names."""
    named = F.from_json(column, f"customCoordinates array<{_POINT}>, locations array<{_POINT}>, coordinates array<{_POINT}>")
    points = F.coalesce(named["customCoordinates"], named["locations"], named["coordinates"], F.from_json(column, f"array<{_POINT}>"))
    rows = docs.select(F.sha2(column, 256).alias("document"), F.posexplode(points).alias("position", "p"))
    number = lambda n: F.expr(f"try_cast(p.{n} AS DOUBLE)")
    return rows.select(
        "document", "position", F.coalesce("p.panoId", "p.pano_id", "p.pano").alias("pano_id"), number("lat").alias("lat"), F.coalesce(number("lng"), number("lon")).alias("lon"),
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("heading", "pitch", "zoom")],
    )


def excluded_from_maps(docs: DataFrame, limit: int = MAX_EXCLUDED) -> DataFrame:
    """Points of earlier results: the first limit with numeric coordinates."""
    return map_points(docs).where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("document", "position").limit(limit)


def export_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    """Rows, as JSON text, of database exports: a list of {results}, one {results}, or a plain list."""
    text = F.col(column)
    listed = F.from_json(text, "array<string>")
    inner = F.flatten(F.transform(listed, lambda x: F.coalesce(F.from_json(F.get_json_object(x, "$.results"), "array<string>"), F.array(x))))
    one = F.from_json(F.get_json_object(text, "$.results"), "array<string>")
    return docs.select(F.explode(F.when(F.substring(F.ltrim(text), 1, 1) == "[", inner).otherwise(one)).alias("row"))


#: What a grant has to permit.
PERMITS = ("fetch", "transform", "redistribute_to_workers", "retain_derived_index", "display_search_results")
PREFIX_OF = {"synthetic": "synthetic:", "wikimedia": "wikimedia:"}


def rights_problem(source: Column, grant: Column) -> Column:
    """Why a source may not be read, or null; grant has rights, source, permits, written_evidence and attribution."""
    lacking = F.size(F.array_except(F.array(*map(F.lit, PERMITS)), F.coalesce(grant["permits"], F.array().cast("array<string>")))) > 0
    invented = source.isin("synthetic", "synthetic-test-data")
    return (
        F.when(source.isin("google", "streetview"), "google_source_forbidden")
        .when(invented, F.when(F.coalesce(grant["rights"], F.lit("")) != "synthetic-test-data", "synthetic_rights_marker_missing"))
        .when(F.coalesce(source, F.lit("")) != "wikimedia", "unknown_source")
        .when(grant.isNull(), "rights_grant_required")
        .when(~grant["source"].eqNullSafe(source), "rights_source_mismatch")
        .when(lacking, "rights_incomplete")
        .when(~F.coalesce(grant["written_evidence"], F.lit(False)), "written_rights_evidence_required")
        .when(F.trim(F.coalesce(grant["attribution"], F.lit(""))) == "", "attribution_required")
    )


def licensed_records(records: DataFrame) -> DataFrame:
    """Records (source, asset_id, lat, lon, grant and others) with problem: the source's or the asset's, null if neither.

    Records without coordinates get those of their asset's digest.
    """
    lat, lon = synthetic_lat_lon(F.col("asset_id"))
    out = records.withColumn("problem", F.coalesce(rights_problem(F.col("source"), F.col("grant")), asset_problem(F.col("source"), F.col("asset_id"))))
    return out.withColumn("lat", F.coalesce("lat", lat)).withColumn("lon", F.coalesce("lon", lon))


def asset_problem(source: Column, asset: Column) -> Column:
    """Why a record of a gated source is refused, or null."""
    low = F.lower(asset)
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIX_OF.items() for x in kv]), source)
    return F.when(low.contains("maps.googleapis.com") | low.contains("streetview") | low.startswith("google"), "google_source_forbidden").when(wanted.isNotNull() & ~asset.startswith(wanted), F.concat(source, F.lit("_prefix_required")))


def unseen_files(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Files (sha256) that no earlier import has recorded; of equal ones the first by name."""
    first = listing.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in listing.columns if c != "sha256"]), "name").alias("f"))
    return first.join(done.select("sha256"), "sha256", "left_anti").select("sha256", "f.*")
