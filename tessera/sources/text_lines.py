"""Tab-separated location lines: headered, of 11 or 12 columns, and older ones of 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import capture

COLUMNS = ("map_id", "location_id", "lat", "lng", "heading", "pitch", "zoom", "pano_id", "country", "camera_generation", "road_name_state")


def normal_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of 11 text columns from lines of 11 or 9; other widths are left out. An empty location_id takes the map_id."""
    c = F.split(column, "\t", -1)
    fit = lines.select(c.alias("c")).where(F.size("c").isin(9, 11))
    out = fit.select(*[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(COLUMNS)])
    return out.withColumn("location_id", F.when(F.col("location_id") == "", F.col("map_id")).otherwise(F.col("location_id")))


def strict_lines(lines: DataFrame, column: str = "value", width: int = 11) -> DataFrame:
    """Typed rows; blank and header lines are skipped, any other width is an error."""
    value = F.col(column)
    rows = lines.where((F.trim(value) != "") & ~(value.startswith("map_id") & value.contains("pano_id")))
    c = F.split(value, "\t", -1)
    checked = F.when(F.size(c) == width, c).otherwise(F.raise_error(F.concat(F.lit("columns: "), F.size(c).cast("string"))).cast("array<string>"))
    names = (*COLUMNS, "global_id")[:width]
    kinds = {"location_id": "long", "global_id": "long", **dict.fromkeys(("lat", "lng", "heading", "pitch", "zoom"), "double")}
    return rows.select(checked.alias("c")).select(*[F.get("c", F.lit(i)).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)])


def read_headered(spark: SparkSession, path: str, lane: str, model: str) -> DataFrame:
    """A headered catalogue as job rows; rows without a panorama are skipped, absent columns are null."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    for name in ("lat", "lng", "heading", "pitch", "zoom", "country", "camera_generation", "capture_year", "capture_month"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    number = lambda n: F.coalesce(F.expr(f"try_cast({n} AS DOUBLE)"), F.lit(0.0)).alias(n)
    rows = raw.where(F.coalesce(F.trim("pano_id"), F.lit("")) != "")
    return rows.select(F.trim("pano_id").alias("asset_id"), capture(F.col("capture_year"), F.col("capture_month")).alias("capture"), F.lit(lane).alias("lane"), F.lit(model).alias("model"), *map(number, ("lat", "lng", "heading", "pitch", "zoom")), "country", "camera_generation")


def read_any(spark: SparkSession, path: str, lane: str, model: str) -> DataFrame:
    """By the first line that isn't blank: a header with pano_id and lat, or headerless lines of 11 columns."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    names = first.value.split("\t") if first else []
    if "pano_id" in names and "lat" in names and names[0] != "map_id":
        return read_headered(spark, path, lane, model)
    rows = strict_lines(spark.read.text(path))
    return rows.select(F.col("pano_id").alias("asset_id"), F.lit("unknown").alias("capture"), F.lit(lane).alias("lane"), F.lit(model).alias("model"), "lat", "lng", "heading", "pitch", "zoom", "country", "camera_generation")


def as_lines(rows: DataFrame) -> DataFrame:
    """One column of 11-column lines, ids as they are; a field with a tab or line break is an error."""
    from tessera.functions.text import number_15g

    def field(n):
        if n in ("lat", "lng", "heading", "pitch", "zoom"):
            return number_15g(F.col(n).cast("double"))
        v = F.coalesce(F.col(n).cast("string"), F.lit("no road name" if n == "road_name_state" else ""))
        return F.when(v.rlike("[\t\n\r]"), F.raise_error(F.lit(f"control character in {n}")).cast("string")).otherwise(v)

    return rows.select(F.concat_ws("\t", *map(field, COLUMNS)).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    as_lines(rows).write.text(path)
