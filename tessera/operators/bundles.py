"""Index bundles: global ids and their records, restamping, audits of files against a manifest, fixture checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _little_endian(number: Column, size: int) -> Column:
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def global_id_record(number: Column) -> Column:
    """Twelve bytes: the id and the CRC32 of its eight bytes, both little-endian."""
    raw = _little_endian(number.cast("long"), 8)
    return F.concat(raw, _little_endian(F.crc32(raw), 4))


def record_is_sound(record: Column) -> Column:
    """Whether a twelve-byte record's checksum fits its id."""
    return (F.octet_length(record) == 12) & (_little_endian(F.crc32(F.substring(record, 1, 8)), 4) == F.substring(record, 9, 4))


def restamped_records(records: DataFrame, old_start: int, new_start: int, column: str = "record") -> DataFrame:
    """Twelve-byte records with their ids moved from one start to another; a record whose checksum doesn't fit is an error."""
    big = lambda c: F.concat(*[F.substring(F.hex(c), 2 * i + 1, 2) for i in reversed(range(8))])
    old = F.conv(big(F.col(column)), 16, 10).cast("long")
    moved = global_id_record(old - old_start + new_start)
    return records.withColumn(column, F.when(record_is_sound(F.col(column)), moved).otherwise(F.raise_error(F.lit("an unsound record")).cast("binary")))


def restamped(lines: DataFrame, shift: int, column: str = "value") -> DataFrame:
    """Twelve-column lines with shift added to the global id in the last one; other widths are an error."""
    c = F.split(column, "\t", -1)
    moved = F.concat_ws("\t", F.slice(c, 1, 11), (F.get(c, F.lit(11)).cast("long") + shift).cast("string"))
    fit = F.when(F.size(c) == 12, moved).otherwise(F.raise_error(F.lit("a line without twelve columns")).cast("string"))
    return lines.withColumn(column, fit)


def file_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem) for files that are missing, not listed, or unlike the manifest in size or digest.

    Both have name, bytes and sha256; files comes from file_digests or any listing.
    """
    m = manifest.select("name", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha256"), F.lit(True).alias("listed"))
    both = files.select("name", "bytes", "sha256", F.lit(True).alias("there")).join(m, "name", "full_outer")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(F.col("bytes") != F.col("m_bytes"), "size").when(F.col("sha256") != F.col("m_sha256"), "digest")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, sha256) of the files below path; Spark's reader passes over empty ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fixture_problems(rows: DataFrame, generation: str = "gen4") -> DataFrame:
    """(rows, ids, panos, odd): a sound fixture has as many ids and panoramas as rows and none of another generation."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("location_id").alias("ids"), F.countDistinct("pano_id").alias("panos"), F.count_if(F.coalesce("camera_generation", F.lit("")) != generation).alias("odd"))


def fixture_counts(rows: DataFrame) -> DataFrame:
    """(country, rows, headings, generations): a fixture's rows and distinct headings and generations per country."""
    return rows.groupBy(F.coalesce("country", F.lit("")).alias("country")).agg(F.count("*").alias("rows"), F.countDistinct("heading").alias("headings"), F.countDistinct("camera_generation").alias("generations"))


def canary_problems(rows: DataFrame, canary: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(place, problem) for lines of a canary (place, line) that aren't the lines of rows (row_index, line) at ordinals (place, row_index)."""
    want = ordinals.join(rows.select("row_index", F.col("line").alias("_want")), "row_index", "left")
    both = canary.select("place", F.col("line").alias("_line")).join(want, "place", "full_outer")
    problem = F.when(F.col("_line").isNull(), "missing").when(F.col("row_index").isNull(), "surplus").when(~F.col("_line").eqNullSafe(F.col("_want")), "changed")
    return both.select("place", problem.alias("problem")).where("problem IS NOT NULL")
