"""Views that stand in for the catalogue, its index and its ledgers, over the synthetic tables; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.constants import GENERATIONS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SCENE_MODEL, OBJECT_MODEL = "visual-v1", "object-v1"


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; its footers are read for the schema once per application."""
    path = f"{d}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def _pick(key: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def locations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    out = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    state = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "leased").otherwise("published")
    lane = F.when(k % 7 < 4, "scene").otherwise("object")
    return out.select(
        k.alias("location_id"), F.concat(F.when(k % 10 == 0, "Prototype").otherwise("pano-"), k.cast("string")).alias("asset_id"),
        ((F.floor(k / 30) * 37 % 1400).cast("double") / 10.0 - 70.0 + (k * 7919 % 1000).cast("double") * 0.000003).alias("lat"),
        ((F.floor(k / 30) * 101 % 3600).cast("double") / 10.0 - 180.0 + (k * 104729 % 1000).cast("double") * 0.000003).alias("lon"),
        "country", _pick(k, GENERATIONS).alias("camera_generation"), lane.alias("lane"), F.when(k % 2 == 0, "2019-06").otherwise("2021-09").alias("capture"),
        F.when(lane == "scene", SCENE_MODEL).otherwise(OBJECT_MODEL).alias("model"), state.alias("state"),
        F.when(k % 3 == 1, k * 100).alias("lease_until"), F.when(k % 11 == 0, "skipped").alias("queue_state"),
        (k * 37 % 720).cast("double").alias("heading"), (k % 3).cast("double").alias("zoom"), (k % 20 - 10).cast("double").alias("pitch"),
    )


LOCATIONS = f"""locations AS (SELECT k AS location_id, CASE WHEN k % 10 = 0 THEN 'Prototype' ELSE 'pano-' END || k AS asset_id,
    CAST(k // 30 * 37 % 1400 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(70 AS DOUBLE) + CAST(k * 7919 % 1000 AS DOUBLE) * CAST(0.000003 AS DOUBLE) AS lat,
    CAST(k // 30 * 101 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) + CAST(k * 104729 % 1000 AS DOUBLE) * CAST(0.000003 AS DOUBLE) AS lon,
    n_name AS country, {list(GENERATIONS)}[k % 6 + 1] AS camera_generation, CASE WHEN k % 7 < 4 THEN 'scene' ELSE 'object' END AS lane,
    CASE WHEN k % 2 = 0 THEN '2019-06' ELSE '2021-09' END AS capture, CASE WHEN k % 7 < 4 THEN '{SCENE_MODEL}' ELSE '{OBJECT_MODEL}' END AS model,
    CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' ELSE 'published' END AS state, CASE WHEN k % 3 = 1 THEN k * 100 END AS lease_until,
    CASE WHEN k % 11 = 0 THEN 'skipped' END AS queue_state, CAST(k * 37 % 720 AS DOUBLE) AS heading, CAST(k % 3 AS DOUBLE) AS zoom, CAST(k % 20 - 10 AS DOUBLE) AS pitch
    FROM (SELECT c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        k.alias("location_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.concat(F.lit("country "), F.col("label").cast("string")).alias("country"),
        _pick(k, GENERATIONS).alias("camera_generation"), F.concat(F.lit("pano-"), F.floor(k / 2).cast("string")).alias("pano_id"),
        ((F.floor(k / 25) * 37 % 1400).cast("double") / 10.0 - 70.0 + (k * 7919 % 1000).cast("double") * 0.000003).alias("lat"),
        ((F.floor(k / 25) * 101 % 3600).cast("double") / 10.0 - 180.0 + (k * 104729 % 1000).cast("double") * 0.000003).alias("lon"),
        (k * 37 % 720).cast("double").alias("heading"),
    )


VECTORS = f"""vectors AS (SELECT vec_id AS location_id, CAST(embedding AS DOUBLE[]) AS vector, 'country ' || label AS country, {list(GENERATIONS)}[vec_id % 6 + 1] AS camera_generation,
    'pano-' || (vec_id // 2) AS pano_id,
    CAST(vec_id // 25 * 37 % 1400 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(70 AS DOUBLE) + CAST(vec_id * 7919 % 1000 AS DOUBLE) * CAST(0.000003 AS DOUBLE) AS lat,
    CAST(vec_id // 25 * 101 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) + CAST(vec_id * 104729 % 1000 AS DOUBLE) * CAST(0.000003 AS DOUBLE) AS lon,
    CAST(vec_id * 37 % 720 AS DOUBLE) AS heading FROM embeddings)"""


def query_vector(spark: SparkSession, d: str, location_id: int = 0) -> Column:
    """One stated vector as a literal."""
    row = vectors(spark, d).where(F.col("location_id") == location_id).select("vector").first()
    return F.array(*map(F.lit, row.vector))


QUERY = "(SELECT vector FROM vectors WHERE location_id = 0)"


def used(spark: SparkSession, d: str) -> DataFrame:
    """Every 50th vector's place, as a previous result."""
    return vectors(spark, d).where("location_id % 50 = 7").select("pano_id", "lat", "lon", F.col("location_id").alias("position"))


USED = "used AS (SELECT pano_id, lat, lon, location_id AS position FROM vectors WHERE location_id % 50 = 7)"


def published(spark: SparkSession, d: str) -> DataFrame:
    loc = locations(spark, d)
    k = F.col("location_id")
    rows = loc.where(((F.col("state") == "published") & (k % 17 != 0)) | (k % 57 == 0))
    return rows.select(
        "location_id", F.sha2(F.concat(F.lit("out"), F.when(k % 23 == 0, F.lit("x")).otherwise(F.lit("")), k.cast("string")), 256).alias("output_sha256"),
        F.when(k % 4 > 0, F.concat(F.lit("index-"), (k % 13).cast("string"))).alias("index_key"), (k * 10).alias("published_at"),
    )


PUBLISHED = """published AS (SELECT location_id, sha256('out' || CASE WHEN location_id % 23 = 0 THEN 'x' ELSE '' END || location_id) AS output_sha256,
    CASE WHEN location_id % 4 > 0 THEN 'index-' || (location_id % 13) END AS index_key, location_id * 10 AS published_at
    FROM locations WHERE (state = 'published' AND location_id % 17 <> 0) OR location_id % 57 = 0)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").alias("account_id"), (F.round(F.col("value") * 100, 0).cast("long") * sign).alias("units"), F.col("event_id").alias("reference"), F.col("event_type").alias("kind")
    )


LEDGER = """ledger AS (SELECT user_id AS account_id, CAST(round(value * CAST(100 AS DOUBLE)) AS BIGINT) * CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS units,
    event_id AS reference, event_type AS kind FROM events WHERE event_type IN ('purchase', 'error'))"""


def leases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").where("event_type = 'view'").select(
        k.alias("lease_id"), F.col("user_id").alias("account_id"), (k * 13 % 1500).alias("location_id"),
        F.when(k % 3 == 0, "active").when(k % 3 == 1, "submitted").otherwise("expired").alias("state"), (k * 100).alias("expires_at"),
    )


LEASES = """leases AS (SELECT event_id AS lease_id, user_id AS account_id, event_id * 13 % 1500 AS location_id,
    CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'submitted' ELSE 'expired' END AS state, event_id * 100 AS expires_at FROM events WHERE event_type = 'view')"""


def shards(spark: SparkSession, d: str) -> DataFrame:
    """One shard of the pose catalogue per supplier."""
    k = F.col("s_suppkey")
    prefix = F.element_at(F.array(F.lit("catalog/all-locations-tail-v1/"), F.lit("catalog/all-locations-full-v1/"), F.lit("catalog/vision-indexed-v1/"), F.lit("elsewhere/")), (k % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(
        k.alias("shard_id"), F.when(k % 2 == 0, "scene").otherwise("object").alias("lane"), F.concat(prefix, k.cast("string"), F.lit(".tsv")).alias("key"),
        (k * 31 % 500 + 10).alias("row_count"), F.least(k * 17 % 600, k * 31 % 500 + 10).alias("next_row"),
        F.when(k % 5 == 0, (k * 7 % 150)).alias("assignee"), F.when(k % 5 == 0, k * 1000).alias("held_since"),
    )


SHARDS = """shards AS (SELECT s_suppkey AS shard_id, CASE WHEN s_suppkey % 2 = 0 THEN 'scene' ELSE 'object' END AS lane,
    ['catalog/all-locations-tail-v1/', 'catalog/all-locations-full-v1/', 'catalog/vision-indexed-v1/', 'elsewhere/'][s_suppkey % 4 + 1] || s_suppkey || '.tsv' AS key,
    s_suppkey * 31 % 500 + 10 AS row_count, least(s_suppkey * 17 % 600, s_suppkey * 31 % 500 + 10) AS next_row,
    CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 7 % 150 END AS assignee, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 1000 END AS held_since FROM supplier)"""

#: SQL of the great-circle distance, in both engines' dialect.
def haversine_sql(a: str, b: str) -> str:
    return (
        f"2 * CAST(6371000 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(power(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )
