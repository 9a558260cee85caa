"""Audit of submitted vectors: a sample is computed anew, the rest is held against its own digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.features import vector_of
from tessera.functions.text import is_street_pano
from tessera.functions.vectors import output_digest

#: Bytes of a vector by lane.
WIDTH = {"scene": 96, "object": 128}


def sampled(rows: DataFrame) -> DataFrame:
    """rows (lease_id, location_id, asset_id) with sampled: every invented panorama and the first street one of a lease."""
    street = rows.withColumn("_street", is_street_pano(F.col("asset_id")))
    first = street.where("_street").groupBy("lease_id").agg(F.min("location_id").alias("_first"))  # map-side combined
    return street.join(first, "lease_id", "left").withColumn("sampled", ~F.col("_street") | F.coalesce(F.col("location_id") == F.col("_first"), F.lit(False))).drop("_street", "_first")


def audited(rows: DataFrame, model_id: str) -> DataFrame:
    """rows with sampled, expected_sha256 and problem, the first that holds: model, length, digest, embedding; or null.

    rows: lease_id, location_id, asset_id, capture, lane, model, embedding, output_sha256. One Arrow pass draws the faces
    and makes the vectors of the sampled rows only. Their digest has to be that of the new vector, and so has the vector,
    if one is given; the other rows' digest has to be that of the vector which they give.
    """
    key = F.concat_ws("\n", "asset_id", "capture", "lane", "model")
    width = F.create_map(*[F.lit(x) for pair in WIDTH.items() for x in pair])[F.col("lane")]
    out = sampled(rows).withColumn("_own", vector_of(key, F.when(F.col("sampled"), F.col("lane"))))
    true = F.when(F.col("sampled"), F.col("_own")).otherwise(F.col("embedding"))
    out = out.withColumn("expected_sha256", output_digest(F.lit(model_id), F.col("asset_id"), F.col("capture"), F.col("lane"), F.col("model"), true))
    given = F.col("embedding").isNotNull()
    problem = (
        F.when(~F.col("model").eqNullSafe(F.lit(model_id)), "model").when((given & (F.length("embedding") != width)) | (~given & ~F.col("sampled")), "length")
        .when(~F.col("output_sha256").eqNullSafe(F.col("expected_sha256")), "digest").when(F.col("sampled") & given & (F.col("embedding") != F.col("_own")), "embedding")
    )
    return out.withColumn("problem", problem).drop("_own")
