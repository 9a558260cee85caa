"""Ranked search: score, filter, take the best, and thin the list out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.canonical import canonical_json
from tessera.functions.constants import MAX_RESULTS, PRUNE_M
from tessera.functions.geo import wrap_heading
from tessera.functions.text import canonical_country, is_street_pano
from tessera.operators.filters import Filters, accepted, clamped, overfetch, without_road_names
from tessera.operators.spatial import exclude_used, excluded_points, prune_nearby


def scored(index: DataFrame, query: Column, lane: str = "scene", direction: str = "bestOfFour", filters: Filters = Filters(), width: int = 16, regions: int = 8, whole_query: bool = False) -> DataFrame:
    """index rows that the filters accept, with score and offset."""
    kept = index.where(accepted(filters, F.col("country"), F.col("camera_generation")))
    if lane == "scene":
        best = V.best_view(query, F.col("vector"), direction, width)
        kept = kept.withColumn("_best", best)
        return kept.select(*index.columns, F.col("_best.score").alias("score"), F.col("_best.offset").alias("offset"))
    return kept.withColumn("score", V.best_region(query, F.col("vector"), regions, whole_query=whole_query)).withColumn("offset", F.lit(None).cast("int"))


def best(hits: DataFrame, k: int, tie: str = "asc") -> DataFrame:
    """The k best hits and their rank; ties go to the smaller id, or with tie="desc" are shown the larger id first.

    Selection always prefers the smaller id; only the order of presentation turns. One ordered take per partition, no full sort.
    """
    top = hits.orderBy(F.desc("score"), F.asc("location_id")).limit(k)
    order = Window.orderBy(F.desc("score"), F.desc("location_id") if tie == "desc" else F.asc("location_id"))
    return top.withColumn("rank", F.row_number().over(order))


def search_bytes(index: DataFrame, query: bytes, k: int, direction: str = "bestOfFour", width: int = 16, vector: str = "embedding") -> DataFrame:
    """The k best rows of an index whose vectors are signed bytes, as sealed segments hold them, with score, offset and rank."""
    best_view = V.best_view_of_bytes(query, direction, width)
    hits = index.select("location_id", best_view(F.col(vector)).alias("_best")).select("location_id", "_best.score", "_best.offset")
    return best(hits, k)


def best_by_query(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query_id, with rank; a group limit runs before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("location_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Queries scored at once and index rows of a shard: what one task holds.
QUERY_BLOCK, SHARD_ROWS = 256, 16_384


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows (filled up with zeros), their sizes (-1 for null) and norms, summed from left to right."""
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    rows = np.zeros((len(sizes), max(0, sizes.max(initial=0))))
    for row, v in zip(rows, vectors, strict=True):
        if v is not None:
            row[: len(v)] = v
    squares = np.zeros(len(rows))
    for column in rows.T:
        squares += column * column
    return rows, sizes, np.sqrt(squares)


def search_all(queries: DataFrame, index: DataFrame, k: int, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best index rows (location_id, vector) of every row of queries (query_id, query), by cosine, with rank.

    The index is shuffled once, into shards of about shard_rows; only queries are repeated, once per shard. A shard's rows
    come before its queries, so a task holds one shard and streams any number of queries past it. Sums go from left to
    right as in cosine(), so copies of a vector tie and the smaller location_id is first.
    """
    tasks, n = index.sparkSession.sparkContext.defaultParallelism, index.count()
    shards = 1 + n // min(shard_rows, max(1024, n // tasks))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("query_id").cast("long").alias("id"), F.lit(True).alias("asks"), F.col("query").alias("vector"))
    rows = index.select(F.pmod(F.xxhash64("location_id"), F.lit(shards)).cast("int").alias("shard"), F.col("location_id").cast("long").alias("id"), F.lit(False).alias("asks"), "vector")
    both = rows.unionByName(asked).repartition(max(tasks, shards), "shard").sortWithinPartitions("shard", "asks", "id")

    def hits_of(q, ids, held):
        (a, a_size, a_norm), (b, b_size, b_norm) = _matrix(q["vector"]), held
        total = np.zeros((len(a), len(b)))
        for d in range(min(a.shape[1], b.shape[1])):
            total += np.multiply.outer(a[:, d], b[:, d])
        norms = np.multiply.outer(a_norm, b_norm)
        fit = (a_size[:, None] == b_size[None, :]) & (norms > 0)
        total = np.where(fit, total / np.where(fit, norms, 1.0), -1.0)
        top = np.argsort(-total, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(q["id"].to_numpy(), top.shape[1]), "location_id": ids[top.ravel()], "score": np.take_along_axis(total, top, axis=1).ravel()})

    def score(batches):
        shard, parts, ids, held = None, [], None, None
        for batch in batches:
            for number, part in batch.groupby("shard", sort=True):
                if number != shard:
                    shard, parts, held = number, [], None
                own, q = part[~part["asks"]], part[part["asks"]]
                if len(own):
                    parts.append(own)
                if not len(q) or not parts:
                    continue
                if held is None:
                    whole = pd.concat(parts)
                    ids, held = whole["id"].to_numpy(), _matrix(whole["vector"])
                    parts = [whole.iloc[:0]]
                for start in range(0, len(q), query_block):
                    yield hits_of(q.iloc[start : start + query_block], ids, held)

    return best_by_query(both.mapInPandas(score, "query_id long, location_id long, score double"), k)


def cap_by_country(hits: DataFrame, count: int, per_country: int, by: tuple[str, ...] = ()) -> DataFrame:
    """In order of rank at most per_country hits of a country, count in all; ranks are numbered anew."""
    capped = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "country").orderBy("rank"))).where(F.col("_n") <= per_country).drop("_n")
    order = Window.partitionBy(*by).orderBy("rank") if by else Window.orderBy("rank")
    if not by:
        capped = capped.orderBy("rank").limit(count)
    return capped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def best_per_country(hits: DataFrame, count: int, per_country: int) -> DataFrame:
    """cap_by_country of all hits: a group limit per country before the shuffle, then one ordered take; nothing is ranked as a whole."""
    order = Window.partitionBy("country").orderBy(F.desc("score"), F.asc("location_id"))
    return best(hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_country).drop("_n"), count)


def thinned(hits: DataFrame, used: DataFrame | None, count: int, per_country: int, prune_m: float = 100.0, used_m: float = 25.0) -> DataFrame:
    """exclude used, prune near ones, cap: the order that results depend on."""
    out = hits if used is None else exclude_used(hits, used, used_m)
    if prune_m:
        out = prune_nearby(out.withColumn("query_id", F.lit(0)), prune_m).drop("query_id")
    return cap_by_country(out, count, per_country)


def by_source(hits: DataFrame, k: int, source: str = "source_index") -> DataFrame:
    """The k best hits and their rank; ties go to the smaller place in their source, a missing one counts as 0."""
    place = F.coalesce(source, F.lit(0))
    top = hits.orderBy(F.desc("score"), place, "location_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), place, "location_id")))


def ranked_search(index: DataFrame, query: Column, lane: str = "scene", count: int = 200, per_country: int = 25, direction: str = "bestOfFour", filters: Filters = Filters(), used: DataFrame | None = None, floor: float | None = None, prune_m: float = 100.0, used_m: float = 25.0, width: int = 16, reject_road_names: bool = False, overfetch_excluding: bool = False, drop_invented: bool = False, canonical: bool = False, overfetching: bool = True) -> DataFrame:
    """The whole search: location_id, score, offset, heading, country and the other index columns, by rank.

    count and per_country fall back to their defaults if they are no whole numbers and are held within 1 and 10,000. Of
    used points with a position the first 10,000 with numeric coordinates count. Floors are similarity_floor()'s or any.
    drop_invented leaves out panoramas that no street has, canonical caps and shows countries by their canonical names, and
    without overfetching the thinning goes through the best 10,000, the largest result there is.
    """
    count, per_country = clamped(count, 200), clamped(per_country, 25)
    used = excluded_points(used) if used is not None and "position" in used.columns else used
    index = without_road_names(index) if reject_road_names else index
    index = index.where(is_street_pano(F.col("pano_id"))) if drop_invented else index
    index = index.withColumn("country", canonical_country(F.col("country"))) if canonical else index
    hits = scored(index, query, lane, direction, filters, width)
    if floor is not None:
        hits = hits.where(F.col("score") >= floor)
    wanted = overfetch(count, per_country, overfetch_excluding and used is not None) if overfetching else MAX_RESULTS
    hits = thinned(best(hits, wanted), used, count, per_country, prune_m, used_m)
    return hits.withColumn("view_heading", wrap_heading(F.coalesce("heading", F.lit(0.0)) + 90.0 * F.coalesce("offset", F.lit(0))))


def evenly_sampled(rows: DataFrame, n: int, position: str = "position") -> DataFrame:
    """n evenly spaced rows by position (0, 1, ...), first and last among them; all rows if fewer."""
    total = rows.count()
    if total <= n:
        return rows
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * F.lit(float(total - 1)) / float(max(1, n - 1)), 0).cast("long")))
    places = rows.sparkSession.range(1).select(F.explode(wanted).alias(position))
    return rows.join(F.broadcast(places), position, "left_semi")  # n places at most


def result_map(hits: DataFrame, name: str) -> DataFrame:
    """One map document: hits by rank as custom coordinates."""
    point = F.struct(
        F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lng"), F.col("view_heading").alias("heading"), F.col("pano_id").alias("panoId"),
        F.struct(F.array(F.col("country")).alias("tags"), F.col("rank").alias("rank"), F.round("score", 6).alias("score")).alias("extra"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", point.alias("point")))), lambda x: x["point"])
    return hits.agg(F.to_json(F.struct(F.lit(name).alias("name"), ordered.alias("customCoordinates"))).alias("document"), F.count("*").alias("n"), F.min("score").alias("min_score"))


#: The fields of a result's extra, after tags, in order.
EXTRA = (
    "CameraGeneration", "Score", "MinScore", "Rank", "Query", "QueryMode", "HeadingOffset", "SourceIndex", "ProcessedLocations", "Model", "PruneMeters",
    "ObjectClass", "ObjectClassId", "ObjectLane", "ObjectConfidence", "ObjectSupport", "ObjectBoxArea",
)


def result_extra(query_name: str, mode: str, model: str, min_score: Column, processed: Column, columns: list[str], prefix: str = "", prune_m: float = PRUNE_M) -> Column:
    """The 18 fields that a result carries: tags and EXTRA, each with the prefix. Columns that hits lack are null.

    Scores have seven decimals, ties away from zero; tags is one canonical country or an empty text.
    """
    have = lambda n, kind: F.col(n) if n in columns else F.lit(None).cast(kind)
    camera = have("camera_generation", "string")
    values = (
        F.when(F.coalesce(camera, F.lit("")) == "", "unknown").otherwise(camera), F.round("score", 7), F.round(min_score, 7), F.col("rank").cast("int"), F.lit(query_name), F.lit(mode),
        (90 * F.coalesce(have("offset", "int"), F.lit(0))).cast("int"), F.coalesce(have("source_index", "int"), F.lit(0)).cast("int"), processed, F.lit(model), F.lit(prune_m),
        have("object_class", "string"), have("object_class_id", "int"), have("object_lane", "string"), F.round(have("object_confidence", "double"), 7), have("object_support", "int"), F.round(have("object_box_area", "double"), 7),
    )
    return F.struct(F.array(canonical_country(F.col("country"))).alias("tags"), *[v.alias(f"{prefix}{n}") for n, v in zip(EXTRA, values, strict=True)])


def result_document(hits: DataFrame, name: str, mode: str, model: str, processed: int, prefix: str = "") -> DataFrame:
    """One map document of ranked hits with the whole extra, keys in order; its smallest score is that of the last hit."""
    low = hits.agg(F.coalesce(F.min_by("score", -F.col("rank")), F.lit(0.0)).alias("_low"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in hits.columns else F.lit(0.0)
    extra = result_extra(name, mode, model, F.col("_low"), F.lit(processed).cast("long"), hits.columns, prefix)
    point = F.struct(F.col("lat"), F.col("lon").alias("lng"), F.col("view_heading").alias("heading"), zero("pitch").alias("pitch"), zero("zoom").alias("zoom"), F.col("pano_id").alias("panoId"), extra.alias("extra"))
    rows = hits.crossJoin(low).select("rank", point.alias("point"))  # low is one row
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "point"))), lambda x: x["point"])
    one = rows.agg(F.struct(F.lit(name).alias("name"), ordered.alias("customCoordinates")).alias("map"), F.count("*").alias("n"))
    return one.select(canonical_json(one, "map").alias("document"), "n")
