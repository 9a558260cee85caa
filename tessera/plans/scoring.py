"""Queries on vectors, distances and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import vectors as V
from tessera.functions.constants import DIRECTIONS, GENERATIONS, SCENE_FLOORS
from tessera.operators import ranking as R
from tessera.operators.filters import Filters, accepted, normal_filters, overfetch
from tessera.operators.spatial import duplicate_flags, exclude_used, prune_nearby
from tessera.plans import views as W

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


@query("topk_cosine", f"WITH {W.VECTORS} SELECT location_id, round({_cos(W.QUERY, 'vector')}, 6) AS score FROM vectors ORDER BY {_cos(W.QUERY, 'vector')} DESC, location_id LIMIT 25")
def topk_cosine(spark, d):
    hits = W.vectors(spark, d).select("location_id", V.cosine(W.query_vector(spark, d), F.col("vector")).alias("score"))
    return hits.orderBy(F.desc("score"), "location_id").limit(25).withColumn("score", F.round("score", 6))


def _view_sql(direction: str) -> str:
    faces = DIRECTIONS[direction]
    scores = ", ".join(f"{{'s': {_cos(W.QUERY + '[1:16]', f'vector[{16 * k + 1}:{16 * k + 16}]')}, 'i': {-i}, 'o': {k}}}" for i, k in enumerate(faces))
    return f"WITH {W.VECTORS}, s AS (SELECT location_id, heading, list_max([{scores}]) AS b FROM vectors) SELECT location_id, round(b.s, 6) AS score, b.o AS view_offset, (heading + 90 * b.o) % 360 AS view_heading FROM s"


def _view(direction: str):
    def run(spark, d):
        hits = R.scored(W.vectors(spark, d), W.query_vector(spark, d), "scene", direction)
        return hits.select("location_id", F.round("score", 6).alias("score"), F.col("offset").alias("view_offset"), geo.wrap_heading(F.col("heading") + 90.0 * F.col("offset")).alias("view_heading"))

    return run


for _d in DIRECTIONS:
    _name = "scene_best_view_" + "".join("_" + c.lower() if c.isupper() else c for c in _d)
    QUERIES[_name], SQL[_name] = _view(_d), _view_sql(_d)


def _region_sql(queries) -> str:
    every = ", ".join(_cos(f"{W.QUERY}[{8 * q + 1}:{8 * q + 8}]", f"vector[{8 * r + 1}:{8 * r + 8}]") for q in queries for r in range(8))
    return f"WITH {W.VECTORS} SELECT location_id, round(list_max([{every}]), 6) AS score FROM vectors"


@query("object_max_region", _region_sql(range(1)))
def object_max_region(spark, d):
    return R.scored(W.vectors(spark, d), W.query_vector(spark, d), "object").select("location_id", F.round("score", 6).alias("score"))


@query("object_all_regions", _region_sql(range(8)))
def object_all_regions(spark, d):
    return R.scored(W.vectors(spark, d), W.query_vector(spark, d), "object", whole_query=True).select("location_id", F.round("score", 6).alias("score"))


@query("min_similarity_filter", f"WITH {W.VECTORS} SELECT location_id, round({_cos(W.QUERY, 'vector')}, 6) AS score FROM vectors WHERE {_cos(W.QUERY, 'vector')} >= CAST({SCENE_FLOORS[100]} AS DOUBLE)")
def min_similarity_filter(spark, d):
    hits = W.vectors(spark, d).select("location_id", V.cosine(W.query_vector(spark, d), F.col("vector")).alias("score"))
    return hits.where(F.col("score") >= SCENE_FLOORS[100]).withColumn("score", F.round("score", 6))


def _filtered(name: str, filters: Filters, where: str):
    def run(spark, d):
        return W.locations(spark, d).where(accepted(filters, F.col("country"), F.col("camera_generation"))).select("location_id", "country", "camera_generation")

    QUERIES[name], SQL[name] = run, f"WITH {W.LOCATIONS} SELECT location_id, country, camera_generation FROM locations WHERE {where}"


_filtered("filter_include", normal_filters("include", ["NATION_6", " NATION_12 ", "NATION_6"]), "trim(country) IN ('NATION_6', 'NATION_12')")
_filtered("filter_exclude", normal_filters("exclude", ["NATION_6", "NATION_12"]), "coalesce(trim(country), '') NOT IN ('NATION_6', 'NATION_12')")
_filtered("filter_include_none", normal_filters("include", []), "false")
_filtered("filter_generation", normal_filters("all", None, ["gen4", "trekker", "nonsense"]), "camera_generation IN ('gen4', 'trekker')")
_filtered("filter_every_generation", normal_filters("odd", ["NATION_6"], list(GENERATIONS)), "true")


@query("heading_wrap", f"WITH {W.LOCATIONS} SELECT location_id, round(((heading - 450) % 360 + 360) % 360, 6) AS heading FROM locations")
def heading_wrap(spark, d):
    return W.locations(spark, d).select("location_id", F.round(geo.wrap_heading(F.col("heading") - 450.0), 6).alias("heading"))


@query("thumbnail_fov", f"WITH {W.LOCATIONS} SELECT location_id, round(greatest(CAST(30 AS DOUBLE), least(CAST(120 AS DOUBLE), 2 * degrees(atan(0.75 * power(CAST(2 AS DOUBLE), 1 - zoom))))), 6) AS fov FROM locations")
def thumbnail_fov(spark, d):
    return W.locations(spark, d).select("location_id", F.round(geo.thumbnail_fov(F.col("zoom")), 6).alias("fov"))


@query(
    "view_plan",
    f"""WITH {W.LOCATIONS}, v AS (SELECT *, unnest(range(0, 6)) AS face FROM locations)
    SELECT location_id, CAST(face AS INTEGER) AS face, (heading + CASE WHEN face < 4 THEN 90 * face ELSE 0 END) % 360 AS heading,
        CASE face WHEN 4 THEN CAST(90 AS DOUBLE) WHEN 5 THEN CAST(-90 AS DOUBLE) ELSE CASE WHEN lane = 'scene' THEN pitch ELSE CAST(0 AS DOUBLE) END END AS pitch,
        round(CASE WHEN face > 3 OR lane <> 'scene' THEN CAST(90 AS DOUBLE) ELSE greatest(CAST(30 AS DOUBLE), least(CAST(120 AS DOUBLE), 2 * degrees(atan(0.75 * power(CAST(2 AS DOUBLE), 1 - zoom))))) END, 6) AS fov FROM v""",
)
def view_plan(spark, d):
    plan = W.locations(spark, d).select("location_id", F.inline(geo.view_plan(F.col("lane"), F.col("heading"), F.col("pitch"), F.col("zoom"))))
    return plan.withColumn("fov", F.round("fov", 6))


@query(
    "haversine_pairs",
    f"WITH {W.LOCATIONS} SELECT a.location_id, round({W.haversine_sql('a', 'b')}, 3) AS meters FROM locations a JOIN locations b ON b.location_id = a.location_id + 1",
)
def haversine_pairs(spark, d):
    a = W.locations(spark, d).select("location_id", "lat", "lon")
    b = a.select((F.col("location_id") - 1).alias("location_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "location_id").select("location_id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("meters"))


@query(
    "synthetic_coordinates",
    f"""WITH {W.LOCATIONS} SELECT location_id, round(CAST('0x' || substr(sha256(asset_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) * 140 - 70, 6) AS lat,
    round(CAST('0x' || substr(sha256(asset_id), 9, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) * 360 - 180, 6) AS lon FROM locations""",
)
def synthetic_coordinates(spark, d):
    lat, lon = geo.synthetic_lat_lon(F.col("asset_id"))
    return W.locations(spark, d).select("location_id", lat.alias("lat"), lon.alias("lon"))


@query(
    "spatial_defer_25m",
    f"""WITH {W.LOCATIONS} SELECT location_id, EXISTS (SELECT 1 FROM locations b WHERE b.lane = a.lane AND b.capture = a.capture AND b.model = a.model AND b.asset_id <> a.asset_id
    AND b.location_id < a.location_id AND abs(b.lat - a.lat) < 0.001 AND {W.haversine_sql('a', 'b')} <= 25) AS deferred FROM locations a""",
)
def spatial_defer_25m(spark, d):
    return duplicate_flags(W.locations(spark, d)).select("location_id", "deferred")


@query(
    "exclude_used",
    f"""WITH {W.VECTORS}, {W.USED} SELECT location_id FROM vectors a WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.pano_id = a.pano_id)
    AND NOT EXISTS (SELECT 1 FROM used u WHERE {W.haversine_sql('a', 'u')} < 25)""",
)
def exclude_used_query(spark, d):
    return exclude_used(W.vectors(spark, d), W.used(spark, d)).select("location_id")


_HITS = f"hits AS (SELECT *, {_cos(W.QUERY, 'vector')} AS score FROM vectors), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, location_id) AS rank FROM hits)"


def _hits(spark, d, k: int):
    hits = W.vectors(spark, d).withColumn("score", V.cosine(W.query_vector(spark, d), F.col("vector")))
    return R.best(hits, k)


@query(
    "cap_by_country",
    f"""WITH {W.VECTORS}, {_HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY rank) AS n FROM ranked)
    SELECT location_id, country, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM c WHERE n <= 3 ORDER BY rank LIMIT 20""",
)
def cap_by_country(spark, d):
    hits = W.vectors(spark, d).withColumn("score", V.cosine(W.query_vector(spark, d), F.col("vector")))
    return R.best_per_country(hits, 20, 3).select("location_id", "country", "rank")


@query(
    "overfetch_cap",
    f"""WITH {W.VECTORS}, {_HITS}, o AS (SELECT * FROM ranked WHERE rank <= {overfetch(20, 3)}), c AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY rank) AS n FROM o)
    SELECT location_id, country, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM c WHERE n <= 3 ORDER BY rank LIMIT 20""",
)
def overfetch_cap(spark, d):
    return R.cap_by_country(_hits(spark, d, overfetch(20, 3)), 20, 3).select("location_id", "country", "rank")


@query(
    "top_k_tie_desc",
    f"WITH {W.VECTORS}, h AS (SELECT location_id, round({_cos(W.QUERY, 'vector')}, 1) AS score FROM vectors), t AS (SELECT * FROM h ORDER BY score DESC, location_id LIMIT 30)"
    " SELECT location_id, score, CAST(row_number() OVER (ORDER BY score DESC, location_id DESC) AS INTEGER) AS rank FROM t",
)
def top_k_tie_desc(spark, d):
    hits = W.vectors(spark, d).select("location_id", F.round(V.cosine(W.query_vector(spark, d), F.col("vector")), 1).alias("score"))
    return R.best(hits, 30, tie="desc")


_PRUNE = """walk(rank, kept) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE, pano VARCHAR)[])
    UNION ALL
    SELECT r.rank, CASE WHEN len(list_filter(w.kept, lambda k: k.pano = r.pano_id OR 2 * 6371000 * asin(least(CAST(1 AS DOUBLE), sqrt(power(sin(radians(r.lat - k.lat) / 2), 2)
        + cos(radians(k.lat)) * cos(radians(r.lat)) * power(sin(radians(r.lon - k.lon) / 2), 2)))) < 100)) > 0
        THEN w.kept ELSE list_append(w.kept, {'id': r.location_id, 'lat': r.lat, 'lon': r.lon, 'pano': r.pano_id}) END
    FROM walk w JOIN base r ON r.rank = w.rank + 1),
kept AS (SELECT unnest(kept).id AS location_id FROM walk WHERE rank = (SELECT max(rank) FROM walk))"""


@query(
    "prune_nearby",
    f"""WITH RECURSIVE {W.VECTORS}, {_HITS}, base AS (SELECT rank, location_id, lat, lon, pano_id FROM ranked WHERE rank <= 80), {_PRUNE}
    SELECT location_id, CAST(rank AS INTEGER) AS rank FROM base JOIN kept USING (location_id)""",
)
def prune_nearby_query(spark, d):
    hits = _hits(spark, d, 80).withColumn("query_id", F.lit(0))
    return prune_nearby(hits).select("location_id", "rank")


_VIEW = ", ".join(f"{{'s': {_cos(W.QUERY + '[1:16]', f'vector[{16 * k + 1}:{16 * k + 16}]')}, 'i': {-k}, 'o': {k}}}" for k in range(4))
_SEARCH = f"""WITH RECURSIVE {W.VECTORS}, {W.USED}, scored AS (SELECT *, list_max([{_VIEW}]) AS b FROM vectors WHERE camera_generation <> 'badcam' AND country NOT IN ('country 3')),
top AS (SELECT *, row_number() OVER (ORDER BY b.s DESC, location_id) AS top_rank FROM scored ORDER BY top_rank LIMIT {overfetch(30, 5)}),
base AS (SELECT *, row_number() OVER (ORDER BY top_rank) AS rank FROM top a WHERE pano_id NOT IN (SELECT pano_id FROM used) AND NOT EXISTS (SELECT 1 FROM used u WHERE {W.haversine_sql('a', 'u')} < 25)),
{_PRUNE},
capped AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY rank) AS n FROM base JOIN kept USING (location_id)),
final AS (SELECT *, row_number() OVER (ORDER BY rank) AS place FROM capped WHERE n <= 5 ORDER BY rank LIMIT 30)"""
_FILTERS = normal_filters("exclude", ["country 3"], [g for g in GENERATIONS if g != "badcam"])


def _search(spark, d):
    return R.ranked_search(W.vectors(spark, d), W.query_vector(spark, d), count=30, per_country=5, filters=_FILTERS, used=W.used(spark, d))


@query(
    "ranked_search_full",
    f"{_SEARCH} SELECT location_id, CAST(place AS INTEGER) AS rank, round(b.s, 6) AS score, b.o AS view_offset, (heading + 90 * b.o) % 360 AS view_heading, country FROM final",
)
def ranked_search_full(spark, d):
    return _search(spark, d).select("location_id", "rank", F.round("score", 6).alias("score"), F.col("offset").alias("view_offset"), "view_heading", "country")


@query("search_min_score", f"{_SEARCH} SELECT count(*) AS n, round(min(b.s), 6) AS min_score FROM final")
def search_min_score(spark, d):
    return R.result_map(_search(spark, d), "result").select("n", F.round("min_score", 6).alias("min_score"))


@query("search_map_json", f"{_SEARCH} SELECT 'result' AS name, string_agg(pano_id, ',' ORDER BY place) AS panos FROM final")
def search_map_json(spark, d):
    doc = R.result_map(_search(spark, d), "result")
    read = F.from_json("document", "name string, customCoordinates array<struct<panoId: string>>")
    return doc.select(read.alias("m")).select("m.name", F.array_join("m.customCoordinates.panoId", ",").alias("panos"))


@query(
    "multi_query_search",
    f"""WITH {W.VECTORS}, s AS (SELECT q.location_id AS query_id, v.location_id, {_cos('q.vector', 'v.vector')} AS score FROM vectors q JOIN vectors v ON true WHERE q.location_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, location_id) AS INTEGER) AS rank FROM s) SELECT query_id, location_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def multi_query_search(spark, d):
    v = W.vectors(spark, d).select("location_id", "vector")
    asked = v.where("location_id % 50 = 0").select(F.col("location_id").alias("query_id"), F.col("vector").alias("query"))
    return R.search_all(asked, v, 10).select("query_id", "location_id", "rank", F.round("score", 6).alias("score"))


#: The same under the name that it has had beside the former sixteen queries.
QUERIES["multi_query_search_whole"], SQL["multi_query_search_whole"] = multi_query_search, SQL["multi_query_search"]


_INTS = "q AS (SELECT location_id, list_transform(vector, lambda x: CAST(greatest(-127, least(127, round(x * 127))) AS DOUBLE)) AS v FROM vectors)"
_INT_VIEWS = ", ".join(f"{{'s': list_cosine_similarity((SELECT v FROM q WHERE location_id = 0)[1:16], v[{16 * k + 1}:{16 * k + 16}]), 'i': {-i}, 'o': {k}}}" for i, k in enumerate(DIRECTIONS["sideAxis"]))


@query("byte_search", f"WITH {W.VECTORS}, {_INTS}, s AS (SELECT location_id, list_max([{_INT_VIEWS}]) AS b FROM q) SELECT location_id, round(b.s, 6) AS score, CAST(b.o AS INTEGER) AS view_offset, CAST(row_number() OVER (ORDER BY b.s DESC, location_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 25")
def byte_search(spark, d):
    index = W.vectors(spark, d).select("location_id", V.as_bytes(V.quantized(F.col("vector"))).alias("embedding"))
    asked = bytes(index.where("location_id = 0").first().embedding)
    return R.search_bytes(index, asked, 25, "sideAxis").select("location_id", F.round("score", 6).alias("score"), F.col("offset").alias("view_offset"), "rank")


@query("evenly_sample", f"WITH {W.LOCATIONS}, n AS (SELECT count(*) AS n FROM locations) SELECT location_id FROM locations, n WHERE location_id IN (SELECT CAST(round_even(i * CAST(n.n - 1 AS DOUBLE) / 99, 0) AS BIGINT) FROM n, range(0, 100) t(i))")
def evenly_sample(spark, d):
    return R.evenly_sampled(W.locations(spark, d).select("location_id"), 100, "location_id")


@query("scanned_counts", f"WITH {W.VECTORS} SELECT country, count(*) AS scanned FROM vectors WHERE camera_generation <> 'badcam' AND country <> 'country 3' GROUP BY country")
def scanned_counts(spark, d):
    return W.vectors(spark, d).where(accepted(_FILTERS, F.col("country"), F.col("camera_generation"))).groupBy("country").agg(F.count("*").alias("scanned"))


@query("int8_quantize", f"WITH {W.VECTORS} SELECT location_id, array_to_string(list_transform(vector, lambda x: CAST(greatest(-127, least(127, round(x * 127))) AS INTEGER)), ',') AS bytes FROM vectors")
def int8_quantize(spark, d):
    return W.vectors(spark, d).select("location_id", F.array_join(V.quantized(F.col("vector")).cast("array<string>"), ",").alias("bytes"))


_Q = "q AS (SELECT location_id, country, list_transform(vector, lambda x: CAST(greatest(-127, least(127, round(x * 127))) AS INTEGER)) AS v FROM vectors)"


@query(
    "mean_embedding",
    f"""WITH {W.VECTORS}, {_Q}, u AS (SELECT country, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q)
    SELECT country, CAST(i - 1 AS INTEGER) AS position, CAST(greatest(-127, least(127, floor(sum(x) / CAST(count(*) AS DOUBLE)))) AS INTEGER) AS mean FROM u GROUP BY country, i""",
)
def mean_embedding(spark, d):
    q = W.vectors(spark, d).select("country", F.posexplode(V.quantized(F.col("vector"))).alias("position", "x"))
    mean = F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(F.sum("x") / F.count("*")).cast("int")))
    return q.groupBy("country", "position").agg(mean.alias("mean"))


def _mix(weight: int):
    def run(spark, d):
        q = W.vectors(spark, d).select("location_id", V.quantized(F.col("vector")).alias("v"))
        other = q.select((F.col("location_id") - 1).alias("location_id"), F.col("v").alias("t"))
        return q.join(other, "location_id").select("location_id", F.array_join(V.mixed(F.col("v"), F.col("t"), weight).cast("array<string>"), ",").alias("mixed"))

    name = f"mix_embeddings_{weight}"
    QUERIES[name] = run
    SQL[name] = f"""WITH {W.VECTORS}, {_Q} SELECT a.location_id, array_to_string(list_transform(list_zip(a.v, b.v), lambda p: CAST(trunc((p[1] * {100 - weight} + p[2] * {weight}) / CAST(100 AS DOUBLE)) AS INTEGER)), ',') AS mixed
    FROM q a JOIN q b ON b.location_id = a.location_id + 1"""


for _w in (25, 50, 75):
    _mix(_w)


#: Bytes in DuckDB: Latin-1 characters can't be hashed as single bytes, so the vectors' bytes are taken modulo 128 here.
_DIGEST = "list_transform(vector, lambda x: CAST(round(abs(x) * 127) AS INTEGER) % 128)"


@query(
    "output_digest",
    f"""WITH {W.VECTORS}, q AS (SELECT location_id, pano_id, {_DIGEST} AS v FROM vectors)
    SELECT location_id, sha256('{W.SCENE_MODEL}' || chr(10) || pano_id || chr(10) || '2019-06' || chr(10) || 'scene' || chr(10) || 'm' || chr(10) || array_to_string(list_transform(v, lambda x: chr(x)), '')) AS digest FROM q""",
)
def output_digest(spark, d):
    """Model, asset, capture, lane and model with a line feed each, then the vector's bytes."""
    v = F.transform("vector", lambda x: F.pmod(F.round(F.abs(x) * 127, 0).cast("int"), F.lit(128)))
    q = W.vectors(spark, d).select("location_id", "pano_id", V.as_bytes(v).alias("bytes"))
    return q.select("location_id", V.output_digest(F.lit(W.SCENE_MODEL), F.col("pano_id"), F.lit("2019-06"), F.lit("scene"), F.lit("m"), F.col("bytes")).alias("digest"))


@query("signed_bytes", "SELECT p_partkey, CASE WHEN p_size * 5 % 256 > 127 THEN p_size * 5 % 256 - 256 ELSE p_size * 5 % 256 END AS signed FROM part")
def signed_bytes(spark, d):
    return W.table(spark, d, "part").select("p_partkey", V.signed(F.col("p_size") * 5 % 256).alias("signed"))


@query("score_rounding", f"WITH {W.VECTORS} SELECT location_id, round({_cos(W.QUERY, 'vector')}, 7) AS map_score, round({_cos(W.QUERY, 'vector')}, 6) AS hit_score FROM vectors")
def score_rounding(spark, d):
    s = V.cosine(W.query_vector(spark, d), F.col("vector"))
    return W.vectors(spark, d).select("location_id", F.round(s, 7).alias("map_score"), F.round(s, 6).alias("hit_score"))
