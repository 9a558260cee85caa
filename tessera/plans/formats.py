"""Queries on record files, extraction and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions.text import job_id, thumbnail_query
from tessera.operators import bundles as B
from tessera.operators.tables import new_path, spread, stored
from tessera.plans import views as W
from tessera.sources import records as S
from tessera.streaming import queue as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _key():
    return F.concat_ws("\n", "asset_id", "capture", "lane", "model")


#: The faces in SQL: a row per asset and pixel, from a 64-bit xorshift in unsigned numbers whose high bits are cut before each shift.
_SHIFTED = "xor(xor({0}, ({0} & 2251799813685247) << 13), xor({0}, ({0} & 2251799813685247) << 13) >> 7)"
_STEP = f"xor({_SHIFTED.format('s')}, ({_SHIFTED.format('s')} & 140737488355327) << 17)"
_PIXELS = f"""k AS (SELECT location_id, sha256(asset_id || chr(10) || capture || chr(10) || lane || chr(10) || model) AS h FROM locations WHERE %s),
seed AS (SELECT location_id, greatest(CAST('0x' || array_to_string(list_transform(range(8), lambda j: substr(h, 15 - 2 * j, 2)), '') AS UBIGINT), CAST(1 AS UBIGINT)) AS s FROM k),
walk(location_id, i, s, bias) AS (SELECT location_id, CAST(0 AS UBIGINT), s, CAST(0 AS UBIGINT) FROM seed UNION ALL
    SELECT location_id, i + 1, {_STEP}, CASE WHEN i % 256 = 0 THEN (s >> (i // 256)) & 255 ELSE bias END FROM walk WHERE i < 1536),
placed AS (SELECT location_id, CAST(i - 1 AS BIGINT) AS i, s, CAST(bias AS BIGINT) AS bias, CAST((i - 1) // 256 AS BIGINT) AS f, CAST((i - 1) // 16 % 16 AS BIGINT) AS y, CAST((i - 1) % 16 AS BIGINT) AS x FROM walk WHERE i > 0),
px AS (SELECT location_id, i, f, y, x, (CAST(s & 255 AS BIGINT) + bias + 13 * x + (x - 7) * (x - 7) + (y - 7) * (y - 7)) % 256 AS r, (CAST(s >> 8 & 255 AS BIGINT) + 17 * y + 41 * f) % 256 AS g,
    (CAST(s >> 16 & 255 AS BIGINT) + x * y + 3 * bias) % 256 AS b FROM placed)"""
_BYTE = "printf('%02X', (greatest(-127, least(127, {0})) + 256) % 256)"


def _pixels(where: str) -> str:
    return f"WITH RECURSIVE {W.LOCATIONS}, {_PIXELS.replace('WHERE %s', f'WHERE {where}')}"


def _bytes_sql(*values: str) -> str:
    return " || ".join(_BYTE.format(v) for v in values)


@query("render_faces_digest", f"{_pixels('true')} SELECT location_id, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY i))) AS faces_sha256 FROM px GROUP BY location_id")
def render_faces_digest(spark, d):
    return W.locations(spark, d).select("location_id", F.sha2(X.faces_of(_key()), 256).alias("faces_sha256"))


_SCENE = f"""{_pixels("lane = 'scene'")}, e AS (SELECT *, CASE WHEN x % 8 > 0 THEN abs(r - lag(r) OVER (PARTITION BY location_id, f, y ORDER BY x)) ELSE 0 END AS dx FROM px),
q AS (SELECT location_id, f, y // 8 AS qy, x // 8 AS qx, CAST(sum(r) AS BIGINT) // 64 - 128 AS r, CAST(sum(g) AS BIGINT) // 64 - 128 AS g, CAST(sum(b) AS BIGINT) // 64 - 128 AS b, CAST(sum(dx) AS BIGINT) // 56 - 128 AS dx FROM e GROUP BY ALL)"""


@query("scene_embedding", f"{_SCENE} SELECT location_id, string_agg({_bytes_sql('r', 'g', 'b', 'dx')}, '' ORDER BY f, qy, qx) AS embedding FROM q GROUP BY location_id")
def scene_embedding(spark, d):
    rows = W.locations(spark, d).where("lane = 'scene'")
    return rows.select("location_id", F.hex(X.vector_of(_key(), F.col("lane"))).alias("embedding"))


@query(
    "object_embedding",
    f"""{_pixels("lane = 'object'")}, e AS (SELECT *, (r + g + b) // 3 AS gray, CASE WHEN x % 4 > 0 THEN abs(r - lag(r) OVER (PARTITION BY location_id, y ORDER BY x)) ELSE 0 END AS dx,
        CASE WHEN y % 4 > 0 THEN abs(r - lag(r) OVER (PARTITION BY location_id, x ORDER BY y)) ELSE 0 END AS dy FROM px WHERE f = 0),
    q AS (SELECT location_id, y // 4 AS qy, x // 4 AS qx, CAST(sum(r) AS BIGINT) // 16 - 128 AS r, CAST(sum(g) AS BIGINT) // 16 - 128 AS g, CAST(sum(b) AS BIGINT) // 16 - 128 AS b, (min(gray) + max(gray)) * 8 // 16 - 128 AS mid, max(gray) - min(gray) - 128 AS span,
        CAST(sum(dx) AS BIGINT) // 12 - 128 AS dx, CAST(sum(dy) AS BIGINT) // 12 - 128 AS dy FROM e GROUP BY ALL)
    SELECT location_id, string_agg({_bytes_sql('r', 'g', 'b', 'mid', 'span', 'dx', 'dy', '(qx + 4 * qy) * 8 - 60')}, '' ORDER BY qy, qx) AS embedding FROM q GROUP BY location_id""",
)
def object_embedding(spark, d):
    rows = W.locations(spark, d).where("lane = 'object'")
    return rows.select("location_id", F.hex(X.vector_of(_key(), F.col("lane"))).alias("embedding"))


def _poses(spark, d, lane):
    rows = W.locations(spark, d).where(F.col("lane") == lane)
    return rows.select("location_id", "lat", F.col("lon").alias("lng"), "heading", "pitch", "zoom", F.col("asset_id").alias("pano_id"), "capture", "country", "camera_generation", F.unhex(F.concat(*[F.sha2("asset_id", 256)] * 3)).alias("embedding"))


@query("sealed_segments", f"WITH {W.LOCATIONS} SELECT location_id, lat, lon AS lng, heading, asset_id AS pano_id, capture, country, camera_generation, lane, upper(sha256(asset_id) || sha256(asset_id) || sha256(asset_id)) AS embedding FROM locations WHERE lane = 'scene'")
def sealed_segments(spark, d):
    root = new_path(spark, "segments")
    S.publish_segments(_poses(spark, d, "scene"), root, "scene", 96)
    S.publish_segments(_poses(spark, d, "object"), root, "object", 96)
    out = spark.read.format("sealed_segments").option("path", root).option("lane", "scene").option("pushdown", "false").load()
    return out.select("location_id", "lat", "lng", "heading", "pano_id", "capture", "country", "camera_generation", "lane", F.hex("embedding").alias("embedding"))


@query("checksum_audit", f"WITH {W.LOCATIONS}, {W.PUBLISHED} SELECT location_id, output_sha256 = sha256('out' || location_id) AS fits FROM published")
def checksum_audit(spark, d):
    """The digests of the published outputs, computed anew."""
    return W.published(spark, d).select("location_id", (F.sha2(F.concat(F.lit("out"), F.col("location_id").cast("string")), 256) == F.col("output_sha256")).alias("fits"))


@query("ledger_dedup_stream", f"WITH {W.LEDGER} SELECT account_id, units, reference FROM ledger")
def ledger_dedup_stream(spark, d):
    """Every booking comes twice, in a second stream of the same events."""
    events = T.event_stream(spark, f"{d}/events*.parquet").unionByName(T.event_stream(spark, f"{d}/events*.parquet"))
    return T.drained(T.credited_once(events), "credits").select("account_id", "units", "reference")


@query(
    "lease_state_stream",
    """WITH v AS (SELECT user_id, list({'what': event_type, 'state': 'none', 'generation': CAST(0 AS BIGINT), 'units': CAST(0 AS BIGINT), 'until': epoch(ts)} ORDER BY ts, event_id) AS steps FROM events GROUP BY user_id),
    r AS (SELECT user_id, list_reduce(steps, lambda s, e: CASE
        WHEN e.what = 'view' AND NOT (s.state = 'active' AND s.until > e.until) THEN {'what': '', 'state': 'active', 'generation': s.generation + 1, 'units': s.units, 'until': e.until + 1800}
        WHEN e.what = 'error' AND s.state = 'active' AND s.until > e.until THEN {'what': '', 'state': 'released', 'generation': s.generation, 'units': s.units, 'until': s.until}
        WHEN e.what = 'signup' AND s.state IN ('active', 'expired') THEN {'what': '', 'state': 'active', 'generation': s.generation, 'units': s.units, 'until': e.until + 1800}
        WHEN e.what = 'purchase' AND s.state = 'active' AND s.until > e.until THEN {'what': '', 'state': 'submitted', 'generation': s.generation, 'units': s.units + 1, 'until': s.until}
        WHEN s.state = 'active' AND s.until <= e.until THEN {'what': '', 'state': 'expired', 'generation': s.generation, 'units': s.units, 'until': s.until}
        ELSE s END, {'what': '', 'state': 'none', 'generation': CAST(0 AS BIGINT), 'units': CAST(0 AS BIGINT), 'until': CAST(0 AS DOUBLE)}) AS s FROM v)
    SELECT user_id, s.state AS state, s.generation AS generation, s.units AS units, round(s.until, 3) AS until FROM r""",
)
def lease_state_stream(spark, d):
    out = T.drained(T.lease_states(T.event_stream(spark, f"{d}/events*.parquet")), "leases", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("state", "generation", "units", "until"), "_batch").alias("s"))
    return last.select("user_id", "s.state", "s.generation", "s.units", F.round("s.until", 3).alias("until"))


@query("daily_counts_stream", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, CAST(sum(CAST(trunc(value * CAST(100 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def daily_counts_stream(spark, d):
    out = T.drained(T.daily_counts(T.event_stream(spark, f"{d}/events*.parquet")), "days", "update")
    return out.groupBy("day", "event_type").agg(F.max_by("n", "_batch").alias("n"), F.max_by("cents", "_batch").alias("cents"))


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(spark, d):
    return T.sessions(W.table(spark, d, "events"))


@query("restamp_lines", "SELECT c_custkey, 'a' || repeat(chr(9), 11) || (c_custkey + 4294967296) AS value FROM customer")
def restamp_lines(spark, d):
    line = F.concat(F.lit("a" + "\t" * 11), F.col("c_custkey").cast("string"))
    return B.restamped(W.table(spark, d, "customer").select("c_custkey", line.alias("value")), 2**32)


_CRC = "CASE WHEN i % 8 = 0 THEN xor(s, (n >> i) & 255) ELSE s END"


@query(
    "global_id_records",
    f"""WITH i AS (SELECT c_custkey, c_custkey + 4294967296 AS n FROM customer), c AS (SELECT *, xor(list_reduce(range(0, 64), lambda s, i: xor(({_CRC}) >> 1, CASE WHEN (({_CRC}) & 1) = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM i)
    SELECT c_custkey, array_to_string(list_transform(range(0, 8), lambda j: printf('%02X', (n >> (8 * j)) & 255)), '') || array_to_string(list_transform(range(0, 4), lambda j: printf('%02X', (crc >> (8 * j)) & 255)), '') AS record, true AS sound FROM c""",
)
def global_id_records(spark, d):
    record = B.global_id_record(F.col("c_custkey") + 2**32)
    return W.table(spark, d, "customer").select("c_custkey", F.hex(record).alias("record"), B.record_is_sound(record).alias("sound"))


@query(
    "file_audit",
    """WITH p AS (SELECT page_id, strlen(html) AS bytes, page_id % 7 AS k FROM pages)
    SELECT 'f' || page_id AS name, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'not listed' WHEN 2 THEN 'size' WHEN 3 THEN 'digest' END AS problem FROM p WHERE k < 4""",
)
def file_audit(spark, d):
    k = F.col("page_id") % 7
    p = W.table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("name"), F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("sha256"), k.alias("k"))
    listed = p.where("k <> 1").withColumn("bytes", F.col("bytes") + (F.col("k") == 2).cast("int")).withColumn("sha256", F.when(F.col("k") == 3, "x").otherwise(F.col("sha256")))
    return B.file_audit(listed, p.where("k <> 0"))


@query("fixture_checks", f"WITH {W.VECTORS} SELECT count(*) AS rows, count(DISTINCT location_id) AS ids, count(DISTINCT pano_id) AS panos, count_if(camera_generation <> 'gen4') AS odd FROM vectors")
def fixture_checks(spark, d):
    return B.fixture_problems(W.vectors(spark, d))


@query(
    "thumbnail_query",
    f"""WITH {W.LOCATIONS} SELECT location_id, 'cb_client=apiv3&output=thumbnail&panoid=' || asset_id || '&w=256&h=256&yaw=' || CAST(heading AS BIGINT) || '&pitch=' || CAST(-pitch AS BIGINT) || '&thumbfov='
    || CAST(round_even(greatest(CAST(30 AS DOUBLE), least(CAST(120 AS DOUBLE), 2 * degrees(atan(0.75 * power(CAST(2 AS DOUBLE), 1 - zoom))))), 0) AS INTEGER) AS query FROM locations""",
)
def thumbnail_query_(spark, d):
    from tessera.functions.geo import thumbnail_fov

    return W.locations(spark, d).select("location_id", thumbnail_query(F.col("asset_id"), F.col("heading"), F.col("pitch"), thumbnail_fov(F.col("zoom"))).alias("query"))


_SAW = ", ".join(f"list_cosine_similarity(o[1:16], v[{16 * k + 1}:{16 * k + 16}])" for k in range(4))


@query(
    "seal_and_search",
    f"""{_SCENE}, c AS (SELECT location_id, f, qy, qx, list_transform([r, g, b, dx], lambda z: CAST(greatest(-127, least(127, z)) AS DOUBLE)) AS z FROM q), v AS (SELECT location_id, flatten(list(z ORDER BY f, qy, qx)) AS v FROM c GROUP BY location_id),
    o AS (SELECT v AS o FROM v ORDER BY location_id LIMIT 1), t AS (SELECT location_id, list_max([{_SAW}]) AS score FROM v, o) SELECT location_id, round(score, 6) AS score FROM t ORDER BY t.score DESC, location_id LIMIT 25""",
)
def seal_and_search(spark, d):
    """Extract, publish as segments, read back and rank against the first row: a location finds itself first."""
    from tessera.functions import vectors as V

    root = new_path(spark, "sealed")
    rows = spread(W.locations(spark, d).where("lane = 'scene'"), "location_id").withColumn("embedding", X.vector_of(_key(), F.col("lane")))
    S.publish_segments(stored(rows.select("location_id", "lat", F.col("lon").alias("lng"), "heading", "pitch", "zoom", F.col("asset_id").alias("pano_id"), "capture", "country", "camera_generation", "embedding"), "scene-rows"), root, "scene", 96)
    index = spark.read.format("sealed_segments").option("path", root).option("lane", "scene").option("pushdown", "false").load().select("location_id", "embedding")  # read twice
    first = index.agg(F.min_by("embedding", "location_id")).first()[0]
    hits = index.select("location_id", V.best_view_of_bytes(bytes(first or bytes(96)))(F.col("embedding"))["score"].alias("score"))
    return hits.orderBy(F.desc("score"), "location_id").limit(25).withColumn("score", F.round("score", 6))
