"""Queries on leases and submissions, files for other programs, checks of names and numbers, and the search's options."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tessera.functions import checks as K
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.constants import CONFIDENCE_FLOORS, SCENE_FLOORS, SEARCH_COST, UNITS
from tessera.functions.geo import rounded
from tessera.operators import bundles as B
from tessera.operators import catalog as C
from tessera.operators import exports as E
from tessera.operators import leases as L
from tessera.operators import ranking as R
from tessera.operators.control import published_mismatch
from tessera.operators.filters import overfetch, similarity_floor, without_road_names
from tessera.operators.spatial import excluded_points
from tessera.operators.tables import new_path
from tessera.plans import scoring as S
from tessera.plans import views as W
from tessera.plans.catalog import _LINES, _lines

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# names and numbers


@query(
    "weight_snapping",
    """WITH v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey % 130 WHEN 3 THEN c_custkey % 130 WHEN 4 THEN -(c_custkey % 130) ELSE 50 END AS n FROM customer)
    SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 100 WHEN c_custkey % 11 = 0 THEN 0 WHEN n <= 12 THEN 0 WHEN n <= 37 THEN 25 WHEN n <= 62 THEN 50 WHEN n <= 87 THEN 75 ELSE 100 END AS INTEGER) AS weight FROM v""",
)
def weight_snapping(spark, d):
    k = F.col("c_custkey")
    n = (k % 130).cast("string")
    value = F.when(k % 5 == 0, n).when(k % 5 == 1, "x").when(k % 5 == 3, F.concat(n, F.lit(".9"))).when(k % 5 == 4, F.concat(F.lit("-"), n))
    return W.table(spark, d, "customer").select("c_custkey", X.snapped_weight(value, k % 7 != 0, k % 11 != 0).alias("weight"))


@query("near_tolerance", "SELECT p_partkey, p_partkey % 5 < 2 AS near FROM part")
def near_tolerance(spark, d):
    x, k = F.col("p_retailprice"), F.col("p_partkey") % 5
    other = F.when(k == 0, x.cast("string")).when(k == 1, (x + 0.000005).cast("string")).when(k == 2, (x + 0.001).cast("string")).when(k == 3, "NaN").otherwise("odd")
    return W.table(spark, d, "part").select("p_partkey", K.near(x, other).alias("near"))


_KEYS = ("a/b.bin", "../x", "/abs", "a/../b", "a..b/c", "")
_FILES = ("x-1.bin", ".x.bin", "x y.bin", "x.txt", "é.bin", "a_b.bin")


@query(
    "path_safety",
    f"""WITH p AS (SELECT p_partkey, {list(_KEYS)}[p_partkey % 6 + 1] AS k, {list(_FILES)}[p_partkey % 6 + 1] AS f FROM part)
    SELECT p_partkey, k <> '' AND NOT starts_with(k, '/') AND NOT list_contains(string_split(k, '/'), '..') AS key_is_safe, f IN ('x-1.bin', 'é.bin') AS file_is_safe FROM p""",
)
def path_safety(spark, d):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return W.table(spark, d, "part").select("p_partkey", K.safe_key(pick(_KEYS)).alias("key_is_safe"), K.safe_file(pick(_FILES)).alias("file_is_safe"))


@query("class_file_names", "SELECT p_partkey, printf('class-%02d-', p_partkey % 91) || replace(lower(p_type), ' ', '-') || '.bin' AS file FROM part")
def class_file_names(spark, d):
    return W.table(spark, d, "part").select("p_partkey", K.class_file("class", F.col("p_partkey") % 91, F.lower("p_type")).alias("file"))


_LEASE = "CASE o_orderkey % 5 WHEN 0 THEN upper(md5(CAST(o_orderkey AS VARCHAR))) WHEN 1 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 2) ELSE md5(CAST(o_orderkey AS VARCHAR)) END"


@query("source_names", f"SELECT o_orderkey, CASE WHEN regexp_full_match({_LEASE}, '[0-9a-f]{{32}}') THEN 'source-' || ({_LEASE}) END AS source FROM orders")
def source_names(spark, d):
    key = F.md5(F.col("o_orderkey").cast("string"))
    lease = F.when(F.col("o_orderkey") % 5 == 0, F.upper(key)).when(F.col("o_orderkey") % 5 == 1, F.substring(key, 2, 31)).otherwise(key)
    return W.table(spark, d, "orders").select("o_orderkey", K.source_name(lease, "source-").alias("source"))


@query("global_start_limits", "SELECT o_orderkey, CASE WHEN o_orderkey % 70000 BETWEEN 1 AND 65536 AND o_orderkey % 4 <> 0 THEN 4294967296 + CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 9) AS BIGINT) * 65536 END AS start FROM orders")
def global_start_limits(spark, d):
    k = F.col("o_orderkey")
    lease = F.when(k % 4 == 0, "not a lease").otherwise(F.md5(k.cast("string")))
    return W.table(spark, d, "orders").select("o_orderkey", X.global_start(lease, k % 70000).alias("start"))


@query(
    "exclude_keys",
    """WITH p AS (SELECT s_nationkey, s_suppkey AS k FROM supplier)
    SELECT s_nationkey, ':exclude:' || substr(sha256('[' || string_agg('{"lat":' || (k % 90) || '.5,"lng":-' || (k % 180) || '.25,"panoId":"p' || k || '"}', ',' ORDER BY k) || ']'), 1, 16) AS key FROM p GROUP BY s_nationkey""",
)
def exclude_keys(spark, d):
    k = F.col("s_suppkey")
    points = W.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), (k % 90 + 0.5).alias("lat"), (-(k % 180) - 0.25).alias("lng"), F.concat(F.lit("p"), k.cast("string")).alias("panoId")))).alias("points"))
    return points.select("s_nationkey", K.exclude_key(F.col("points")).alias("key"))


@query("tie_rounding", "SELECT p_partkey, round_even(CAST(p_partkey % 4096 AS DOUBLE) / 128, 6) AS hit_score, round(CAST(p_partkey % 4096 AS DOUBLE) / 256, 7) AS map_score FROM part")
def tie_rounding(spark, d):
    x = (F.col("p_partkey") % 4096).cast("double")
    return W.table(spark, d, "part").select("p_partkey", K.rounded_hit(x / 128).alias("hit_score"), K.rounded_map(x / 256).alias("map_score"))


@query("number_format_16g", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE printf('%.16g', s_acctbal / CAST(7 AS DOUBLE)) END AS text FROM supplier")
def number_format_16g(spark, d):
    value = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("double")).otherwise(F.col("s_acctbal") / 7)
    return W.table(spark, d, "supplier").select("s_suppkey", X.number_16g(value).alias("text"))


#: The folding in SQL, by the rule that gives it: letters whose folding is one other letter, those that fold to several, and white space.
_LETTERS = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i)]
_SINGLE = [c for c in _LETTERS if len(c.casefold()) == 1]
_SPACES = "".join(f"\\x{{{i:X}}}" for i in range(0x110000) if chr(i).isspace())


def _folded_sql(text: str) -> str:
    out = f"translate({text}, '{string.ascii_uppercase}{''.join(_SINGLE)}', '{string.ascii_lowercase}{''.join(c.casefold() for c in _SINGLE)}')"
    for c in _LETTERS:
        if len(c.casefold()) > 1:
            out = f"replace({out}, '{c}', '{c.casefold()}')"
    return f"trim(regexp_replace({out}, '[{_SPACES}]+', ' ', 'g'))"


#: Letters that fold unlike lower case, beside each text.
_ODD = " ςΣ ﬁ ŉ ẞß İ ǰ ᾳ Ⓐ\u2003K "


@query("folded_text", f"SELECT doc_id, sha256({_folded_sql(f"coalesce(text, '') || '{_ODD}' || doc_id")}) AS folded_sha256 FROM documents")
def folded_text(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.sha2(X.folded(F.concat(F.coalesce("text", F.lit("")), F.lit(_ODD), F.col("doc_id").cast("string"))), 256).alias("folded_sha256"))


@query("prompt_limits", r"SELECT doc_id, turn_problem FROM (SELECT doc_id, CASE WHEN length(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+', ' ', 'g'))) > 400 THEN 'invalid_query' END AS turn_problem FROM documents)")
def prompt_limits(spark, d):
    return W.table(spark, d, "documents").select("doc_id", X.prompt_problem(F.col("text")).alias("turn_problem"))


def _record_sql(n: str) -> str:
    """A twelve-byte record as hexadecimal digits: the id and its CRC-32 bit by bit, both little-endian."""
    x = f"CASE WHEN i % 8 = 0 THEN xor(s, ({n} >> i) & 255) ELSE s END"
    crc = f"xor(list_reduce(range(0, 64), lambda s, i: xor(({x}) >> 1, CASE WHEN (({x}) & 1) = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295)"
    little = lambda v, size: f"array_to_string(list_transform(range(0, {size}), lambda j: printf('%02X', ({v} >> (8 * j)) & 255)), '')"
    return f"{little(n, 8)} || {little(crc, 4)}"


_IDS = "SELECT c_custkey, c_custkey + 4294967296 AS n FROM customer"


@query("restamp_records", f"WITH i AS ({_IDS}) SELECT c_custkey, {_record_sql('(n + 500000)')} AS record FROM i")
def restamp_records(spark, d):
    records = W.table(spark, d, "customer").select("c_custkey", B.global_id_record(F.col("c_custkey") + 2**32).alias("record"))
    return B.restamped_records(records, 2**32, 2**32 + 500_000).withColumn("record", F.hex("record"))


# the queue


_OWN = f"model = '{W.SCENE_MODEL}'"


@query(
    "lease_items",
    f"""WITH {W.LOCATIONS}, {W.LEASES} SELECT lease_id, location_id, asset_id, capture, lane, model, '' AS label, 0 AS generation, heading, pitch, zoom, country, camera_generation, asset_id AS pano_id,
    CASE WHEN {_OWN} AND NOT starts_with(asset_id, 'Prototype') THEN 'street' WHEN {_OWN} THEN 'drawn' END AS view_strategy FROM leases JOIN locations USING (location_id)""",
)
def lease_items(spark, d):
    return L.lease_items(W.locations(spark, d), W.leases(spark, d), W.SCENE_MODEL).drop("lat", "lon", "attribution")


_HELD = "held AS (SELECT *, CASE WHEN location_id % 4 > 0 THEN location_id * 2 END AS active_lease FROM locations)"


def _release_sql(skip: bool) -> str:
    back = "state = 'leased' AND active_lease IN (SELECT lease_id FROM leases WHERE state <> 'submitted')"
    aside = f"CASE WHEN {back} THEN 'skipped' ELSE queue_state END" if skip else "queue_state"
    return f"""WITH {W.LOCATIONS}, {W.LEASES}, {_HELD} SELECT location_id, CASE WHEN {back} THEN 'pending' ELSE state END AS state, CASE WHEN {back} THEN NULL ELSE active_lease END AS active_lease,
        CASE WHEN {back} THEN NULL ELSE lease_until END AS lease_until, {aside} AS queue_state FROM held"""


def _release(name: str, skip: bool):
    def run(spark, d):
        loc = W.locations(spark, d).withColumn("active_lease", F.when(F.col("location_id") % 4 > 0, F.col("location_id") * 2))
        return L.released(loc, W.leases(spark, d), skip).select("location_id", "state", "active_lease", "lease_until", "queue_state")

    QUERIES[name], SQL[name] = run, _release_sql(skip)


_release("lease_release", False)
_release("lease_skip", True)


@query(
    "cursor_swap",
    f"""WITH {W.SHARDS}, b AS (SELECT shard_id, next_row, next_row * 10 AS next_byte FROM shards),
    c AS (SELECT shard_id * 3 + j AS claim_id, shard_id, CASE WHEN (shard_id + j) % 3 = 0 THEN next_byte + 1 ELSE next_byte END AS start, shard_id % 50 + j AS used, shard_id % 7 + j AS rows FROM b, range(0, 3) t(j)),
    w AS (SELECT DISTINCT ON (shard_id) c.* FROM c JOIN b USING (shard_id) WHERE c.start = b.next_byte ORDER BY shard_id, claim_id)
    SELECT shard_id, next_byte + coalesce(used, 0) AS next_byte, next_row + coalesce(rows, 0) AS next_row, claim_id AS won_by FROM b LEFT JOIN w USING (shard_id)""",
)
def cursor_swap(spark, d):
    shards = W.shards(spark, d).select("shard_id", "next_row", (F.col("next_row") * 10).alias("next_byte"))
    k, j = F.col("shard_id"), F.col("j")
    claims = shards.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((k * 3 + j).alias("claim_id"), "shard_id", F.when((k + j) % 3 == 0, F.col("next_byte") + 1).otherwise(F.col("next_byte")).alias("start"), (k % 50 + j).alias("used"), (k % 7 + j).alias("rows"))
    return L.advanced(shards, claims)


_SUBMIT = f"""items AS (SELECT lease_id, (lease_id * 3 + j) % 211 AS location_id FROM leases, range(0, 3) t(j)),
loc AS (SELECT location_id, max(lease_id) AS active_lease, CASE WHEN location_id % 5 = 0 THEN 'published' ELSE 'leased' END AS state, CASE WHEN location_id % 7 < 4 THEN 'scene' ELSE 'object' END AS lane FROM items GROUP BY location_id),
given AS (SELECT lease_id, CASE WHEN lease_id % 9 = 0 THEN -1 ELSE account_id END AS account_id, CASE WHEN lease_id % 4 = 2 AND j = 1 THEN 999999 ELSE (lease_id * 3 + j) % 211 END AS location_id
    FROM leases, range(0, 3) t(j) WHERE NOT (lease_id % 4 = 1 AND j = 2)),
g AS (SELECT g.lease_id, g.account_id, count_if(i.location_id IS NULL) AS surplus, count(i.location_id) AS matched, bool_and(coalesce(l.active_lease = g.lease_id AND l.state = 'leased', false)) AS held,
    CAST(sum(CASE WHEN l.lane = 'object' THEN {UNITS['object']} ELSE {UNITS['scene']} END) AS BIGINT) AS units FROM (SELECT DISTINCT * FROM given) g LEFT JOIN (SELECT DISTINCT * FROM items) i ON i.lease_id = g.lease_id AND i.location_id = g.location_id
    LEFT JOIN loc l ON l.location_id = g.location_id GROUP BY ALL),
o AS (SELECT g.*, CASE WHEN e.account_id <> g.account_id THEN 'unknown_lease' WHEN e.state = 'submitted' THEN 'replayed' WHEN e.state <> 'active' OR e.expires_at <= 300000 THEN 'expired'
    WHEN surplus > 0 OR matched <> 3 THEN 'incomplete' WHEN NOT held THEN 'fenced' ELSE 'accepted' END AS outcome FROM g JOIN leases e ON e.lease_id = g.lease_id)"""


@query("submission_outcomes", f"WITH {W.LEASES}, {_SUBMIT} SELECT lease_id, account_id, outcome, CASE WHEN outcome = 'accepted' THEN units ELSE 0 END AS units FROM o")
def submission_outcomes(spark, d):
    leases, k = W.leases(spark, d), F.col("lease_id")
    each = leases.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("at", (k * 3 + F.col("j")) % 211)
    items = each.select("lease_id", F.col("at").alias("location_id"))
    at = F.col("location_id")
    loc = items.groupBy("location_id").agg(F.max("lease_id").alias("active_lease")).withColumn("state", F.when(at % 5 == 0, "published").otherwise("leased")).withColumn("lane", F.when(at % 7 < 4, "scene").otherwise("object"))
    given = each.where(~((k % 4 == 1) & (F.col("j") == 2))).select("lease_id", F.when(k % 9 == 0, -1).otherwise(F.col("account_id")).alias("account_id"), F.when((k % 4 == 2) & (F.col("j") == 1), 999_999).otherwise(F.col("at")).alias("location_id"))
    return L.submission_outcomes(given.union(given.where(at % 2 == 0)), leases, items, loc, 300_000)


@query(
    "search_authorization",
    f"""WITH a AS (SELECT DISTINCT user_id AS account_id, user_id % 7 * {SEARCH_COST} AS have FROM events WHERE user_id % 13 <> 0),
    r AS (SELECT event_id AS request_id, user_id AS account_id, event_type || (event_id % 3) AS key, event_id % 2 AS query FROM events),
    f AS (SELECT account_id, key, min(request_id) AS first_id, arg_min(query, request_id) AS first_query FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY first_id) AS n FROM f),
    o AS (SELECT request_id, r.account_id, first_id, CASE WHEN have IS NULL THEN 'unauthorized' WHEN n * {SEARCH_COST} > have THEN 'insufficient_credit' WHEN request_id = first_id THEN 'debited' WHEN query = first_query THEN 'stored' ELSE 'idempotency_conflict' END AS outcome
        FROM r JOIN n USING (account_id, key) LEFT JOIN a USING (account_id))
    SELECT request_id, account_id, outcome, CASE WHEN outcome IN ('debited', 'stored') THEN first_id END AS search_id, CASE WHEN outcome = 'debited' THEN {-SEARCH_COST} ELSE 0 END AS units FROM o""",
)
def search_authorization(spark, d):
    """Searches asked for under a key that repeats: each key is paid once, as long as the account's units last."""
    e = W.table(spark, d, "events")
    requests = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("account_id"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("key"), (F.col("event_id") % 2).alias("query"))
    accounts = e.where("user_id % 13 <> 0").select(F.col("user_id").alias("account_id"), (F.col("user_id") % 7 * SEARCH_COST).alias("units")).distinct()
    return L.debits(requests, accounts).select("request_id", "account_id", "outcome", "search_id", "units")


@query(
    "current_parts",
    f"""WITH {W.SHARDS}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN starts_with(key, 'catalog/all-locations-tail') THEN 0 WHEN starts_with(key, 'catalog/all-locations-full') THEN 1 WHEN starts_with(key, 'catalog/vision-indexed') THEN 2 ELSE 3 END, shard_id) AS INTEGER) AS part, count(*) OVER (PARTITION BY lane) AS parts FROM shards)
    SELECT DISTINCT ON (lane, assignee) lane, assignee, shard_id, part, parts, 'Batch ' || part || ' of ' || parts AS label, row_count - next_row AS rows_left FROM p WHERE assignee IS NOT NULL AND next_row < row_count ORDER BY lane, assignee, part""",
)
def current_parts(spark, d):
    return L.current_parts(W.shards(spark, d))


@query("lanes_with_work", f"WITH {W.SHARDS} SELECT DISTINCT lane FROM shards WHERE next_row < row_count AND lane <> 'scene'")
def lanes_with_work(spark, d):
    return L.lanes_with_work(W.shards(spark, d).withColumn("next_row", F.when(F.col("lane") == "scene", F.col("row_count")).otherwise(F.col("next_row"))))


@query("lane_replace", f"WITH {W.SHARDS} SELECT shard_id, lane, row_count FROM shards WHERE lane <> 'scene' UNION ALL SELECT shard_id + 1000000, 'scene', 7 FROM shards WHERE shard_id % 3 = 0")
def lane_replace(spark, d):
    rows = W.shards(spark, d).select("shard_id", "lane", "row_count")
    fresh = rows.where("shard_id % 3 = 0").select((F.col("shard_id") + 1_000_000).alias("shard_id"), F.lit("scene").alias("lane"), F.lit(7).cast("long").alias("row_count"))
    return C.replaced_lane(rows, fresh, "scene")


@query("backup_audit", f"WITH {W.LOCATIONS} SELECT 'locations' AS name, count(*) AS n FROM locations UNION ALL SELECT 'published', count_if(state = 'published') FROM locations")
def backup_audit(spark, d):
    """A backup of two tables that agree; the audit of its copies finds nothing."""
    loc = W.locations(spark, d).withColumn("output_sha256", F.sha2("asset_id", 256))
    published = loc.where("state = 'published'").select("location_id", "output_sha256")
    counts = E.backed_up({"locations": loc, "published": published}, new_path(spark, "backup"), {"published rows": lambda t: published_mismatch(t["locations"], t["published"])})
    return spark.createDataFrame(list(counts.items()), "name string, n long")


# files


@query("shard_files", f"WITH {_LINES} SELECT i // 300 AS shard_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY i)) AS sha256 FROM lines GROUP BY i // 300")
def shard_files(spark, d):
    return E.write_line_shards(_lines(spark, d), new_path(spark, "line-shards"), 300)


_QUEUE = """q AS (SELECT lane, location_id, 'm' || chr(9) || row_number() OVER (PARTITION BY lane ORDER BY location_id) || chr(9) || CAST(round(lat, 3) AS VARCHAR) || chr(9) || CAST(round(lon, 3) AS VARCHAR) || chr(9) || CAST(heading AS VARCHAR) || chr(9) || CAST(pitch AS VARCHAR)
    || chr(9) || CAST(zoom AS VARCHAR) || chr(9) || asset_id || chr(9) || country || chr(9) || camera_generation || chr(9) || 'no road name' AS line, row_number() OVER (PARTITION BY lane ORDER BY location_id) - 1 AS row_index FROM locations)"""


def _queue(spark, d):
    return W.locations(spark, d).withColumn("lat", rounded(F.col("lat"), 3)).withColumn("lon", rounded(F.col("lon"), 3))


@query("queue_lines", f"WITH {W.LOCATIONS}, {_QUEUE} SELECT row_index, line FROM q WHERE lane = 'scene'")
def queue_lines(spark, d):
    return E.queue_lines(_queue(spark, d).where("lane = 'scene'"), "m")


@query("handoff_manifest", f"WITH {W.LOCATIONS}, {_QUEUE} SELECT lane, row_index // 400 AS shard_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY row_index)) AS sha256 FROM q GROUP BY ALL")
def handoff_manifest(spark, d):
    return E.handoff(_queue(spark, d), new_path(spark, "handoff"), "m", 400)


@query(
    "byte_slice",
    f"""WITH {_LINES}, s AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines),
    f AS (SELECT max(start + strlen(line) + 1) AS cursor FROM (SELECT * FROM s WHERE start + strlen(line) + 1 <= 10240 ORDER BY i LIMIT 40))
    SELECT i AS row_index, line, start, start + strlen(line) + 1 AS stop FROM s, f WHERE start >= cursor AND start + strlen(line) + 1 <= cursor + 15360 ORDER BY i LIMIT 60""",
)
def byte_slice(spark, d):
    lines = _lines(spark, d).select("row_index", "line")
    cursor = E.next_slice(lines, 0, 40).agg(F.max("stop")).first()[0]
    return E.next_slice(lines, cursor, 60)


def _record(key, scales=("0038",) * 4):
    return F.unhex(F.concat(*[F.concat(F.lit(s) if isinstance(s, str) else s, F.repeat(F.sha2(F.concat(key.cast("string"), F.lit(f"-{v}")), 256), 24)) for v, s in enumerate(scales)]))


_RECORD = " || ".join(f"'0038' || repeat(sha256(vec_id || '-{v}'), 24)" for v in range(4))


@query("four_view_records", f"SELECT vec_id AS row_index, sha256(upper({_RECORD})) AS record_sha256 FROM embeddings WHERE vec_id % 50 = 7")
def four_view_records(spark, d):
    """Records written as shards and mask files, then some of them read by place."""
    path, k = new_path(spark, "four-view"), F.col("vec_id")
    rows = W.table(spark, d, "embeddings").select(k.alias("row_index"), _record(k).alias("record"))
    E.write_four_view_shards(rows, path, 100).agg(F.sum("records")).collect()
    return E.records_at(rows.where("row_index % 50 = 7"), path, 100).select("row_index", F.sha2(F.hex("record"), 256).alias("record_sha256"))


@query("view_masks", "SELECT DISTINCT vec_id // 100 AS shard, 'incomplete' AS problem FROM embeddings WHERE vec_id % 211 = 3")
def view_masks(spark, d):
    path, k = new_path(spark, "masks"), F.col("vec_id")
    dark = F.when(k % 211 == 3, "0080").otherwise("0038")
    rows = W.table(spark, d, "embeddings").select(k.alias("row_index"), _record(k, ("0038", dark, "0038", "0038")).alias("record"))
    E.write_four_view_shards(rows, path, 100).agg(F.sum("records")).collect()
    return E.mask_problems(spark, path)


@query(
    "four_view_difference",
    """SELECT count_if(vec_id % 7 = 0 OR vec_id % 11 = 0) AS locations, count_if(vec_id % 7 = 0) + count_if(vec_id % 11 = 0) - count_if(vec_id % 77 = 0 AND vec_id % 4 = (vec_id + 1) % 4) AS views, count_if(vec_id % 11 = 0) AS scales,
    count_if(vec_id % 7 = 0) + count_if(vec_id % 11 = 0) AS bytes FROM embeddings""",
)
def four_view_difference(spark, d):
    """Records against copies with one byte changed in a vector of every seventh, one in a scale of every eleventh."""
    from tessera.sources.records import byte_difference

    k = F.col("vec_id")
    rows = W.table(spark, d, "embeddings").select(k, F.hex(_record(k)).alias("h"))

    def flipped(h, at):
        return F.concat(F.substr(h, F.lit(1), at), F.when(F.substr(h, at + 1, F.lit(1)) == "A", "B").otherwise("A"), F.substr(h, at + 2))

    view = lambda v: (v % 4).cast("int") * 1540
    changed = rows.withColumn("h", F.when(k % 7 == 0, flipped(F.col("h"), view(k) + 100)).otherwise(F.col("h"))).withColumn("h", F.when(k % 11 == 0, flipped(F.col("h"), view(k + 1))).otherwise(F.col("h")))
    both = [x.select(k.alias("row_index"), F.unhex("h").alias("record")) for x in (rows, changed)]
    return byte_difference(*both)


_DEVIATE = ("panorama", "coordinates", "global id", "columns")


@query(
    "bundle_lines",
    f"""WITH i AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_partkey % 23 AS k FROM part)
    SELECT i AS row_index, CASE WHEN k < 4 THEN {list(_DEVIATE)}[k + 1] WHEN k = 4 THEN 'missing line' END AS problem FROM i WHERE k < 5
    UNION ALL SELECT count(*), 'surplus line' FROM i""",
)
def bundle_lines(spark, d):
    k = F.col("p_partkey") % 23
    items = C.indexed(W.table(spark, d, "part").select("p_partkey", F.concat(F.lit("pano-"), F.col("p_partkey").cast("string")).alias("asset_id"), (F.col("p_partkey") % 90 + 0.25).alias("lat"), F.lit(1.5).alias("lon")), "p_partkey")
    cells = [F.lit("m"), F.lit("1"), (F.col("lat") + F.when(k == 1, 0.01).otherwise(0.000001)).cast("string"), F.col("lon").cast("string"), *[F.lit("0")] * 3, F.when(k == 0, "other").otherwise(F.col("asset_id")), F.lit("X"), F.lit("gen4"), F.lit("no road name"), (F.col("row_index") + 5000 + F.when(k == 2, 1).otherwise(0)).cast("string")]
    line = F.concat_ws("\t", *cells)
    lines = items.where(k != 4).select("row_index", F.when(k == 3, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("line"))
    extra = items.agg((F.max("row_index") + 1).alias("row_index")).select("row_index", F.lit("m").alias("line"))
    return E.bundle_line_problems(lines.union(extra), items, 5000)


@query("canary_check", f"WITH {_LINES} SELECT i // 9 AS place, CASE WHEN i % 2 = 0 THEN 'changed' ELSE 'missing' END AS problem FROM lines WHERE i % 9 = 0 AND (i % 4 = 0 OR i % 5 = 0) AND (i % 2 = 0 OR i % 5 = 0)")
def canary_check(spark, d):
    rows = _lines(spark, d).select("row_index", "line")
    i = F.col("row_index")
    chosen = rows.where(i % 9 == 0).withColumn("place", F.floor(i / 9))
    broken = F.when((i % 2 == 0) & ((i % 4 == 0) | (i % 5 == 0)), F.concat("line", F.lit("!"))).otherwise(F.col("line"))
    canary = chosen.where(~((i % 2 == 1) & (i % 5 == 0))).select("place", broken.alias("line"))
    return B.canary_problems(rows, canary, chosen.select("place", "row_index"))


@query("file_sink", "SELECT 'page-' || page_id || '.bin' AS name, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
def file_sink(spark, d):
    """Files written from rows, listed from their bytes."""
    files = W.table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".bin")).alias("name"), F.encode("html", "utf-8").alias("content"))
    return E.write_files(files, new_path(spark, "files"))


@query("synthetic_import", "WITH a AS (SELECT p_partkey AS k, 'synthetic:' || (p_partkey % 97) AS asset_id FROM part), old AS (SELECT asset_id, min(k) AS position FROM a WHERE k % 3 = 0 GROUP BY ALL), new AS (SELECT asset_id, min(k) AS position FROM a WHERE k % 2 = 0 GROUP BY ALL) SELECT * FROM old UNION ALL SELECT * FROM new WHERE asset_id NOT IN (SELECT asset_id FROM old)")
def synthetic_import(spark, d):
    k = F.col("p_partkey")
    rows = W.table(spark, d, "part").select(F.concat(F.lit("synthetic:"), (k % 97).cast("string")).alias("asset_id"), F.lit("c").alias("capture"), F.lit("scene").alias("lane"), F.lit("m").alias("model"), k.alias("position"))
    return C.synthetic_import(C.first_wins(rows.where("position % 3 = 0")), rows.where("position % 2 = 0"), request=F.floor(F.col("position") / 100_000)).select("asset_id", "position")


_PATHS = "CASE s_suppkey % 5 WHEN 0 THEN 'job' || s_suppkey || '/index/manifest.json' WHEN 1 THEN 'job' || s_suppkey || '/manifest.json' WHEN 2 THEN 'a/b' || s_suppkey || '/index/manifest.json' WHEN 3 THEN 'job' || s_suppkey || '/index/shard.i8' ELSE 'index/manifest.json' END"


@query("scene_index_discovery", "SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'job' || s_suppkey ELSE '' END AS folder FROM supplier WHERE s_suppkey % 5 IN (0, 4)")
def scene_index_discovery(spark, d):
    return E.scene_indexes(W.table(spark, d, "supplier").select(F.expr(_PATHS).alias("path")))


@query(
    "object_index_discovery",
    """SELECT CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'obj' || s_suppkey ELSE 'index' END ELSE 'src' || s_suppkey END AS source, 'obj' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '/index' END AS folder,
    s_suppkey * 100 AS start, s_suppkey * 100 + s_suppkey % 4 AS stop FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 > 0 AND s_suppkey % 7 <> 0""",
)
def object_index_discovery(spark, d):
    k = F.col("s_suppkey")
    rows = W.table(spark, d, "supplier")
    manifest = F.to_json(F.struct((k % 3 != 0).alias("completed"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("src"), k.cast("string"))).alias("sourceId"), (k * 100).alias("globalStart"), (k % 4).alias("indexedLocations")))
    manifests = rows.select(F.concat(F.lit("obj"), k.cast("string"), F.when(k % 2 == 0, "/manifest.json").otherwise("/index/manifest.json")).alias("path"), F.encode(manifest, "utf-8").alias("content"))
    lines = rows.where(k % 7 != 0).select(F.concat(F.lit("obj"), k.cast("string"), F.lit("/locations.tsv")).alias("path"), F.lit(None).cast("binary").alias("content"))
    return E.object_indexes(manifests.union(lines))


_FOLDER = "CASE WHEN s_suppkey % 6 = 0 THEN 'plain' ELSE md5(CAST(s_suppkey AS VARCHAR)) END"


@query("listed_files", f"SELECT 'objects/' || {_FOLDER} || '/' AS folder, 'objects/' || {_FOLDER} || '/class-01.bin' AS key, s_suppkey * 1000003 % 60000000 AS bytes FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey * 1000003 % 60000000 <= 33554432")
def listed_files(spark, d):
    k = F.col("s_suppkey")
    folder = F.when(k % 6 == 0, "plain").otherwise(F.md5(k.cast("string")))
    files = W.table(spark, d, "supplier").select(F.concat(folder, F.when(k % 4 == 0, "/a b.bin").otherwise("/class-01.bin")).alias("path"), (k * 1_000_003 % 60_000_000).alias("bytes"))
    return E.listed_files(files, "objects/")


@query("sealed_remainder", "SELECT s_suppkey * 31 % 500 AS start, s_suppkey * 31 % 500 + 60 AS stop, 'p' || s_suppkey AS path FROM supplier WHERE s_suppkey * 31 % 500 + 60 <= 300")
def sealed_remainder(spark, d):
    k = F.col("s_suppkey")
    rows = W.table(spark, d, "supplier").select((k * 31 % 500).alias("start"), (k * 31 % 500 + 60).alias("stop"), F.concat(F.lit("p"), k.cast("string")).alias("path"))
    return E.sealed_remainder(rows, 300)


@query("whole_blobs", "SELECT 'blobs/' || md5(CAST(s_suppkey AS VARCHAR)) || '.i8' AS key FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 > 0")
def whole_blobs(spark, d):
    k = F.col("s_suppkey")
    rows = W.table(spark, d, "supplier").select(F.concat(F.lit("blobs/"), F.md5(k.cast("string")), F.lit(".i8")).alias("key"), (k % 5 * 3080 + (k % 3 == 0).cast("int")).alias("bytes"), (k % 5).alias("locations"))
    return E.whole_blobs(rows).select("key")


@query("line_capabilities", "SELECT s_suppkey, CAST(9 + s_suppkey % 4 AS INTEGER) AS columns, s_suppkey % 4 >= 1 AS camera_verified, s_suppkey % 4 < 2 AS road_names_absent FROM supplier")
def line_capabilities(spark, d):
    line = F.concat(F.lit("a"), F.repeat(F.lit("\t"), (8 + F.col("s_suppkey") % 4).cast("int")))
    return W.table(spark, d, "supplier").select("s_suppkey", E.line_capabilities(line).alias("c")).select("s_suppkey", "c.*")


@query("nested_hits", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'q' ELSE '' END AS name, s_suppkey AS index, CAST(0.5 AS DOUBLE) AS score, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 ELSE 0 END AS INTEGER) AS offset FROM supplier")
def nested_hits(spark, d):
    k = F.col("s_suppkey").cast("string")
    nested = F.concat(F.lit('{"queries":[{"name":"q","hits":[{"locationIndex":'), k, F.lit(',"similarity":0.5,"viewOffset":'), (F.col("s_suppkey") % 4).cast("string"), F.lit("}]}]}"))
    bare = F.concat(F.lit('{"hits":[{"locationIndex":'), k, F.lit(',"score":0.5}]}'))
    return E.nested_hits(W.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, nested).otherwise(bare).alias("value")))


_ASSET = "CASE k % 3 WHEN 0 THEN 'synthetic:' || k WHEN 1 THEN 'wikimedia:' || k ELSE 'x maps.googleapis.com ' || k END"


@query(
    "licensed_records",
    f"""WITH s AS (SELECT s_suppkey AS k, ['synthetic', 'wikimedia', 'google', 'other'][s_suppkey % 4 + 1] AS source FROM supplier), a AS (SELECT *, {_ASSET} AS asset_id FROM s)
    SELECT asset_id, CASE WHEN source = 'google' THEN 'google_source_forbidden' WHEN source = 'other' THEN 'unknown_source' WHEN k % 3 = 2 THEN 'google_source_forbidden' WHEN NOT starts_with(asset_id, source || ':') THEN source || '_prefix_required' END AS problem,
    CASE WHEN k % 2 = 0 THEN CAST(1.5 AS DOUBLE) ELSE round(CAST('0x' || substr(sha256(asset_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) * 140 - 70, 6) END AS lat FROM a""",
)
def licensed_records(spark, d):
    from tessera.sources.catalogs import PERMITS
    from tessera.sources.catalogs import licensed_records as gated

    k = F.col("s_suppkey")
    source = F.element_at(F.array(*map(F.lit, ("synthetic", "wikimedia", "google", "other"))), (k % 4 + 1).cast("int"))
    asset = F.concat(F.when(k % 3 == 0, "synthetic:").when(k % 3 == 1, "wikimedia:").otherwise("x maps.googleapis.com "), k.cast("string"))
    grant = F.struct(F.lit("synthetic-test-data").alias("rights"), source.alias("source"), F.array(*map(F.lit, PERMITS)).alias("permits"), F.lit(True).alias("written_evidence"), F.lit("by someone").alias("attribution"))
    rows = W.table(spark, d, "supplier").select(source.alias("source"), asset.alias("asset_id"), grant.alias("grant"), F.when(k % 2 == 0, 1.5).alias("lat"), F.when(k % 2 == 0, 2.5).alias("lon"))
    return gated(rows).select("asset_id", "problem", "lat")


# the search's options


@query("embedded_count", "SELECT count(embedding) AS n FROM (SELECT CASE WHEN vec_id % 3 > 0 THEN embedding END AS embedding FROM embeddings)")
def embedded_count(spark, d):
    rows = W.table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).alias("embedding"))
    return rows.agg(F.count("embedding").alias("n"))


@query("road_name_reject", "SELECT p_partkey FROM part WHERE p_size * 7 % 256 & 8 = 0")
def road_name_reject(spark, d):
    rows = W.table(spark, d, "part").select("p_partkey", C.decoded_flags(F.col("p_size") * 7 % 256)["road_name_state"].alias("road_name_state"))
    return without_road_names(rows).select("p_partkey")


def _floors(name: str, floors: dict, lane: str):
    cases = " UNION ALL ".join(f"SELECT '{k}' AS setting, count_if(score >= CAST({v} AS DOUBLE)) AS n FROM s" for k, v in floors.items())

    def run(spark, d):
        hits = R.scored(W.vectors(spark, d), W.query_vector(spark, d), lane).select("score")
        kept = [F.count_if(F.col("score") >= similarity_floor(lane, **({"weight": k} if lane == "scene" else {"confidence": k}))).alias(str(k)) for k in floors]
        return hits.agg(*kept).select(F.inline(F.array(*[F.struct(F.lit(str(k)).alias("setting"), F.col(f"`{k}`").alias("n")) for k in floors])))

    every = f"list_max([{S._VIEW}]).s" if lane == "scene" else "list_max([" + ", ".join(S._cos(f"{W.QUERY}[1:8]", f"vector[{8 * r + 1}:{8 * r + 8}]") for r in range(8)) + "])"
    QUERIES[name], SQL[name] = run, f"WITH {W.VECTORS}, s AS (SELECT {every} AS score FROM vectors) {cases}"


_floors("scene_floors", SCENE_FLOORS, "scene")
_floors("object_floors", CONFIDENCE_FLOORS, "object")


@query("hits_by_source", f"WITH {W.VECTORS}, h AS (SELECT location_id, round({S._cos(W.QUERY, 'vector')}, 1) AS score, CASE WHEN location_id % 5 > 0 THEN location_id * 37 % 101 END AS source_index FROM vectors) SELECT location_id, score, CAST(row_number() OVER (ORDER BY score DESC, coalesce(source_index, 0), location_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 40")
def hits_by_source(spark, d):
    hits = W.vectors(spark, d).select("location_id", F.round(V.cosine(W.query_vector(spark, d), F.col("vector")), 1).alias("score"), F.when(F.col("location_id") % 5 > 0, F.col("location_id") * 37 % 101).alias("source_index"))
    return R.by_source(hits, 40).select("location_id", "score", "rank")


@query("exclude_cap", f"WITH {W.VECTORS}, {W.USED} SELECT position FROM used WHERE position % 3 <> 0 ORDER BY position LIMIT 6")
def exclude_cap(spark, d):
    """Points without numeric coordinates take no place in the list of the first used points."""
    used = W.used(spark, d).withColumn("lat", F.when(F.col("position") % 3 != 0, F.col("lat")))
    return excluded_points(used, 6).select("position")


_OPTIONS = (
    S._SEARCH.replace("country NOT IN ('country 3')", "country NOT IN ('country 3') AND location_id % 4 <> 0").replace("FROM scored ORDER BY top_rank", f"FROM scored WHERE b.s >= CAST({CONFIDENCE_FLOORS['precise']} AS DOUBLE) ORDER BY top_rank")
    .replace(f"LIMIT {overfetch(30, 5)}", f"LIMIT {overfetch(30, 30, True)}").replace("WHERE n <= 5", "WHERE n <= 30")
)


def _optional(spark, d):
    index = W.vectors(spark, d).withColumn("road_name_state", F.when(F.col("location_id") % 4 == 0, "has road name").otherwise("no road name"))
    return R.ranked_search(index, W.query_vector(spark, d), count=30, per_country=30, filters=S._FILTERS, used=W.used(spark, d), floor=similarity_floor("object", confidence="precise"), reject_road_names=True, overfetch_excluding=True)


@query("ranked_search_options", f"{_OPTIONS} SELECT location_id, CAST(place AS INTEGER) AS rank, round(b.s, 6) AS score FROM final")
def ranked_search_options(spark, d):
    return _optional(spark, d).select("location_id", "rank", F.round("score", 6).alias("score"))


@query(
    "result_extra",
    f"""{_OPTIONS}, low AS (SELECT min(b.s) AS low FROM final) SELECT pano_id, country AS tag, camera_generation AS camera, round(b.s, 5) AS score, round(low, 5) AS min_score, CAST(place AS INTEGER) AS rank, 'barn' AS query, 'scene' AS mode, CAST(90 * b.o AS INTEGER) AS heading_offset,
    CAST(77 AS BIGINT) AS processed, CAST(100 AS DOUBLE) AS prune_m, true AS object_fields_are_null FROM final, low""",
)
def result_extra(spark, d):
    doc = R.result_document(_optional(spark, d), "barn", "scene", "m", 77, "x")
    extra = ", ".join(f"x{n}: {kind}" for n, kind in zip(R.EXTRA, ("string", "double", "double", "int", "string", "string", "int", "int", "bigint", "string", "double", "string", "int", "string", "double", "int", "double"), strict=True))
    points = doc.select(F.explode(F.from_json("document", f"customCoordinates array<struct<panoId: string, extra: struct<tags: array<string>, {extra}>>>")["customCoordinates"]).alias("p")).select("p.panoId", "p.extra.*")
    empty = F.coalesce(*[F.col(f"x{n}").cast("string") for n in R.EXTRA if n.startswith("Object")]).isNull()
    return points.select(
        F.col("panoId").alias("pano_id"), F.get("tags", F.lit(0)).alias("tag"), F.col("xCameraGeneration").alias("camera"), F.round("xScore", 5).alias("score"), F.round("xMinScore", 5).alias("min_score"), F.col("xRank").alias("rank"), F.col("xQuery").alias("query"),
        F.col("xQueryMode").alias("mode"), F.col("xHeadingOffset").alias("heading_offset"), F.col("xProcessedLocations").alias("processed"), F.col("xPruneMeters").alias("prune_m"), empty.alias("object_fields_are_null"),
    )


_EXTRA_SQL = {
    "CameraGeneration": "CASE WHEN coalesce(camera_generation, '') = '' THEN 'unknown' ELSE camera_generation END", "Score": "round(b.s, 7)", "MinScore": "round(low, 7)", "Rank": "CAST(place AS INTEGER)", "Query": "'barn'", "QueryMode": "'scene'",
    "HeadingOffset": "CAST(90 * b.o AS INTEGER)", "SourceIndex": "0", "ProcessedLocations": "77", "Model": "'m'", "PruneMeters": "CAST(100 AS DOUBLE)",
}
_EXTRA_JSON = ", ".join(f"'{k}': {v}" for k, v in sorted(({"tags": "[country]"} | {f"x{n}": _EXTRA_SQL.get(n, "NULL") for n in R.EXTRA}).items()))


@query(
    "map_document",
    f"""{_OPTIONS}, low AS (SELECT min(b.s) AS low FROM final)
    SELECT CAST(to_json({{'customCoordinates': list({{'extra': {{{_EXTRA_JSON}}}, 'heading': (heading + 90 * b.o) % 360, 'lat': round(lat, 3), 'lng': round(lon, 3), 'panoId': pano_id, 'pitch': CAST(0 AS DOUBLE), 'zoom': CAST(0 AS DOUBLE)}} ORDER BY place), 'name': 'barn'}}) AS VARCHAR) AS document, count(*) AS n FROM final, low""",
)
def map_document(spark, d):
    """The whole document of a result, byte by byte, with its keys in order."""
    hits = _optional(spark, d).withColumn("lat", F.round("lat", 3)).withColumn("lon", F.round("lon", 3)).drop("pitch", "zoom")
    return R.result_document(hits, "barn", "scene", "m", 77, "x")
