"""Queries on catalogues: identity, spatial and format rules, sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.constants import GENERATIONS, INVENTED
from tessera.operators import catalog as C
from tessera.plans import views as W

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _jobs(spark, d):
    """Catalogue rows with repeated identities: one per line item."""
    li = W.table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("pano-"), (F.col("l_partkey") % 500).cast("string")).alias("asset_id"), F.date_format("l_shipdate", "yyyy").alias("capture"), F.lit("scene").alias("lane"), F.lit(W.SCENE_MODEL).alias("model"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )


_JOBS = f"jobs AS (SELECT 'pano-' || (l_partkey % 500) AS asset_id, strftime(l_shipdate, '%Y') AS capture, 'scene' AS lane, '{W.SCENE_MODEL}' AS model, l_orderkey * 10 + l_linenumber AS position FROM lineitem)"


@query("catalog_dedup_first_wins", f"WITH {_JOBS} SELECT asset_id, capture, min(position) AS position FROM jobs GROUP BY ALL")
def catalog_dedup_first_wins(spark, d):
    return C.first_wins(_jobs(spark, d)).select("asset_id", "capture", "position")


@query(
    "catalog_upsert",
    f"WITH {_JOBS}, old AS (SELECT asset_id, capture, min(position) AS position FROM jobs WHERE capture < '1996' GROUP BY ALL), new AS (SELECT asset_id, capture, min(position) AS position FROM jobs GROUP BY ALL)"
    " SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.asset_id = new.asset_id AND old.capture = new.capture)",
)
def catalog_upsert(spark, d):
    jobs = _jobs(spark, d)
    return C.upsert(C.first_wins(jobs.where("capture < '1996'")), jobs).select("asset_id", "capture", "position")


@query("job_id_sha", f"WITH {W.LOCATIONS} SELECT location_id, sha256(asset_id || chr(10) || capture || chr(10) || lane || chr(10) || model) AS job_id FROM locations")
def job_id_sha(spark, d):
    return W.locations(spark, d).select("location_id", X.job_id(*map(F.col, ("asset_id", "capture", "lane", "model"))).alias("job_id"))


@query(
    "capture_string",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' ' ELSE strftime(o_orderdate, '%Y') END AS y, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(month(o_orderdate) AS VARCHAR) END AS m FROM orders)
    SELECT o_orderkey, CASE WHEN coalesce(trim(y), '') <> '' AND m <> '' THEN trim(y) || '-' || CASE WHEN length(m) < 2 THEN '0' || m ELSE m END WHEN coalesce(trim(y), '') <> '' THEN y ELSE 'unknown' END AS capture FROM c""",
)
def capture_string(spark, d):
    k = F.col("o_orderkey")
    year = F.when(k % 7 == 0, None).when(k % 11 == 0, " ").otherwise(F.date_format("o_orderdate", "yyyy"))
    month = F.when(k % 5 == 0, "").otherwise(F.month("o_orderdate").cast("string"))
    return W.table(spark, d, "orders").select("o_orderkey", X.capture(year, month).alias("capture"))


_FLAGS = "CAST(p_size * 7 % 256 AS INTEGER)"
_CAMERA = f"{[*GENERATIONS, 'unknown', 'unknown']}[({_FLAGS} & 7) + 1]"


@query("decode_camera_flags", f"SELECT p_partkey, {_CAMERA} AS camera_generation, CASE WHEN ({_FLAGS} & 8) > 0 THEN 'has road name' ELSE 'no road name' END AS road_name_state FROM part")
def decode_camera_flags(spark, d):
    return W.table(spark, d, "part").select("p_partkey", C.decoded_flags(F.col("p_size") * 7 % 256).alias("f")).select("p_partkey", "f.*")


@query("badcam_override", f"SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) THEN 'badcam' ELSE {_CAMERA} END AS camera_generation FROM part")
def badcam_override(spark, d):
    rows = W.table(spark, d, "part").select(F.col("p_partkey").alias("location_id"), C.decoded_flags(F.col("p_size") * 7 % 256)["camera_generation"].alias("camera_generation"))
    bad = W.table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("location_id"))
    return C.with_bad_cameras(rows, bad).withColumnRenamed("location_id", "p_partkey")


@query("bitset_lookup", "SELECT p_partkey, (ascii(substr('KqZ7!', CAST(p_size // 8 + 1 AS BIGINT), 1)) >> (p_size % 8)) & 1 = 1 AND p_size // 8 < 5 AS is_set FROM part")
def bitset_lookup(spark, d):
    return W.table(spark, d, "part").select("p_partkey", C.bit_is_set(F.lit(b"KqZ7!"), F.col("p_size")).alias("is_set"))


@query(
    "country_from_tags",
    """WITH t AS (SELECT o_custkey AS location_id, list(CAST(o_orderkey % 40 AS INTEGER) ORDER BY o_orderkey) AS tags FROM orders GROUP BY o_custkey),
    n AS (SELECT location_id, list_filter(list_transform(tags, lambda x: CASE WHEN x < 25 AND x % 6 <> 0 THEN 'NATION_' || x ELSE '' END), lambda x: x <> '') AS names FROM t)
    SELECT location_id, coalesce(names[1], '') AS country FROM n""",
)
def country_from_tags(spark, d):
    tags = W.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("location_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 40).cast("int").alias("tag")))).alias("t"))
    names = W.table(spark, d, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("tag"), F.col("n_name").alias("name"))
    return C.with_first_tag(tags.select("location_id", F.col("t.tag").alias("tags")), names)


@query(
    "normalize_9_or_11_cols",
    """WITH l AS (SELECT c_custkey, 'm' || chr(9) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END || chr(9) || '1.5' || chr(9) || '2.5' || chr(9) || '0' || chr(9) || '0' || chr(9) || '0' || chr(9) || 'pano' || c_custkey || chr(9) || 'X'
        || CASE WHEN c_custkey % 3 = 0 THEN chr(9) || 'gen4' || chr(9) || 'no road name' WHEN c_custkey % 3 = 1 THEN chr(9) || 'odd' ELSE '' END AS line FROM customer),
    s AS (SELECT string_split(line, chr(9)) AS c FROM l)
    SELECT coalesce(nullif(c[2], ''), c[1]) AS location_id, c[8] AS pano_id, coalesce(c[10], '') AS camera_generation, coalesce(c[11], '') AS road_name_state FROM s WHERE len(c) IN (9, 11)""",
)
def normalize_9_or_11_cols(spark, d):
    from tessera.sources.text_lines import normal_lines

    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, F.lit("\tgen4\tno road name")).when(k % 3 == 1, F.lit("\todd")).otherwise("")
    line = F.concat(F.lit("m\t"), F.when(k % 4 == 0, "").otherwise(k.cast("string")), F.lit("\t1.5\t2.5\t0\t0\t0\tpano"), k.cast("string"), F.lit("\tX"), tail)
    out = normal_lines(W.table(spark, d, "customer").select(line.alias("value")))
    return out.select("location_id", "pano_id", "camera_generation", "road_name_state")


_LINES = "lines AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name || chr(9) || p_brand AS line, 'p' || p_partkey AS pano FROM part)"


def _lines(spark, d):
    rows = W.table(spark, d, "part").select("p_partkey", F.concat_ws("\t", "p_name", "p_brand").alias("line"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pano_id"))
    return C.indexed(rows, "p_partkey")


@query(
    "shard_split_manifest",
    f"""WITH {_LINES} SELECT i // 300 AS shard_id, count(*) AS rows, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, min(i) AS row_start, arg_min(pano, i) AS first_pano, arg_max(pano, i) AS last_pano,
    sha256(string_agg(sha256(line), '' ORDER BY i)) AS sha256 FROM lines GROUP BY i // 300""",
)
def shard_split_manifest(spark, d):
    return C.shard_manifest(_lines(spark, d), 300)


@query("tail_window", f"WITH {_LINES} SELECT i AS row_index, pano AS pano_id FROM lines, (SELECT count(*) AS n FROM lines) WHERE i >= n - 120 AND i < n - 20")
def tail_window(spark, d):
    return C.window_of_tail(_lines(spark, d), 120, 20).select("row_index", "pano_id")


@query("positional_join", f"WITH {_LINES}, o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus FROM orders) SELECT pano AS pano_id, o_orderstatus FROM lines JOIN o USING (i)")
def positional_join(spark, d):
    other = C.indexed(W.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("row_index", "o_orderstatus")
    return _lines(spark, d).join(other, "row_index").select("pano_id", "o_orderstatus")


@query("street_pano_filter", f"WITH {W.LOCATIONS} SELECT location_id, asset_id FROM locations WHERE NOT (asset_id = '' OR asset_id LIKE 'http%' OR {' OR '.join(f'starts_with(asset_id, {p!r})' for p in INVENTED)})")
def street_pano_filter(spark, d):
    return W.locations(spark, d).where(X.is_street_pano(F.col("asset_id"))).select("location_id", "asset_id")


@query("canonical_country", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'USA' WHEN 2 THEN 'France' ELSE '' END AS country FROM customer")
def canonical_country(spark, d):
    raw = F.element_at(F.array(F.lit(" United States"), F.lit("United States of America "), F.lit(" France "), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return W.table(spark, d, "customer").select("c_custkey", X.canonical_country(raw).alias("country"))


@query(
    "metadata_validation",
    f"""WITH {W.LOCATIONS}, p AS (SELECT location_id, CASE location_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'http://maps' WHEN 2 THEN repeat('x', 81) ELSE asset_id END AS pano FROM locations)
    SELECT location_id, CASE WHEN length(pano) NOT BETWEEN 4 AND 80 THEN 'invalid_pano_id' WHEN pano LIKE 'http%' THEN 'imagery_url_forbidden' END AS problem FROM p""",
)
def metadata_validation(spark, d):
    from tessera.sources.catalogs import problem

    k = F.col("location_id")
    pano = F.when(k % 5 == 0, "abc").when(k % 5 == 1, "http://maps").when(k % 5 == 2, F.repeat(F.lit("x"), 81)).otherwise(F.col("asset_id"))
    return W.locations(spark, d).select("location_id", problem(pano).alias("problem"))


@query("global_start", "SELECT o_orderkey, 4294967296 + CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 9) AS BIGINT) * 65536 AS start FROM orders")
def global_start(spark, d):
    return W.table(spark, d, "orders").select("o_orderkey", X.global_start(F.md5(F.col("o_orderkey").cast("string"))).alias("start"))


@query(
    "import_cutoff",
    "WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 31 % 500 + 10 AS BIGINT) AS n FROM supplier), c AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s) SELECT s_suppkey, n, start FROM c WHERE start >= 2000",
)
def import_cutoff(spark, d):
    rows = W.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 31 % 500 + 10).alias("n"))
    return C.running_start(rows, "n", "s_suppkey").where("start >= 2000")


@query(
    "range_overlap",
    """WITH RECURSIVE r AS (SELECT s_suppkey AS id, s_suppkey * 97 % 5000 AS start, s_suppkey * 97 % 5000 + 60 AS stop FROM supplier),
    official AS (SELECT * FROM r WHERE id % 10 = 0), o AS (SELECT *, row_number() OVER (ORDER BY start, id) AS n FROM r WHERE id % 10 <> 0),
    w(n, taken, got) AS (SELECT CAST(0 AS BIGINT), (SELECT list({'a': start, 'b': stop}) FROM official), CAST([] AS BIGINT[])
        UNION ALL SELECT o.n, CASE WHEN len(list_filter(taken, lambda t: o.start < t.b AND o.stop > t.a)) = 0 THEN list_append(taken, {'a': o.start, 'b': o.stop}) ELSE taken END,
            CASE WHEN len(list_filter(taken, lambda t: o.start < t.b AND o.stop > t.a)) = 0 THEN list_append(got, o.id) ELSE got END FROM w JOIN o ON o.n = w.n + 1)
    SELECT id, start, stop FROM o WHERE id IN (SELECT unnest(got) FROM w WHERE n = (SELECT max(n) FROM w))""",
)
def range_overlap(spark, d):
    k = F.col("s_suppkey")
    rows = W.table(spark, d, "supplier").select(k.alias("id"), (k * 97 % 5000).alias("start"), (k * 97 % 5000 + 60).alias("stop"))
    return C.disjoint_ranges(rows.where("id % 10 = 0"), rows.where("id % 10 <> 0"))


@query("map_batches", f"WITH {W.LOCATIONS}, n AS (SELECT location_id, row_number() OVER (ORDER BY location_id) - 1 AS i FROM locations) SELECT i // 80 AS batch, count(*) AS n, min(location_id) AS first FROM n GROUP BY i // 80")
def map_batches(spark, d):
    rows = C.indexed(W.locations(spark, d).select("location_id"), "location_id")
    return rows.groupBy(F.floor(F.col("row_index") / 80).alias("batch")).agg(F.count("*").alias("n"), F.min("location_id").alias("first"))


@query("storage_cost", "SELECT s_suppkey, round(greatest(CAST(0 AS DOUBLE), s_acctbal / CAST(100 AS DOUBLE) - 10) * CAST(0.015 AS DOUBLE), 4) AS cost FROM supplier")
def storage_cost(spark, d):
    return W.table(spark, d, "supplier").select("s_suppkey", F.round(F.greatest(F.lit(0.0), F.col("s_acctbal") / 100 - 10) * 0.015, 4).alias("cost"))


@query(
    "rights_gate",
    """WITH s AS (SELECT s_suppkey AS k, ['synthetic', 'wikimedia', 'google', 'other'][s_suppkey % 4 + 1] AS source FROM supplier)
    SELECT k AS s_suppkey, CASE source WHEN 'google' THEN 'google_source_forbidden' WHEN 'other' THEN 'unknown_source' WHEN 'synthetic' THEN CASE WHEN k % 3 = 0 THEN 'synthetic_rights_marker_missing' END
        ELSE CASE WHEN k % 5 = 1 THEN 'rights_source_mismatch' WHEN k % 3 = 1 THEN 'rights_incomplete' WHEN k % 7 = 0 THEN 'written_rights_evidence_required' END END AS problem FROM s""",
)
def rights_gate(spark, d):
    from tessera.sources.catalogs import PERMITS, rights_problem

    k = F.col("s_suppkey")
    source = F.element_at(F.array(*map(F.lit, ("synthetic", "wikimedia", "google", "other"))), (k % 4 + 1).cast("int"))
    permits = F.array(*map(F.lit, PERMITS))
    grant = F.struct(
        F.when(k % 3 != 0, "synthetic-test-data").alias("rights"), F.when(k % 5 != 1, "wikimedia").otherwise("x").alias("source"),
        F.when(k % 3 == 1, F.slice(permits, 1, 4)).otherwise(permits).alias("permits"), (k % 7 != 0).alias("written_evidence"), F.lit("by someone").alias("attribution"),
    )
    return W.table(spark, d, "supplier").select("s_suppkey", rights_problem(source, grant).alias("problem"))


@query("import_idempotence", "SELECT sha256(text) AS sha256, min('f' || doc_id) AS name FROM documents GROUP BY 1 HAVING bool_and(doc_id % 3 <> 0)")
def import_idempotence(spark, d):
    from tessera.sources.catalogs import unseen_files

    files = W.table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.col("doc_id"))
    return unseen_files(files.select("sha256", "name"), files.where("doc_id % 3 = 0").select("sha256").distinct())


@query("median_throughput", "SELECT event_type, round(median(value), 6) AS median_value, count(*) AS n FROM events GROUP BY event_type")
def median_throughput(spark, d):
    return W.table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.count("*").alias("n"))


@query("reservation_check", f"WITH {W.SHARDS}, t AS (SELECT lane, max(next_row) AS cursor FROM shards GROUP BY lane) SELECT shard_id, row_count - 50 >= cursor AS reserved FROM shards JOIN t USING (lane)")
def reservation_check(spark, d):
    """Whether a shard's last fifty rows start after the local cursor of its lane."""
    shards = W.shards(spark, d)
    cursor = shards.groupBy("lane").agg(F.max("next_row").alias("cursor"))
    return shards.join(cursor, "lane").select("shard_id", (F.col("row_count") - 50 >= F.col("cursor")).alias("reserved"))
