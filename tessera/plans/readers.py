"""Queries on readers of maps, tags and lines, on backups, fixtures and options of the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.constants import COUNTRY_ALIASES, INVENTED
from tessera.operators import bundles as B
from tessera.operators import control as Q
from tessera.operators import exports as E
from tessera.operators import ranking as R
from tessera.operators.filters import claimable
from tessera.operators.tables import new_path
from tessera.plans import scoring as S
from tessera.plans import views as W
from tessera.sources import catalogs, maps, text_lines

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# maps: documents of 40 points in three forms, with repeated points, texts for numbers, addresses, and documents without examples


def _map_docs(spark, d, odd_lat: bool):
    """(document, value): map documents; with odd_lat, every ninth latitude is no number."""
    k, doc = F.col("location_id"), F.floor(F.col("location_id") / 40)
    pano = F.when((k % 10 == 3) | (doc % 7 == 6), None).when((doc % 5 == 3) & (k % 40 == 20), F.concat(F.lit("https://x/"), k.cast("string"))).otherwise(F.col("pano_id"))
    lat = F.when(k % 9 == 2, F.lit("x")).otherwise((k * 0.5).cast("string")) if odd_lat else (k * 0.5).cast("string")
    heading = F.when((doc % 5 == 4) & (k % 40 == 30), "north").when(k % 6 == 1, "").otherwise((F.floor(k / 4) * 10).cast("string"))
    point = F.struct(F.when(k % 2 == 0, pano).alias("panoId"), F.when(k % 2 == 1, pano).alias("pano"), lat.alias("lat"), (k * 0.25).alias("lon"), heading.alias("heading"), F.struct(F.when(k % 4 == 0, "2020-01").alias("panoDate"), F.array("country").alias("tags")).alias("extra"))
    points = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), point.alias("p")))), lambda x: x["p"])  # 40 at most
    docs = W.vectors(spark, d).groupBy(doc.alias("document")).agg(points.alias("points"))
    name = F.when(F.col("document") % 2 == 0, F.concat(F.lit("map "), F.col("document").cast("string"))).otherwise(" ")
    first, second, bare = F.to_json(F.struct(name.alias("name"), F.col("points").alias("customCoordinates"))), F.to_json(F.struct(name.alias("name"), F.col("points").alias("locations"))), F.to_json("points")
    return docs.select("document", F.when(F.col("document") % 3 == 0, first).when(F.col("document") % 3 == 1, second).otherwise(bare).alias("value"))


_MAP_ROWS = f"""{W.VECTORS}, m AS (SELECT location_id // 40 AS document, location_id % 40 AS position, location_id AS k, country,
    CASE WHEN location_id % 10 = 3 OR location_id // 40 % 7 = 6 THEN NULL ELSE pano_id END AS pano_id, location_id // 40 % 5 = 3 AND location_id % 40 = 20 AND location_id // 40 % 7 <> 6 AS url,
    location_id // 40 % 5 = 4 AND location_id % 40 = 30 AS odd, CASE WHEN location_id % 6 = 1 THEN 0 ELSE CAST(location_id // 4 * 10 AS DOUBLE) END AS heading,
    CASE WHEN location_id // 40 % 2 = 0 AND location_id // 40 % 3 <> 2 THEN 'map ' || (location_id // 40) ELSE 'Map' END AS name FROM vectors)"""


@query(
    "query_map_examples",
    f"""WITH {_MAP_ROWS}, bad AS (SELECT document, arg_min(CASE WHEN url THEN 'imagery_url_forbidden' ELSE 'invalid_number' END, position) AS bad FROM m WHERE pano_id IS NOT NULL AND (url OR odd) GROUP BY document),
    f AS (SELECT document, pano_id, heading, min(k) AS k FROM m WHERE pano_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT f.*, row_number() OVER (PARTITION BY f.document ORDER BY f.k) - 1 AS i, count(*) OVER (PARTITION BY f.document) AS n FROM f),
    s AS (SELECT document, i, n, unnest(CASE WHEN n <= 12 THEN [i] ELSE [CAST(round_even(j / CAST(11 AS DOUBLE) * (n - 1), 0) AS BIGINT) FOR j IN range(12)] END) AS pick FROM (SELECT DISTINCT document, n, CASE WHEN n <= 12 THEN i ELSE 0 END AS i FROM r)),
    e AS (SELECT r.document, r.k, r.pano_id, r.heading FROM s JOIN r ON r.document = s.document AND r.i = s.pick),
    o AS (SELECT document, name, CASE WHEN bad IS NOT NULL THEN bad WHEN n = 0 THEN 'empty_map' END AS problem FROM (SELECT document, any_value(name) AS name, count(pano_id) AS n FROM m GROUP BY document) LEFT JOIN bad USING (document))
    SELECT o.document, o.name, o.problem, CAST(e.k % 40 AS INTEGER) AS position, e.pano_id, e.k * CAST(0.5 AS DOUBLE) AS lat, e.k * CAST(0.25 AS DOUBLE) AS lng, e.heading, CASE WHEN e.k IS NULL THEN NULL WHEN e.k % 4 = 0 THEN '2020-01' ELSE 'unknown' END AS capture, m.country
    FROM o LEFT JOIN e ON e.document = o.document AND o.problem IS NULL LEFT JOIN m ON m.k = e.k""",
)
def query_map_examples(spark, d):
    """Examples of every map by the strict reader, twelve a map at most; refused maps have a row with their problem."""
    read = maps.query_maps(_map_docs(spark, d, False), limit=12)
    return read.select("document", "name", "problem", F.explode_outer("examples").alias("e")).select("document", "name", "problem", *[F.col(f"e.{c}").alias(c) for c in ("position", "pano_id", "lat", "lng", "heading", "capture", "country")])


@query(
    "exclude_map_points",
    f"""WITH {_MAP_ROWS}, s AS (SELECT *, k % 9 <> 2 AS numeric_lat FROM m), n AS (SELECT *, count_if(numeric_lat AND NOT url) OVER (PARTITION BY document ORDER BY position ROWS UNBOUNDED PRECEDING) AS taken FROM s),
    u AS (SELECT DISTINCT document FROM n WHERE url AND taken < 18)
    SELECT document, CAST(NULL AS VARCHAR) AS problem, CAST(position AS INTEGER) AS position, coalesce(pano_id, '') AS pano_id, k * CAST(0.5 AS DOUBLE) AS lat, k * CAST(0.25 AS DOUBLE) AS lng FROM n WHERE numeric_lat AND NOT url AND taken <= 18 AND document NOT IN (SELECT document FROM u)
    UNION ALL SELECT document, 'imagery_url_forbidden', NULL, NULL, NULL, NULL FROM u""",
)
def exclude_map_points(spark, d):
    """Points that every map leaves out, 18 a map at most; a map with an address before that is refused."""
    read = maps.exclude_maps(_map_docs(spark, d, True), limit=18)
    return read.select("document", "problem", F.explode_outer("points").alias("p")).select("document", "problem", "p.position", "p.pano_id", "p.lat", "p.lng")


@query("tag_names", "SELECT CAST(n_nationkey AS INTEGER) AS tag, n_name AS name FROM nation WHERE n_nationkey % 5 <> 1 AND n_nationkey % 7 <> 3")
def tag_names(spark, d):
    """Names of tags from one JSON document a region; entries without a name text are left out."""
    k = F.col("n_nationkey")
    entry = F.when(k % 5 == 1, F.lit("{}")).when(k % 7 == 3, F.lit('{"name": 7}')).otherwise(F.to_json(F.struct(F.concat(F.lit(" "), "n_name").alias("name"))))
    pairs = F.array_join(F.collect_list(F.concat(F.lit('"'), k.cast("string"), F.lit('":'), entry)), ",")
    docs = W.table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("{"), pairs, F.lit("}")).alias("value"))
    return maps.tag_names(docs)


# lines


@query("headered_scan", f"WITH {W.LOCATIONS} SELECT asset_id, CASE WHEN location_id % 4 = 0 THEN 'unknown' ELSE '2019-06' END AS capture, lane, CASE WHEN location_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE heading END AS heading, pitch, country FROM (SELECT *, asset_id AS a FROM locations) WHERE location_id % 6 <> 5 AND lane = 'scene'")
def headered_scan(spark, d):
    """A headered file written and read back: rows without a panorama are skipped, numbers that are none are 0."""
    k, path = F.col("location_id"), new_path(spark, "headered")
    rows = W.locations(spark, d).where("lane = 'scene'")
    rows.select(
        F.when(k % 6 == 5, " ").otherwise(F.col("asset_id")).alias("pano_id"), F.col("lat").cast("string").alias("lat"), F.when(k % 5 == 0, "bad").otherwise(F.col("heading").cast("string")).alias("heading"), F.col("pitch").cast("string").alias("pitch"),
        "country", F.when(k % 4 == 0, "").otherwise("2019").alias("capture_year"), F.lit("6").alias("capture_month"),
    ).write.csv(path, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return text_lines.read_headered(spark, path, "scene", "m").select("asset_id", "capture", "lane", "heading", "pitch", "country")


@query("line_scan", f"WITH {W.LOCATIONS} SELECT location_id, lat, lon AS lng, heading, asset_id AS pano_id, country, camera_generation, 'no road name' AS road_name_state FROM locations")
def line_scan(spark, d):
    """Lines of eleven columns, written with fifteen digits of a number and read by the strict reader."""
    path = new_path(spark, "lines")
    rows = W.locations(spark, d).select(F.lit("m").alias("map_id"), "location_id", "lat", F.col("lon").alias("lng"), "heading", "pitch", "zoom", F.col("asset_id").alias("pano_id"), "country", "camera_generation", F.lit(None).cast("string").alias("road_name_state"))
    text_lines.write_lines(rows, path)
    return text_lines.strict_lines(spark.read.text(path)).select("location_id", "lat", "lng", "heading", "pano_id", "country", "camera_generation", "road_name_state")


@query("sniffed_scan", f"WITH {W.LOCATIONS} SELECT 'headered' AS form, asset_id, lat FROM locations WHERE lane = 'scene' UNION ALL SELECT 'lines', asset_id, lat FROM locations WHERE lane = 'object'")
def sniffed_scan(spark, d):
    """Two files whose form is told by their first line."""
    loc = W.locations(spark, d)
    headered, lines = new_path(spark, "sniffed"), new_path(spark, "sniffed")
    loc.where("lane = 'scene'").select(F.col("asset_id").alias("pano_id"), F.col("lat").cast("string").alias("lat")).write.csv(headered, sep="\t", header=True, quote="")
    text_lines.write_lines(loc.where("lane = 'object'").select(F.lit("m").alias("map_id"), "location_id", "lat", F.col("lon").alias("lng"), "heading", "pitch", "zoom", F.col("asset_id").alias("pano_id"), "country", "camera_generation", F.lit("x").alias("road_name_state")), lines)
    read = lambda path, form: text_lines.read_any(spark, path, "scene", "m").select(F.lit(form).alias("form"), "asset_id", "lat")
    return read(headered, "headered").unionByName(read(lines, "lines"))


@query("export_documents", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def export_documents(spark, d):
    """Rows of database exports in three forms, one document a customer."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("price"))
    docs = W.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(row).alias("rows"))
    one = F.struct(F.col("rows").alias("results"))
    value = F.when(F.col("o_custkey") % 3 == 0, F.to_json(F.array(one))).when(F.col("o_custkey") % 3 == 1, F.to_json(one)).otherwise(F.to_json("rows"))
    rows = catalogs.export_rows(docs.select(value.alias("value"))).select(F.from_json("row", "id long, price double").alias("r"))
    return rows.select("r.id", "r.price")


# backups and fixtures


def _audits():
    return {"published rows": lambda t: Q.published_mismatch(t["locations"], t["published"])}


def _tables(spark, d):
    loc = W.locations(spark, d).withColumn("output_sha256", F.sha2(F.concat(F.lit("out"), F.col("location_id").cast("string")), 256))
    return {"locations": loc, "published": W.published(spark, d)}


@query("backup_findings", f"""WITH {W.LOCATIONS}, {W.PUBLISHED} SELECT 'published rows' AS audit, count(*) AS findings, true AS refused FROM locations l LEFT JOIN published p USING (location_id)
    WHERE (l.state = 'published' AND (p.output_sha256 IS NULL OR p.output_sha256 <> sha256('out' || l.location_id))) OR (l.state <> 'published' AND p.output_sha256 IS NOT NULL)""")  # fmt: skip
def backup_findings(spark, d):
    """What the audit finds in tables that disagree, and whether their backup is refused."""
    tables, path = _tables(spark, d), new_path(spark, "backup")
    found = E.audit_findings(tables, _audits())
    try:
        E.backed_up(tables, path, _audits())
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(name, n, refused) for name, n in found.items()], "audit string, findings long, refused boolean")


@query("restored_backup", f"WITH {W.LOCATIONS} SELECT location_id, asset_id, state, CASE WHEN state = 'published' THEN sha256('out' || location_id) END AS output_sha256 FROM locations")
def restored_backup(spark, d):
    """Tables backed up, restored to another place and joined again."""
    loc = _tables(spark, d)["locations"]
    good = {"locations": loc, "published": loc.where("state = 'published'").select("location_id", "output_sha256")}
    archive = new_path(spark, "backup")
    E.backed_up(good, archive, _audits())
    back = E.restored(spark, archive, good, new_path(spark, "restored"), _audits())
    return back["locations"].drop("output_sha256").join(back["published"], "location_id", "left").select("location_id", "asset_id", "state", "output_sha256")


@query("fixture_counts", f"WITH {W.VECTORS} SELECT country, count(*) AS rows, count(DISTINCT heading) AS headings, count(DISTINCT camera_generation) AS generations FROM vectors GROUP BY country")
def fixture_counts(spark, d):
    return B.fixture_counts(W.vectors(spark, d))


# options


_RAW, _NAMED = next(iter(COUNTRY_ALIASES.items()))


@query(
    "search_streets_only",
    S._SEARCH.replace("'country ' || label AS country", f"CASE WHEN vec_id % 3 = 0 THEN '{_NAMED}' ELSE 'country ' || label END AS country").replace("country NOT IN ('country 3')", "country NOT IN ('country 3') AND location_id % 4 <> 1")
    + " SELECT location_id, CAST(place AS INTEGER) AS rank, round(b.s, 6) AS score, country FROM final",
)
def search_streets_only(spark, d):
    """The whole search without invented panoramas, with countries canonical before they are capped."""
    k = F.col("location_id")
    index = W.vectors(spark, d).withColumn("pano_id", F.when(k % 4 == 1, F.concat(F.lit(INVENTED[0]), k.cast("string"))).otherwise(F.col("pano_id")))
    index = index.withColumn("country", F.when(k % 3 == 0, _RAW).otherwise(F.col("country")))
    hits = R.ranked_search(index, W.query_vector(spark, d), count=30, per_country=5, filters=S._FILTERS, used=W.used(spark, d), drop_invented=True, canonical=True)
    return hits.select("location_id", "rank", F.round("score", 6).alias("score"), "country")


@query("claimable_streets", f"WITH {W.LOCATIONS} SELECT location_id FROM locations WHERE location_id % 10 <> 0 AND queue_state IS NULL AND (state = 'pending' OR (state = 'leased' AND lease_until <= 50000))")
def claimable_streets(spark, d):
    """Claimable rows of street panoramas only."""
    return claimable(W.locations(spark, d), 50_000, drop_invented=True).select("location_id")
