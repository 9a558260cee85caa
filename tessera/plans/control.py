"""Queries on the work queue, the ledger and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import FAMILIES
from tessera.functions.text import family, family_order
from tessera.operators import catalog as C
from tessera.operators import control as Q
from tessera.operators.filters import claimable
from tessera.plans import views as W

QUERIES, SQL = {}, {}
NOW, LATER = 300_000, 990_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_ORDER = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN {i}" for i, (p, _) in enumerate(FAMILIES)) + f" ELSE {len(FAMILIES)} END"
_FAMILY = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN '{n}'" for p, n in FAMILIES) + " ELSE 'other' END"


@query(
    "status_by_lane",
    f"""WITH {W.LOCATIONS}, {W.SHARDS}, c AS (SELECT lane, count_if(state <> 'published') AS pending, count_if(state = 'published') AS published FROM locations GROUP BY lane),
    r AS (SELECT lane, CAST(sum(row_count - next_row) AS BIGINT) AS remaining FROM shards GROUP BY lane)
    SELECT coalesce(c.lane, r.lane) AS lane, CAST(coalesce(pending, 0) + coalesce(remaining, 0) AS BIGINT) AS pending, CAST(coalesce(published, 0) AS BIGINT) AS published, coalesce(remaining, 0) AS catalog_remaining FROM c FULL JOIN r ON c.lane = r.lane""",
)
def status_by_lane(spark, d):
    return Q.lane_status(W.locations(spark, d), W.shards(spark, d))


@query("catalog_remaining", f"WITH {W.SHARDS} SELECT lane, CAST(sum(row_count - next_row) AS BIGINT) AS remaining, bool_or(next_row < row_count) AS open FROM shards GROUP BY lane")
def catalog_remaining(spark, d):
    return W.shards(spark, d).groupBy("lane").agg(F.sum(F.col("row_count") - F.col("next_row")).alias("remaining"), F.bool_or(F.col("next_row") < F.col("row_count")).alias("open"))


@query("distinct_indexes", f"WITH {W.LOCATIONS}, {W.PUBLISHED} SELECT lane, count(DISTINCT index_key) AS indexes, count(*) AS n FROM published JOIN locations USING (location_id) WHERE index_key IS NOT NULL GROUP BY lane")
def distinct_indexes(spark, d):
    rows = W.published(spark, d).where("index_key IS NOT NULL").join(W.locations(spark, d).select("location_id", "lane"), "location_id")
    return rows.groupBy("lane").agg(F.countDistinct("index_key").alias("indexes"), F.count("*").alias("n"))


@query("names_in_use", f"WITH {W.LOCATIONS} SELECT DISTINCT 'country' AS kind, country AS name FROM locations UNION SELECT DISTINCT 'generation', camera_generation FROM locations")
def names_in_use(spark, d):
    return Q.names_in_use(W.locations(spark, d))


@query("list_indexes", f"WITH {W.LOCATIONS}, {W.PUBLISHED} SELECT lane, index_key, list(location_id ORDER BY location_id) AS location_ids, count(*) AS n FROM published JOIN locations USING (location_id) WHERE index_key IS NOT NULL GROUP BY ALL")
def list_indexes(spark, d):
    return Q.index_listing(W.published(spark, d), W.locations(spark, d))


@query("ledger_balance", f"WITH {W.LEDGER}, s AS (SELECT account_id, CAST(sum(units) AS BIGINT) AS units FROM ledger GROUP BY account_id) SELECT account_id, units, CAST(greatest(units, 0) // 100000 AS BIGINT) AS searches FROM s")
def ledger_balance(spark, d):
    return Q.balances(W.ledger(spark, d))


@query("earned_units", f"WITH {W.LOCATIONS} SELECT lane, CAST(sum(CASE WHEN lane = 'object' THEN 10 ELSE 1 END) AS BIGINT) AS units FROM locations WHERE state = 'published' GROUP BY lane")
def earned_units(spark, d):
    return Q.earned(W.locations(spark, d))


@query(
    "part_numbers",
    f"""WITH {W.SHARDS} SELECT shard_id, lane, {_FAMILY} AS family, CAST(row_number() OVER (PARTITION BY lane ORDER BY {_ORDER}, shard_id) AS INTEGER) AS part, count(*) OVER (PARTITION BY lane) AS parts,
    'Batch ' || row_number() OVER (PARTITION BY lane ORDER BY {_ORDER}, shard_id) || ' of ' || count(*) OVER (PARTITION BY lane) AS label, greatest(0, row_count - next_row) AS rows_left FROM shards""",
)
def part_numbers(spark, d):
    return Q.part_numbers(W.shards(spark, d)).select("shard_id", "lane", "family", "part", "parts", "label", "rows_left")


@query("nth_shard", f"WITH {W.SHARDS} SELECT shard_id, key FROM shards WHERE lane = 'scene' ORDER BY {_ORDER}, shard_id LIMIT 1 OFFSET 4")
def nth_shard(spark, d):
    return W.shards(spark, d).where("lane = 'scene'").orderBy(family_order(F.col("key")), "shard_id").offset(4).limit(1).select("shard_id", "key")


@query("shard_families", f"WITH {W.SHARDS} SELECT {_FAMILY} AS family, count(*) AS n, CAST(sum(row_count) AS BIGINT) AS rows FROM shards GROUP BY ALL")
def shard_families(spark, d):
    return W.shards(spark, d).groupBy(family(F.col("key")).alias("family")).agg(F.count("*").alias("n"), F.sum("row_count").alias("rows"))


_FIT = f"coalesce(queue_state, 'pending') = 'pending' AND (state = 'pending' OR (state = 'leased' AND lease_until <= {NOW // 4}))"


@query("claimable_work", f"WITH {W.LOCATIONS} SELECT lane, count(*) AS n FROM locations WHERE {_FIT} GROUP BY lane")
def claimable_work(spark, d):
    return claimable(W.locations(spark, d), NOW // 4).groupBy("lane").agg(F.count("*").alias("n"))


@query("fifo_claim", f"WITH {W.LOCATIONS} SELECT location_id FROM locations WHERE lane = 'scene' AND {_FIT} ORDER BY location_id LIMIT 64")
def fifo_claim(spark, d):
    return Q.claimed(W.locations(spark, d), "scene", NOW // 4, 64).select("location_id")


_STEAL = f"""next_row < row_count AND assignee IS NOT NULL AND held_since < {LATER - 21_600}
    AND NOT EXISTS (SELECT 1 FROM leases l WHERE l.account_id = s.assignee AND l.state = 'active' AND l.expires_at > {LATER})"""


@query("steal_candidates", f"WITH {W.SHARDS}, {W.LEASES} SELECT shard_id, assignee FROM shards s WHERE {_STEAL}")
def steal_candidates(spark, d):
    return Q.stealable(W.shards(spark, d), W.leases(spark, d), LATER).select("shard_id", "assignee")


@query(
    "next_shard",
    f"WITH {W.SHARDS}, {W.LEASES}, o AS (SELECT shard_id, key, CASE WHEN assignee = 35 THEN 0 ELSE 1 END AS own FROM shards s WHERE lane = 'object' AND next_row < row_count AND (assignee = 35 OR assignee IS NULL OR ({_STEAL})))"
    f" SELECT shard_id FROM o ORDER BY own, {_ORDER}, shard_id LIMIT 1",
)
def next_shard(spark, d):
    return Q.next_shard(W.shards(spark, d), W.leases(spark, d), 35, "object", LATER).select("shard_id")


@query("lease_expiry", f"WITH {W.LEASES} SELECT lease_id, CASE WHEN state = 'active' AND expires_at <= {NOW} THEN 'expired' ELSE state END AS state FROM leases")
def lease_expiry(spark, d):
    return Q.expired(W.leases(spark, d), NOW).select("lease_id", "state")


@query(
    "lease_renewal",
    f"""WITH {W.LEASES} SELECT lease_id, CASE WHEN lease_id % 2 = 0 AND state IN ('active', 'expired') THEN 'active' ELSE state END AS state,
    CASE WHEN lease_id % 2 = 0 AND state IN ('active', 'expired') THEN CAST({NOW + 21_600} AS BIGINT) ELSE expires_at END AS expires_at FROM leases""",
)
def lease_renewal(spark, d):
    leases = W.leases(spark, d)
    return Q.renewed(leases, leases.where("lease_id % 2 = 0").select("lease_id"), NOW).select("lease_id", "state", F.col("expires_at").cast("long").alias("expires_at"))


@query("paid_search_gate", f"WITH {W.LEDGER} SELECT DISTINCT event_id AS search_id, user_id AS account_id FROM events e WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.units < 0 AND l.reference = e.event_id AND l.account_id = e.user_id)")
def paid_search_gate(spark, d):
    searches = W.table(spark, d, "events").select(F.col("event_id").alias("search_id"), F.col("user_id").alias("account_id"))
    return Q.paid_searches(searches, W.ledger(spark, d)).select("search_id", "account_id")


_ACCOUNTS = "accounts AS (SELECT user_id AS account_id, CAST(sum(CASE event_type WHEN 'purchase' THEN CAST(round(value * CAST(100 AS DOUBLE)) AS BIGINT) WHEN 'error' THEN -CAST(round(value * CAST(100 AS DOUBLE)) AS BIGINT) ELSE 0 END) AS BIGINT) + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS units FROM events GROUP BY user_id)"


@query("audit_credit_mismatch", f"WITH {W.LEDGER}, {_ACCOUNTS} SELECT account_id, units, CAST(coalesce((SELECT sum(units) FROM ledger l WHERE l.account_id = a.account_id), 0) AS BIGINT) AS booked FROM accounts a WHERE units <> coalesce((SELECT sum(units) FROM ledger l WHERE l.account_id = a.account_id), 0)")
def audit_credit_mismatch(spark, d):
    events = W.table(spark, d, "events")
    money = F.round(F.col("value") * 100, 0).cast("long")
    signed = F.when(F.col("event_type") == "purchase", money).when(F.col("event_type") == "error", -money).otherwise(0)
    accounts = events.groupBy(F.col("user_id").alias("account_id")).agg(F.sum(signed).alias("units")).withColumn("units", F.col("units") + F.when(F.col("account_id") % 10 == 0, 1).otherwise(0))
    return Q.credit_mismatch(accounts, W.ledger(spark, d))


@query(
    "audit_published_mismatch",
    f"""WITH {W.LOCATIONS}, {W.PUBLISHED} SELECT l.location_id FROM locations l LEFT JOIN published p USING (location_id)
    WHERE (l.state = 'published' AND (p.output_sha256 IS NULL OR p.output_sha256 <> sha256('out' || l.location_id))) OR (l.state <> 'published' AND p.output_sha256 IS NOT NULL)""",
)
def audit_published_mismatch(spark, d):
    loc = W.locations(spark, d).withColumn("output_sha256", F.sha2(F.concat(F.lit("out"), F.col("location_id").cast("string")), 256))
    return Q.published_mismatch(loc, W.published(spark, d)).select("location_id")


_ACTIVE = "loc AS (SELECT *, CASE WHEN state = 'leased' THEN location_id * 2 END AS active_lease FROM locations), items AS (SELECT lease_id, lease_id // 2 AS location_id FROM leases WHERE lease_id % 5 <> 0)"


@query(
    "audit_lease_mismatch",
    f"""WITH {W.LOCATIONS}, {W.LEASES}, {_ACTIVE} SELECT l.location_id FROM loc l LEFT JOIN leases e ON e.lease_id = l.active_lease
    WHERE (l.state = 'leased' AND (e.lease_id IS NULL OR e.state <> 'active' OR e.expires_at <> l.lease_until * 2 OR NOT EXISTS (SELECT 1 FROM items i WHERE i.lease_id = e.lease_id AND i.location_id = l.location_id)))
    OR (l.state <> 'leased' AND (l.active_lease IS NOT NULL OR l.lease_until IS NOT NULL))""",
)
def audit_lease_mismatch(spark, d):
    loc = W.locations(spark, d).withColumn("active_lease", F.when(F.col("state") == "leased", F.col("location_id") * 2)).withColumn("lease_until", F.col("lease_until") * 2)
    leases = W.leases(spark, d)
    items = leases.where("lease_id % 5 <> 0").select("lease_id", F.floor(F.col("lease_id") / 2).alias("location_id"))
    return Q.lease_mismatch(loc, leases, items).select("location_id")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in W.TABLES))
def table_counts(spark, d):
    return reduce(DataFrame.unionByName, (W.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in W.TABLES))


@query(
    "publishable_audit_sample",
    f"""WITH {W.LOCATIONS}, {W.LEASES}, i AS (SELECT lease_id, location_id, asset_id NOT LIKE 'Prototype%' AS street FROM leases JOIN locations USING (location_id))
    SELECT lease_id, location_id FROM i WHERE NOT street UNION ALL SELECT lease_id, min(location_id) FROM i WHERE street GROUP BY lease_id""",
)
def publishable_audit_sample(spark, d):
    return Q.audit_sample(W.leases(spark, d).select("lease_id", "location_id"), W.locations(spark, d))


@query("ledger_dedup", f"WITH {W.LEDGER}, twice AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger) SELECT DISTINCT * FROM twice")
def ledger_dedup(spark, d):
    rows = W.ledger(spark, d)
    return Q.credited_once(rows.unionByName(rows))


@query(
    "snapshot_page",
    f"""WITH {W.LOCATIONS}, {W.PUBLISHED}, p AS (SELECT location_id, asset_id, hex(output_sha256) AS embedding FROM published JOIN locations USING (location_id) WHERE lane = 'scene' AND location_id > 100 ORDER BY location_id LIMIT 51),
    n AS (SELECT *, row_number() OVER (ORDER BY location_id) AS i, count(*) OVER () AS c FROM p)
    SELECT location_id, asset_id, embedding, CASE WHEN c > 50 THEN (SELECT location_id FROM n WHERE i = 50) END AS next_after FROM n WHERE i <= 50""",
)
def snapshot_page(spark, d):
    rows = W.published(spark, d).join(W.locations(spark, d).where("lane = 'scene'").select("location_id", "asset_id"), "location_id")
    return C.page(rows.select("location_id", "asset_id", F.hex("output_sha256").alias("embedding")), 100, 50)


@query("published_intersection", f"WITH {W.LOCATIONS}, {W.PUBLISHED} SELECT location_id FROM published INTERSECT SELECT location_id FROM locations WHERE state <> 'published'")
def published_intersection(spark, d):
    return W.published(spark, d).select("location_id").intersect(W.locations(spark, d).where("state <> 'published'").select("location_id"))


@query("lease_set_equality", f"WITH {W.LEASES}, a AS (SELECT location_id FROM leases WHERE state = 'active'), b AS (SELECT location_id FROM leases WHERE lease_id % 3 = 0 AND lease_id % 7 <> 0) SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS missing, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS surplus")
def lease_set_equality(spark, d):
    leases = W.leases(spark, d)
    a, b = leases.where("state = 'active'").select("location_id"), leases.where("lease_id % 3 = 0 AND lease_id % 7 <> 0").select("location_id")
    left = a.exceptAll(b).select(F.lit(1).alias("m"), F.lit(0).alias("s"))
    return left.union(b.exceptAll(a).select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("s"), F.lit(0)).alias("surplus"))


@query("index_union", f"WITH {W.VECTORS}, {W.LOCATIONS} SELECT 'vectors' AS source, location_id FROM vectors UNION ALL SELECT 'locations', location_id FROM locations WHERE state = 'published'")
def index_union(spark, d):
    a = W.vectors(spark, d).select(F.lit("vectors").alias("source"), "location_id")
    return a.unionByName(W.locations(spark, d).where("state = 'published'").select(F.lit("locations").alias("source"), "location_id"))


@query(
    "query_capture_lookup",
    f"""WITH {W.LOCATIONS}, q AS (SELECT DISTINCT 'pano-' || (vec_id * 3) AS asset_id FROM embeddings), r AS (SELECT q.asset_id, capture, row_number() OVER (PARTITION BY q.asset_id ORDER BY state = 'published' DESC, location_id) AS n FROM q LEFT JOIN locations l ON l.asset_id = q.asset_id)
    SELECT asset_id, coalesce(capture, 'unknown') AS capture FROM r WHERE n = 1""",
)
def query_capture_lookup(spark, d):
    asked = W.table(spark, d, "embeddings").select(F.concat(F.lit("pano-"), (F.col("vec_id") * 3).cast("string")).alias("asset_id")).distinct()
    best = W.locations(spark, d).groupBy("asset_id").agg(F.min_by("capture", F.struct(F.col("state") != "published", F.col("location_id"))).alias("capture"))
    return asked.join(best, "asset_id", "left").select("asset_id", F.coalesce("capture", F.lit("unknown")).alias("capture"))


@query("contiguous_ranges", "WITH r AS (SELECT s_suppkey AS id, s_suppkey * 10 AS start, s_suppkey * 10 + s_suppkey % 13 AS stop FROM supplier), l AS (SELECT *, lag(stop) OVER (ORDER BY start) AS prior FROM r) SELECT id, start, stop FROM l WHERE start < prior")
def contiguous_ranges(spark, d):
    k = F.col("s_suppkey")
    return C.overlaps_before(W.table(spark, d, "supplier").select(k.alias("id"), (k * 10).alias("start"), (k * 10 + k % 13).alias("stop")))
