"""Work queue, ledger and audits as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import SEARCH_COST, STEAL_S, UNITS
from tessera.functions.text import canonical_country, family, family_order, part_label
from tessera.operators.catalog import with_prefix


def lane_status(locations: DataFrame, shards: DataFrame) -> DataFrame:
    """Pending and published rows per lane; rows that wait in shards count as pending."""
    counts = locations.groupBy("lane").agg(F.count_if(F.col("state") != "published").alias("pending"), F.count_if(F.col("state") == "published").alias("published"))
    left = shards.groupBy("lane").agg(F.sum(F.col("row_count") - F.col("next_row")).alias("remaining"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.join(left, "lane", "full_outer").select("lane", (zero("pending") + zero("remaining")).alias("pending"), zero("published").alias("published"), zero("remaining").alias("catalog_remaining"))


def names_in_use(locations: DataFrame) -> DataFrame:
    """Distinct canonical countries and generations, as (kind, name)."""
    countries = locations.select(F.lit("country").alias("kind"), canonical_country(F.col("country")).alias("name"))
    generations = locations.select(F.lit("generation").alias("kind"), F.col("camera_generation").alias("name"))
    return countries.union(generations).where("name IS NOT NULL AND name <> ''").distinct()


def balances(ledger: DataFrame) -> DataFrame:
    sums = ledger.groupBy("account_id").agg(F.sum("units").alias("units"))
    return sums.withColumn("searches", F.floor(F.greatest("units", F.lit(0)) / SEARCH_COST))


def earned(locations: DataFrame) -> DataFrame:
    """Units that published rows earn, per lane."""
    weight = F.when(F.col("lane") == "object", UNITS["object"]).otherwise(UNITS["scene"])
    return locations.where("state = 'published'").groupBy("lane").agg(F.sum(weight).alias("units"))


def part_numbers(shards: DataFrame) -> DataFrame:
    """Each shard's number within its lane, by family and id, with its label; no lane is gathered in one task."""
    order = [F.col("lane"), family_order(F.col("key")), F.col("shard_id")]
    placed = with_prefix(shards, order, "sum", F.lit(1), "_at")
    lanes = placed.groupBy("lane").agg(F.min("_at").alias("_first"), F.count("*").alias("parts"))
    out = placed.join(lanes, "lane").withColumn("part", (F.col("_at") - F.col("_first") + 1).cast("int"))
    return out.select(*shards.columns, family(F.col("key")).alias("family"), "part", "parts", part_label(F.col("part"), F.col("parts")).alias("label"), F.greatest(F.lit(0), F.col("row_count") - F.col("next_row")).alias("rows_left"))


def stealable(shards: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Unfinished shards held for six hours by an account without a live lease."""
    live = leases.where((F.col("state") == "active") & (F.col("expires_at") > now)).select(F.col("account_id").alias("assignee")).distinct()
    held = shards.where((F.col("next_row") < F.col("row_count")) & F.col("assignee").isNotNull() & (F.col("held_since") < now - STEAL_S))
    return held.join(live, "assignee", "left_anti").select(*shards.columns)


def next_shard(shards: DataFrame, leases: DataFrame, account: int, lane: str, now: int) -> DataFrame:
    """The shard that an account gets: its own unfinished one, else the first free or stealable one."""
    open_ = shards.where((F.col("lane") == lane) & (F.col("next_row") < F.col("row_count")))
    own = open_.where(F.col("assignee") == account).withColumn("_own", F.lit(0))
    free = open_.where("assignee IS NULL").unionByName(stealable(open_, leases, now)).withColumn("_own", F.lit(1))
    return own.unionByName(free).orderBy("_own", family_order(F.col("key")), "shard_id").limit(1).drop("_own")


def claimed(locations: DataFrame, lane: str, now: int, limit: int) -> DataFrame:
    """The first claimable rows of a lane, first in first out."""
    from tessera.operators.filters import claimable

    return claimable(locations.where(F.col("lane") == lane), now).orderBy("location_id").limit(limit)


def expired(leases: DataFrame, now: int) -> DataFrame:
    return leases.withColumn("state", F.when((F.col("state") == "active") & (F.col("expires_at") <= now), "expired").otherwise(F.col("state")))


def renewed(leases: DataFrame, held: DataFrame, now: int, seconds: int = 21_600) -> DataFrame:
    """Leases that still hold a location get seconds more and are active again, expired ones too."""
    holds = held.select("lease_id").distinct().withColumn("_holds", F.lit(True))
    alive = F.col("_holds") & F.col("state").isin("active", "expired")
    out = leases.join(holds, "lease_id", "left").withColumn("_alive", F.coalesce(alive, F.lit(False)))
    out = out.withColumn("expires_at", F.when(F.col("_alive"), now + seconds).otherwise(F.col("expires_at"))).withColumn("state", F.when(F.col("_alive"), "active").otherwise(F.col("state")))
    return out.select(*leases.columns)


def credit_mismatch(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    sums = ledger.groupBy("account_id").agg(F.sum("units").alias("booked"))
    return accounts.join(sums, "account_id", "left").withColumn("booked", F.coalesce("booked", F.lit(0))).where("units <> booked")


def published_mismatch(locations: DataFrame, published: DataFrame) -> DataFrame:
    """Published rows without a matching index row, and index rows of others; expects locations.output_sha256."""
    own = published.select("location_id", F.col("output_sha256").alias("_sha"), F.lit(True).alias("_in"))
    both = locations.join(own, "location_id", "left")
    bad = ((F.col("state") == "published") & (F.col("_in").isNull() | ~F.col("output_sha256").eqNullSafe(F.col("_sha")))) | ((F.col("state") != "published") & F.col("_in").isNotNull())
    return both.where(bad).select(*locations.columns)


def lease_mismatch(locations: DataFrame, leases: DataFrame, items: DataFrame) -> DataFrame:
    """Leased rows without a live lease that lists them; expects locations.active_lease."""
    lease = leases.select(F.col("lease_id").alias("active_lease"), F.col("state").alias("_state"), F.col("expires_at").alias("_until"))
    listed = items.select(F.col("lease_id").alias("active_lease"), "location_id", F.lit(True).alias("_listed")).distinct()
    both = locations.join(lease, "active_lease", "left").join(listed, ["active_lease", "location_id"], "left")
    bad_lease = F.col("_state").isNull() | (F.col("_state") != "active") | (F.col("_until") != F.col("lease_until")) | F.col("_listed").isNull()
    bad = ((F.col("state") == "leased") & bad_lease) | ((F.col("state") != "leased") & (F.col("active_lease").isNotNull() | F.col("lease_until").isNotNull()))
    return both.where(bad).select(*locations.columns)


def credited_once(ledger: DataFrame) -> DataFrame:
    """The first booking of each reference."""
    rest = [c for c in ledger.columns if c != "reference"]
    one = ledger.groupBy("reference").agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(*[F.col("reference") if c == "reference" else F.col(f"r.{c}").alias(c) for c in ledger.columns])


def paid_searches(searches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Searches with a booking that debits the account."""
    return searches.join(ledger.where("units < 0").select("account_id", F.col("reference").alias("search_id")), ["account_id", "search_id"], "left_semi")


def index_listing(published: DataFrame, locations: DataFrame) -> DataFrame:
    """Index keys with their ordered location ids."""
    rows = published.where("index_key IS NOT NULL").join(locations.select("location_id", "lane"), "location_id")
    return rows.groupBy("lane", "index_key").agg(F.array_sort(F.collect_list("location_id")).alias("location_ids"), F.count("*").alias("n"))


def audit_sample(items: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows to recompute per lease: every invented panorama and the first street one."""
    from tessera.functions.text import is_street_pano

    rows = items.join(locations.select("location_id", "asset_id"), "location_id").withColumn("street", is_street_pano(F.col("asset_id")))
    first = rows.where("street").groupBy("lease_id").agg(F.min("location_id").alias("location_id"))
    return rows.where("NOT street").select("lease_id", "location_id").union(first)
