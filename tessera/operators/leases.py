"""Leases, shard cursors, submissions and paid searches as batch queries over their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import SEARCH_COST, UNITS
from tessera.functions.text import is_street_pano
from tessera.operators.catalog import with_prefix
from tessera.operators.control import part_numbers

#: Columns of a lease item in order, with what stands for a missing value.
ITEM = {
    "asset_id": None, "capture": None, "lane": None, "model": None, "label": "", "generation": 0, "attribution": None, "lat": None, "lon": None,
    "heading": 0.0, "pitch": 0.0, "zoom": 0.0, "country": "", "camera_generation": "",
}


def lease_items(locations: DataFrame, items: DataFrame, street_model: str) -> DataFrame:
    """What a worker gets for each item (lease_id, location_id) of its lease.

    A street panorama of the model is viewed from outside; another asset of the model is drawn, and its faces are checked
    by digest; any other model says neither. Missing columns of locations take their defaults.
    """
    have = set(locations.columns)
    column = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in have and d is not None else F.col(n) if n in have else F.lit(d)
    rows = items.select("lease_id", "location_id").join(locations, "location_id")
    own = F.col("model") == street_model
    view = F.when(own & is_street_pano(F.col("asset_id")), "street").when(own, "drawn")
    return rows.select("lease_id", "location_id", *[column(n, d).alias(n) for n, d in ITEM.items()], F.col("asset_id").alias("pano_id"), view.alias("view_strategy"))


def released(locations: DataFrame, leases: DataFrame, skip: bool = False) -> DataFrame:
    """locations after leases (lease_id, state) are given back: leased rows of leases that aren't submitted are pending again.

    With skip they are set aside. Expects active_lease and queue_state.
    """
    back = leases.where("state <> 'submitted'").select(F.col("lease_id").alias("active_lease"), F.lit(True).alias("_back")).distinct()
    out = locations.join(back, "active_lease", "left").withColumn("_back", F.coalesce(F.col("_back") & (F.col("state") == "leased"), F.lit(False)))
    fresh = {"state": F.lit("pending"), "active_lease": F.lit(None), "lease_until": F.lit(None), **({"queue_state": F.lit("skipped")} if skip else {})}
    return out.select(*[F.when(F.col("_back"), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in locations.columns])


def advanced(shards: DataFrame, claims: DataFrame) -> DataFrame:
    """shards after one round of claims (claim_id, shard_id, start, used, rows) on their byte cursors.

    Compare and swap: of a shard's claims that start at its cursor the first by claim_id moves it, the others change nothing.
    """
    fit = claims.join(shards.select("shard_id", F.col("next_byte").alias("start")), ["shard_id", "start"])
    first = fit.groupBy("shard_id").agg(F.min(F.struct("claim_id", "used", "rows")).alias("won"))
    out = shards.join(first, "shard_id", "left")
    moved = {"next_byte": F.col("won.used"), "next_row": F.col("won.rows")}
    return out.select(*[(F.col(c) + F.coalesce(moved[c], F.lit(0))).alias(c) if c in moved else F.col(c) for c in shards.columns], F.col("won.claim_id").alias("won_by"))


def submission_outcomes(submissions: DataFrame, leases: DataFrame, items: DataFrame, locations: DataFrame, now: int) -> DataFrame:
    """(lease_id, account_id, outcome, units) of submissions (lease_id, account_id, location_id), a row per supplied location.

    unknown_lease: no such lease of the account; replayed: submitted before, no units; expired: its time is over;
    incomplete: the supplied set isn't that of the lease; fenced: a location is no longer held by the lease; accepted:
    units by lane, once, however often a location is repeated.
    """
    supplied = submissions.select("lease_id", "account_id", "location_id").distinct().withColumn("_given", F.lit(1))
    listed = items.select("lease_id", "location_id").distinct().join(submissions.select("lease_id").distinct(), "lease_id", "left_semi")
    both = supplied.join(listed.withColumn("_due", F.lit(1)), ["lease_id", "location_id"], "left")
    held = locations.select("location_id", "lane", F.col("active_lease").alias("_holder"), "state")
    unit = F.when(F.col("lane") == "object", UNITS["object"]).otherwise(UNITS["scene"])
    rows = both.join(held, "location_id", "left").withColumn("_held", F.coalesce((F.col("_holder") == F.col("lease_id")) & (F.col("state") == "leased"), F.lit(False)))
    sums = rows.groupBy("lease_id", "account_id").agg(F.count_if(F.col("_due").isNull()).alias("foreign"), F.count("_due").alias("matched"), F.bool_and("_held").alias("all_held"), F.sum(unit).alias("units"))
    due = listed.groupBy("lease_id").agg(F.count("*").alias("due"))
    own = leases.select("lease_id", F.col("account_id").alias("_owner"), F.col("state").alias("_state"), "expires_at")
    out = sums.join(due, "lease_id", "left").join(own, "lease_id", "left")
    outcome = (
        F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("account_id")), "unknown_lease").when(F.col("_state") == "submitted", "replayed")
        .when((F.col("_state") != "active") | (F.col("expires_at") <= now), "expired").when((F.col("foreign") > 0) | (F.col("matched") != F.coalesce("due", F.lit(0))), "incomplete")
        .when(~F.col("all_held"), "fenced").otherwise("accepted")
    )
    return out.select("lease_id", "account_id", outcome.alias("outcome"), F.when(outcome == "accepted", F.col("units")).otherwise(0).alias("units"))


def debits(requests: DataFrame, accounts: DataFrame, cost: int = SEARCH_COST) -> DataFrame:
    """requests (request_id, account_id, key, query) with outcome, search_id and units.

    An account pays for its distinct keys in order of their first requests as long as its units last; units don't come
    back, so a key that finds none is refused for good. A later request of a paid key gets the stored search if its query is
    the first one's, else a conflict. Search ids are the ids of the paying requests.
    """
    first = requests.groupBy("account_id", "key").agg(F.min(F.struct("request_id", "query")).alias("first"))
    # a key's place within its account: its place among all keys less that of the account's first, so no account is one task's
    placed = with_prefix(first, [F.col("account_id"), F.col("first.request_id"), F.col("key")], "sum", F.lit(1), "_at")
    starts = placed.groupBy("account_id").agg(F.min("_at").alias("_start"))
    accounts = starts.join(accounts.select("account_id", F.col("units").alias("_have")), "account_id", "left")
    paid = placed.join(accounts, "account_id").withColumn("_n", F.col("_at") - F.col("_start") + 1)
    paid = paid.withColumn("_paid", F.col("_n") * F.lit(cost) <= F.col("_have"))
    out = requests.join(paid, ["account_id", "key"], "left")
    outcome = (
        F.when(F.col("_have").isNull(), "unauthorized").when(~F.col("_paid"), "insufficient_credit").when(F.col("request_id") == F.col("first.request_id"), "debited")
        .when(F.col("query").eqNullSafe(F.col("first.query")), "stored").otherwise("idempotency_conflict")
    )
    search = F.when(outcome.isin("debited", "stored"), F.col("first.request_id"))
    return out.select(*requests.columns, outcome.alias("outcome"), search.alias("search_id"), F.when(outcome == "debited", -cost).otherwise(0).alias("units"))


def current_parts(shards: DataFrame) -> DataFrame:
    """Per lane and assignee the first unfinished part: (lane, assignee, shard_id, part, parts, label, rows_left)."""
    parts = part_numbers(shards)
    first = parts.where("assignee IS NOT NULL AND next_row < row_count").groupBy("lane", "assignee").agg(F.min(F.struct("part", "shard_id", "parts", "label", "rows_left")).alias("p"))
    return first.select("lane", "assignee", "p.shard_id", "p.part", "p.parts", "p.label", "p.rows_left")


def lanes_with_work(shards: DataFrame) -> DataFrame:
    """Lanes that have an unfinished shard."""
    return shards.where("next_row < row_count").select("lane").distinct()
