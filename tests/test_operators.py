import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.constants import EARTH_RADIUS_M
from tessera.operators import catalog as C
from tessera.operators import control as Q
from tessera.operators import ranking as R
from tessera.operators import spatial as S


def meters(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def clustered(seed=4):
    rng, out = random.Random(seed), []
    for lat, lon in ((0, 0), (45, 179.9999), (-45, -179.9999), (89.9999, 10), (-89.9999, -120), (60.0, 0.0), (89.99, 179.99)):
        for _ in range(40):
            spread = 0.0006 / max(0.05, math.cos(math.radians(lat))) if abs(lat) < 89.9 else 180
            x = lon + rng.uniform(-spread, spread)
            out.append((max(-90.0, min(90.0, lat + rng.uniform(-0.0006, 0.0006))), (x + 180) % 360 - 180))
    return out


def test_grid_join_misses_nothing(spark):
    points = clustered()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "location_id long, lat double, lon double")
    for limit in (25.0, 100.0):
        got = {(r.location_id, r.r_location_id) for r in S.within(df, df, limit, kind="inner").collect()}
        want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if meters(a, b) <= limit}
        assert got == want and len(want) > len(points)


def test_duplicates_and_exclusion(spark):
    points = clustered(5)
    rows = [(i, f"p{i % 90}", "scene", "c", "m", a, b) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "location_id long, asset_id string, lane string, capture string, model string, lat double, lon double")
    got = {r.location_id for r in S.duplicate_flags(df).where("deferred").collect()}
    assert got == {i for i, a in enumerate(points) if any(meters(a, points[j]) <= 25 and rows[j][1] != rows[i][1] for j in range(i))}
    used = df.where("location_id % 20 = 3").select(F.concat("asset_id", F.lit("x")).alias("pano_id"), "lat", "lon")
    kept = {r.location_id for r in S.exclude_used(df.withColumnRenamed("asset_id", "pano_id"), used).collect()}
    assert kept == {i for i, a in enumerate(points) if not any(meters(a, points[j]) < 25 for j in range(3, len(points), 20))}


def test_prune_is_greedy_in_order(spark):
    points = clustered(6)
    rows = [(i % 2, i + 1, i, f"p{i % 100}", a, b) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "query_id long, rank int, location_id long, pano_id string, lat double, lon double")
    got = {r.location_id for r in S.prune_nearby(df).collect()}
    want = set()
    for q in (0, 1):
        kept = []
        for r in rows:
            if r[0] == q and not any(k[3] == r[3] or meters(k[4:], r[4:]) < 100 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert got == want
    three = spark.createDataFrame([(0, 1, 1, "a", 0.0, 0.0), (0, 2, 2, "b", 0.0002, 0.0), (0, 3, 3, "c", 1.0, 1.0)], df.schema)
    assert [r.pano_id for r in S.prune_nearby(three).orderBy("rank").collect()] == ["a", "c"]


def test_cap_and_sample(spark):
    hits = spark.createDataFrame([(1, "USA"), (2, "USA"), (3, "Japan")], "rank int, country string")
    assert [(r.rank, r.country) for r in R.cap_by_country(hits, 2, 1).orderBy("rank").collect()] == [(1, "USA"), (2, "Japan")]
    rows = spark.range(150).withColumnRenamed("id", "position")
    got = [r.position for r in R.evenly_sampled(rows, 100).orderBy("position").collect()]
    assert got[0] == 0 and got[-1] == 149 and got == sorted({round(i / 99 * 149) for i in range(100)})


def test_ties_prefer_smaller_ids(spark):
    hits = spark.createDataFrame([(i, 0.5) for i in range(9)], "location_id long, score double")
    assert [r.location_id for r in R.best(hits, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.location_id for r in R.best(hits, 3, "desc").orderBy("rank").collect()] == [2, 1, 0]


def test_index_is_dense_and_pages_chain(spark):
    rows = spark.range(1000).select((F.col("id") * 3).alias("location_id")).repartition(7)
    got = C.indexed(rows, "location_id").orderBy("location_id").collect()
    assert [r.row_index for r in got] == list(range(1000)) and [r.location_id for r in got] == list(range(0, 3000, 3))
    seen, after = [], 0
    while True:
        page = C.page(rows, after, 300).orderBy("location_id").collect()
        seen += [r.location_id for r in page]
        if page[0].next_after is None:
            break
        after = page[0].next_after
    assert seen == list(range(3, 3000, 3))


def test_renewal_revives_only_held_leases(spark):
    leases = spark.createDataFrame([(1, "expired", 5), (2, "expired", 5), (3, "submitted", 5), (4, "active", 5)], "lease_id long, state string, expires_at long")
    held = spark.createDataFrame([(1,), (3,), (4,), (4,)], "lease_id long")
    assert {r.lease_id: (r.state, r.expires_at) for r in Q.renewed(leases, held, 100, 50).collect()} == {1: ("active", 150), 2: ("expired", 5), 3: ("submitted", 5), 4: ("active", 150)}


def test_prefixes_equal_plain_loops(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(50), rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, v long").repartition(6)
    before, want = [], {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        seen = [x for x in before if x is not None]
        want[i] = {"sum": sum(seen), "max": max(seen, default=None), "min": min(seen, default=None), "last": seen[-1] if seen else None}
        before.append(v)
    for how in ("sum", "max", "min", "last"):
        got = {r.id: r.x for r in C.with_prefix(df, [F.col("k"), F.col("id")], how, F.col("v"), "x").collect()}
        assert got == {i: w[how] for i, w in want.items()}, how


def test_disjoint_ranges_are_greedy_in_order(spark):
    for seed in range(3):
        rng = random.Random(seed)
        ranges = [(i, a, a + rng.randrange(1, 60)) for i in range(150) for a in [rng.randrange(1500)]]
        taken, want = [r[1:] for r in ranges[:12]], set()
        for i, a, b in sorted(ranges[12:], key=lambda r: (r[1], r[0])):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                want.add((i, a, b))
        df = spark.createDataFrame(ranges, "id long, start long, stop long").repartition(5)
        assert {tuple(r) for r in C.disjoint_ranges(df.where("id < 12"), df.where("id >= 12")).collect()} == want


def test_scratch_tables_go(spark):
    import os

    from tessera.operators.tables import new_path, scratch, stored

    local = lambda p: p.removeprefix("file:")
    kept = new_path(spark, "kept")
    with scratch(spark):
        table = stored(spark.range(5), "inner")
        inner = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        table.write.parquet(kept)
        assert os.path.isdir(inner)
    assert not os.path.isdir(inner) and os.path.isdir(local(kept)) and spark.read.parquet(kept).count() == 5


def test_tags_and_lanes(spark):
    rows = spark.createDataFrame([(1, [5, 2, 3]), (2, []), (3, None), (4, [9])], "location_id long, tags array<int>")
    names = spark.createDataFrame([(2, "B"), (3, "C"), (5, ""), (7, None)], "tag int, name string")
    assert {r.location_id: r.country for r in C.with_first_tag(rows, names).collect()} == {1: "B", 2: "", 3: "", 4: ""}
    table = spark.createDataFrame([(1, "scene"), (2, "object"), (3, None)], "id long, lane string")
    fresh = spark.createDataFrame([(9, "scene")], table.schema)
    assert sorted(r.id for r in C.replaced_lane(table, fresh, "scene").collect()) == [2, 3, 9]
    try:
        C.replaced_lane(table, table, "scene").collect()
        raise AssertionError
    except Exception as e:
        assert "another lane" in str(e)


def test_every_query_is_searched_in_blocks(spark, sf):
    from pyspark.sql import functions as F

    from tessera.functions import vectors as V
    from tessera.operators import ranking as R
    from tessera.plans import registry
    from tessera.plans import views as W

    v = W.vectors(spark, sf).select("location_id", "vector")
    copy = v.where("location_id < 30").withColumn("location_id", F.col("location_id") + 100000)
    v = v.union(copy).union(spark.createDataFrame([(200000, None), (200050, [0.0] * 64), (200100, [1.0])], v.schema))
    asked = v.where("location_id % 50 = 0").select(F.col("location_id").alias("query_id"), F.col("vector").alias("query"))
    brute = asked.crossJoin(v).select("query_id", "location_id", V.cosine(F.col("query"), F.col("vector")).alias("score"))
    want = sorted(map(tuple, R.best_by_query(brute, 10).select("query_id", "location_id", "score", "rank").collect()))
    got = sorted(map(tuple, R.search_all(asked, v, 10, query_block=4, shard_rows=100).select("query_id", "location_id", "score", "rank").collect()))
    assert got == want
    ids = {r.query_id for r in registry.queries()["multi_query_search_whole"](spark, sf).collect()}
    assert ids == {r.location_id for r in W.vectors(spark, sf).where("location_id % 50 = 0").collect()}


def test_no_overfetch(spark, sf):
    from tessera.operators import ranking as R
    from tessera.plans import views as W

    index, asked = W.vectors(spark, sf), W.query_vector(spark, sf)
    search = lambda **o: [r.location_id for r in R.ranked_search(index, asked, count=20, per_country=1, prune_m=0, **o).orderBy("rank").collect()]
    countries = index.select("country").distinct().count()
    assert len(search(overfetching=False)) == min(20, countries) >= len(search())
    some = search()
    assert some == search(overfetching=False)[: len(some)]


def test_an_account_with_most_keys_pays_in_order(spark):
    from tessera.operators.leases import debits

    asked = spark.createDataFrame([(i, 1 if i % 3 else None if i == 0 else 2, f"k{i // 2}", 0) for i in range(60)], "request_id long, account_id long, key string, query int")
    rows = debits(asked, spark.createDataFrame([(1, 70), (2, 0)], "account_id long, units long"), 10).orderBy("request_id").collect()
    paid = [r.key for r in rows if r.outcome == "debited"]
    first = list(dict.fromkeys(r.key for r in rows if r.account_id == 1))
    assert paid == first[:7] and {r.outcome for r in rows if r.account_id == 2} == {"insufficient_credit"} and rows[0].outcome == "unauthorized"


def test_the_limit_of_a_synthetic_import_holds_per_request(spark):
    from tessera.operators.catalog import synthetic_import

    names = "asset_id string, capture string, lane string, model string, position long"
    rows = lambda n: spark.createDataFrame([(f"synthetic:{k % 7}", "c", "scene", "m", k) for k in range(n)], names)
    got = synthetic_import(rows(3), rows(40), limit=10, request=F.floor(F.col("position") / 10))
    assert sorted((r.asset_id, r.position) for r in got.collect()) == [(f"synthetic:{k}", k) for k in range(7)]
    for request in (None, F.floor(F.col("position") / 20)):
        with pytest.raises(ValueError, match="too many"):
            synthetic_import(rows(3), rows(40), limit=10, request=request)
