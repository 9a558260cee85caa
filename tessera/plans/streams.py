"""Queries on streams, files and audits: leases with timers, byte cursors, resumed imports, shards that micro-batches fill."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions.checks import class_file
from tessera.functions.text import storage_floor
from tessera.functions.vectors import output_digest
from tessera.operators import audit as A
from tessera.operators import exports as E
from tessera.operators import manifests as M
from tessera.operators import spatial
from tessera.operators.tables import new_path, spread
from tessera.plans import formats
from tessera.plans import views as W
from tessera.sources import byte_lines, json_records, shards
from tessera.sources import records as S
from tessera.sources.records import opened, write_bytes
from tessera.streaming import imports as I
from tessera.streaming import leases as L
from tessera.streaming import queue as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: What the events of an account do to its lease, and the sizes that this query takes.
KINDS = {"view": "ask", "signup": "renew", "purchase": "submit", "error": "release"}
SIZES = {"count": 3, "shard_rows": 7, "lease": 86_400_000, "steal": 129_600_000}
QUEUES = 8

_LEASE = "{{'account': x.account, 'shard': x.shard, 'generation': x.generation, 'until': {until}, 'live': {live}, 'items': {items}}}"
_OUT = "{{'account': {x}.account, 'kind': '{kind}', 'at_ms': {at}, 'shard': {x}.shard, 'generation': {x}.generation, 'until': {x}.until, 'n_items': len({x}.items), 'first_item': {x}.items[1]}}"
_CHANGED = "list_transform(leases, lambda x: CASE WHEN x.account = account THEN {} ELSE x END)"
_END = _LEASE.format(until="x.until", live="false", items="CAST([] AS BIGINT[])")
_BACK = "list_sort(list_concat(back, mine.items))"

LEASE_SQL = f"""
WITH RECURSIVE e AS (
    SELECT user_id % {QUEUES} AS queue, user_id AS account, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind, epoch_us(ts) // 1000 AS now, event_id FROM events),
steps AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY now, event_id) AS i FROM e WHERE kind IS NOT NULL),
walk AS (
    SELECT queue, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(account BIGINT, since BIGINT, following BIGINT)[]) AS shards,
        CAST([] AS STRUCT(account BIGINT, shard BIGINT, generation BIGINT, until BIGINT, live BOOLEAN, items BIGINT[])[]) AS leases, CAST([] AS BIGINT[]) AS back,
        CAST([] AS STRUCT(account BIGINT, kind VARCHAR, at_ms BIGINT, shard BIGINT, generation BIGINT, until BIGINT, n_items BIGINT, first_item BIGINT)[]) AS outcomes
    FROM (SELECT DISTINCT queue FROM steps)
    UNION ALL
    SELECT queue, i, CASE WHEN asked AND shard = len(shards) THEN list_append(shards, {{'account': account, 'since': now, 'following': last}})
            WHEN asked THEN list_transform(shards, lambda x, k: CASE WHEN k = shard + 1 THEN {{'account': account, 'since': CASE WHEN own IS NULL THEN now ELSE x.since END, 'following': last}} ELSE x END) ELSE shards END AS shards,
        CASE WHEN asked THEN list_append(list_filter(leases, lambda x: x.account <> account), given)
            WHEN live AND kind = 'renew' THEN {_CHANGED.format(_LEASE.format(until=f"now + {SIZES['lease']}", live="true", items="x.items"))}
            WHEN live AND kind = 'submit' AND len(mine.items) > 1 THEN {_CHANGED.format(_LEASE.format(until="x.until", live="true", items="x.items[2:]"))}
            WHEN live AND kind IN ('submit', 'release') THEN {_CHANGED.format(_END)} ELSE leases END AS leases,
        CASE WHEN asked THEN list_filter(back, lambda b: NOT list_contains(reused, b)) WHEN live AND kind = 'release' THEN {_BACK} ELSE back END AS back,
        CASE WHEN asked THEN list_append(outcomes, {_OUT.format(x="given", kind="leased", at="now")})
            WHEN live AND kind = 'ask' THEN list_append(outcomes, {_OUT.format(x="mine", kind="resumed", at="now")})
            WHEN live AND kind = 'renew' THEN list_append(outcomes, {{'account': account, 'kind': 'renewed', 'at_ms': now, 'shard': mine.shard, 'generation': mine.generation, 'until': now + {SIZES["lease"]}, 'n_items': len(mine.items), 'first_item': mine.items[1]}})
            WHEN live AND kind = 'submit' THEN list_append(outcomes, {{'account': account, 'kind': 'submitted', 'at_ms': now, 'shard': mine.shard, 'generation': mine.generation, 'until': mine.until, 'n_items': len(mine.items) - 1, 'first_item': mine.items[2]}})
            WHEN live AND kind = 'release' THEN list_append(outcomes, {_OUT.format(x="mine", kind="released", at="now")}) ELSE outcomes END AS outcomes
    FROM (SELECT *, {{'account': account, 'shard': shard, 'generation': coalesce(mine.generation, 0) + 1, 'until': now + {SIZES["lease"]}, 'live': true,
            'items': list_concat(reused, list_transform(range(first, last), lambda k: shard * {SIZES["shard_rows"]} + k))}} AS given
    FROM (SELECT *, least({SIZES["shard_rows"]}, first + {SIZES["count"]} - len(reused)) AS last
    FROM (SELECT *, list_filter(back, lambda b: b // {SIZES["shard_rows"]} = shard)[:{SIZES["count"]}] AS reused, coalesce(shards[shard + 1].following, 0) AS first
    FROM (SELECT *, coalesce(own, stolen, len(shards)) AS shard
    FROM (SELECT *, kind = 'ask' AND NOT live AS asked, list_min(list_filter(unfinished, lambda s: shards[s + 1].account = account)) AS own,
            list_min(list_filter(unfinished, lambda s: shards[s + 1].since < now - {SIZES["steal"]} AND NOT list_contains(busy, shards[s + 1].account))) AS stolen
    FROM (SELECT *, coalesce(mine.live, false) AS live, list_transform(list_filter(leases, lambda x: x.live), lambda x: x.account) AS busy,
            list_filter(range(len(shards)), lambda s: shards[s + 1].following < {SIZES["shard_rows"]} OR len(list_filter(back, lambda b: b // {SIZES["shard_rows"]} = s)) > 0) AS unfinished
    FROM (SELECT *, list_filter(leases, lambda x: x.account = account)[1] AS mine
    FROM (SELECT s.queue, s.i, s.account, s.kind, s.now, w.shards,
            list_transform(w.leases, lambda x: CASE WHEN x.live AND x.until <= s.now THEN {_END} ELSE x END) AS leases,
            list_sort(list_concat(w.back, flatten(list_transform(list_filter(w.leases, lambda x: x.live AND x.until <= s.now), lambda x: x.items)))) AS back,
            list_transform(list_filter(w.leases, lambda x: x.live AND x.until <= s.now), lambda x: {_OUT.format(x="x", kind="expired", at="x.until")}) AS outcomes
        FROM walk w JOIN steps s ON s.queue = w.queue AND s.i = w.i + 1)))))))))
SELECT queue, o.account AS account, o.kind AS kind, o.at_ms AS at_ms, o.shard AS shard, o.generation AS generation, o.until AS until, CAST(o.n_items AS BIGINT) AS n_items, o.first_item AS first_item
FROM (SELECT queue, unnest(outcomes) AS o FROM walk
    UNION ALL SELECT queue, {_OUT.format(x="x", kind="expired", at="x.until")} AS o FROM (SELECT w.queue, unnest(w.leases) AS x FROM walk w JOIN (SELECT queue, max(i) AS i FROM walk GROUP BY queue) USING (queue, i))
        WHERE x.live AND x.until <= (SELECT max(now) FROM steps))
"""  # noqa: S608


def lease_events(events):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = events.select((F.col("user_id") % QUEUES).alias("queue"), F.col("user_id").alias("account"), kind[F.col("event_type")].alias("kind"), "ts", "event_id")
    return rows.where("kind IS NOT NULL")


@query("lease_outcomes_stream", LEASE_SQL)
def lease_outcomes_stream(spark, d):
    return T.drained(L.lease_stream(lease_events(T.event_stream(spark, f"{d}/events*.parquet")), **SIZES), "lease-outcomes")


_CUSTOMER_LINES = "lines AS (SELECT c_custkey // 120 AS shard_id, c_custkey AS row_index, c_custkey || chr(9) || c_name || chr(9) || c_mktsegment AS line FROM customer)"


def customer_lines(spark, d):
    """(row_index, line): a line per customer."""
    key = F.col("c_custkey")
    return W.table(spark, d, "customer").select(key.alias("row_index"), F.concat_ws("\t", key.cast("string"), "c_name", "c_mktsegment").alias("line"))


@query("byte_cursor_stream", f"WITH {_CUSTOMER_LINES}, b AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY shard_id ORDER BY row_index) AS BIGINT) AS stop FROM lines) SELECT shard_id, stop - strlen(line) - 1 AS start, stop, line FROM b")
def byte_cursor_stream(spark, d):
    """Line shards read by a stream in two starts; at the first one every second shard is there only up to the middle of a line."""
    byte_lines.register(spark)
    made, path, run = new_path(spark, "made"), new_path(spark, "cursor-shards"), new_path(spark, "cursor")
    E.write_line_shards(customer_lines(spark, d), made, 120)

    def lay(rows):  # as an uploader would: a task copies the shards it is given
        for batch in rows:
            for shard, half in zip(batch.column("shard").to_pylist(), batch.column("half").to_pylist(), strict=True):
                files, place = opened(f"{made}/{shard}")
                with files.open_input_file(place) as f:
                    data = f.read(f.size() * 2 // 3 if half else f.size())
                write_bytes(f"{path}/{shard.split('/')[0]}.tsv", data)
            yield batch

    listed = spark.createDataFrame([(s, k % 2 == 1) for k, s in enumerate(byte_lines.shards_of(made, ".txt"))], "shard string, half boolean")
    stream = spark.readStream.format("byte_lines").option("path", path).option("bytesPerPartition", 4096).load()
    for half in (F.col("half"), F.lit(False)):
        listed.select("shard", half.alias("half")).mapInArrow(lay, listed.schema).write.format("noop").mode("overwrite").save()
        out = T.drained(stream, "cursor", at=run)
    return out.select(F.regexp_extract("shard", "shard_id=([0-9]+)", 1).cast("long").alias("shard_id"), "start", "stop", "line")


_JOB_LINE = "'m' || chr(9) || k || chr(9) || lat || chr(9) || lon || chr(9) || '0' || chr(9) || '0' || chr(9) || '0' || chr(9) || asset || chr(9) || c_mktsegment"
_JOBS = """jobs AS (SELECT k, (k // 150) AS f, 'pano-' || (k * 7 % 900) AS asset, CAST(k % 170 - 85 AS BIGINT) AS lat, CAST(k * 3 % 350 - 175 AS BIGINT) AS lon, c_mktsegment FROM (SELECT c_custkey AS k, c_mktsegment FROM customer))"""


def job_lines(spark, d):
    """(k, f, line): a 9-column line per customer, in files of 150; identities repeat."""
    k = F.col("c_custkey")
    cells = [F.lit("m"), k, k % 170 - 85, k * 3 % 350 - 175, F.lit("0"), F.lit("0"), F.lit("0"), F.concat(F.lit("pano-"), (k * 7 % 900).cast("string")), F.col("c_mktsegment")]
    return W.table(spark, d, "customer").select(k.alias("row_index"), F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("line"))


@query(
    "resumed_import",
    f"""WITH {_JOBS}, first AS (SELECT asset, min(k) AS k FROM jobs GROUP BY asset)
    SELECT asset AS asset_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, c_mktsegment AS country, f AS file FROM first JOIN jobs USING (asset, k)""",
)
def resumed_import(spark, d):
    """Shards imported three files at a time by a run that is stopped twice, once before its batch is recorded, and started again."""
    lines, path, to = new_path(spark, "job-shards"), new_path(spark, "job-files"), new_path(spark, "import")
    E.write_line_shards(job_lines(spark, d), lines, 150)

    def named(rows):  # files that arrive in the order of their names, each at a later time than the one before
        last = 0
        for batch in rows:
            for number, shard in zip(batch.column("number").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                files, place = opened(f"{lines}/{shard}")
                with files.open_input_file(place) as f:
                    data = f.read()
                own, came = f"{path}/{number:06d}.tsv", last
                while came <= last:  # the clock of files is coarse
                    if came:
                        time.sleep(0.001)
                    write_bytes(own, data)
                    came = files.get_file_info(opened(own)[1]).mtime_ns // 1_000_000
                last = came
            yield batch

    found = sorted((int(s.split("/")[0].split("=")[1]), s) for s in byte_lines.shards_of(lines, ".txt"))
    spark.createDataFrame(found, "number long, shard string").coalesce(1).mapInArrow(named, "number long, shard string").write.format("noop").mode("overwrite").save()
    for batches in (1, 1, None):
        I.Import(spark, to).run(path, files_per_batch=3, batches=batches)
    name = F.element_at(F.split("shard", "/"), -1)
    return I.Import(spark, to).jobs().select("asset_id", "lat", "lon", "country", F.substring(name, 1, 6).cast("long").alias("file"))


_LIMITED = """o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, 'c' || o_custkey AS asset_id, o_custkey FROM orders),
t AS (SELECT *, k // 500 AS b, k = min(k) OVER (PARTITION BY asset_id) AND o_custkey % 5 <> 0 AS fresh FROM o),
s AS (SELECT b, count(*) AS size, count(*) FILTER (fresh) AS n FROM t GROUP BY b), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s)"""


@query("import_limit", f"WITH {_LIMITED} SELECT k AS position, asset_id FROM t JOIN c USING (b) WHERE fresh AND CASE WHEN size = 500 THEN earlier < 60 OR b = 0 ELSE earlier < 60 AND k - 500 * b < 60 - earlier END")
def import_limit(spark, d):
    from tessera.operators.catalog import indexed

    orders = indexed(W.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "position")
    jobs = orders.select("position", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("asset_id"), F.lit("unknown").alias("capture"), F.lit("scene").alias("lane"), F.lit("visual-v1").alias("model"), "o_custkey")
    return I.limited(jobs, jobs.where("o_custkey % 5 = 0"), 60).select("position", "asset_id")


@query("stream_shards", f"WITH {_CUSTOMER_LINES} SELECT line, (SELECT count(*) FROM lines) AS total_rows, (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM lines) AS total_bytes FROM lines")
def stream_shards(spark, d):
    """Lines that arrive in five files, a micro-batch each, in shards of 90 that are filled over the micro-batches; in two runs."""
    shards.register(spark)
    come, path = new_path(spark, "arrivals"), new_path(spark, "filled")
    customer_lines(spark, d).repartition(5, "row_index").write.parquet(come)
    arrivals = spark.readStream.schema("row_index long, line string").option("maxFilesPerTrigger", 1).parquet(come).select("line")
    for _ in range(2):
        arrivals.repartition(3).writeStream.format("record_shards").option("path", path).option("rowsPerShard", 90).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    report = shards.close_shards(path)
    out = spark.read.format("record_shards").option("path", path).load()
    return out.select("line", F.lit(report["rows"]).cast("long").alias("total_rows"), F.lit(report["bytes"]).cast("long").alias("total_bytes"))


def _poses(spark, d, width=8):
    rows = W.locations(spark, d)
    return rows.select("location_id", "lat", F.col("lon").alias("lng"), "heading", "pitch", "zoom", F.col("asset_id").alias("pano_id"), "capture", "country", "camera_generation", "lane", F.substring(F.unhex(F.sha2("asset_id", 256)), 1, width).alias("embedding"))


@query(
    "flat_shard_replace",
    f"""WITH {W.LOCATIONS} SELECT location_id, lat, lon AS lng, asset_id AS pano_id, upper(substr(sha256(asset_id), 1, 16)) AS embedding, lane FROM locations WHERE lane = 'object' OR location_id % 2 = 0""",
)
def flat_shard_replace(spark, d):
    """Flat shards by lane; the scene lane is written twice, and its second rows replace the first."""
    shards.register(spark)
    path, rows = new_path(spark, "flat"), _poses(spark, d)
    for lane, some in (("scene", "true"), ("object", "true"), ("scene", "location_id % 2 = 0")):
        own = rows.where((F.col("lane") == lane) & F.expr(some)).drop("lane")
        own.write.format("record_shards").option("path", path).option("kind", "flat").option("width", 8).option("rowsPerShard", 100).option("key", lane).mode("append").save()
    read = lambda lane: spark.read.format("record_shards").option("path", path).option("kind", "flat").option("width", 8).option("key", lane).load().withColumn("lane", F.lit(lane))
    return read("scene").unionByName(read("object")).select("location_id", "lat", "lng", "pano_id", F.hex("embedding").alias("embedding"), "lane")


@query("segments_pruned", f"WITH {W.LOCATIONS} SELECT location_id, lane, country, upper(substr(sha256(asset_id), 1, 16)) AS embedding FROM locations WHERE lane = 'object' AND location_id > 40 AND location_id <= 120 AND zoom > 0")
def segments_pruned(spark, d):
    """Sealed segments under filters that the source takes over; the zoom is left to Spark."""
    root, rows = new_path(spark, "pruned"), _poses(spark, d)
    for lane in ("scene", "object"):
        S.publish_segments(rows.where(F.col("lane") == lane).drop("lane"), root, lane, 8, capacity=150)
    index = spark.read.format("sealed_segments").option("path", root).load()
    return index.where("lane = 'object' AND location_id > 40 AND location_id <= 120 AND zoom > 0").select("location_id", "lane", "country", F.hex("embedding").alias("embedding"))


@query("file_tail", "WITH n AS (SELECT count(*) AS n FROM customer) SELECT c_custkey AS k, c_name AS name FROM customer, n WHERE c_custkey >= n - 120 AND c_custkey < n - 20")
def file_tail(spark, d):
    """The last 120 lines but 20 of one file, read from its end."""
    byte_lines.register(spark)
    path = new_path(spark, "tail")
    E.write_line_shards(customer_lines(spark, d), path, 1 << 40)
    file = next(iter(byte_lines.shards_of(path, ".txt")))
    lines = spark.read.format("byte_lines").option("path", f"{path}/{file}").option("tail", 120).option("skipLast", 20).load()
    c = F.split("line", "\t")
    return lines.select(c[0].cast("long").alias("k"), c[1].alias("name"))


@query("json_records", "SELECT 'n' || o_custkey % 4 || '.json' AS document, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS position, o_orderkey AS id, o_orderstatus || '\"{[' || o_orderpriority AS label FROM orders")
def json_records_(spark, d):
    """Four documents of orders, each in the array "records" beside another one, read in blocks of 20,000 bytes."""
    path = new_path(spark, "json")
    rows = W.table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("n"), "o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit('"{['), "o_orderpriority").alias("label"))).alias("r"))

    def write(batches):  # a task streams the rows of its documents in order
        state = {"n": None, "out": None}

        def end():
            if state["out"]:
                state["out"].write(b'], "other": [{"id": 1}, [2]]}')
                state["out"].close()

        for batch in batches:
            numbers = batch.column("n").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                n, r = int(numbers[i]), ",\n ".join(batch.column("r").slice(i, j - i).to_pylist())
                if n != state["n"]:
                    end()
                    files, place = opened(f"{path}/n{n}.json")
                    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    state |= {"n": n, "out": files.open_output_stream(place)}
                    state["out"].write(b'{"source": "a [{ \\" ", "first": [{"id": 0}], "records": [' + r.encode())
                else:
                    state["out"].write(b",\n " + r.encode())
            yield batch
        end()

    rows.repartition("n").sortWithinPartitions("n", "o_orderkey").mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()
    return json_records.parsed(json_records.read_records(spark, path, "records", 20_000), "id long, label string")


_ARRIVALS = "arrivals AS (SELECT location_id AS position, 'new-' || location_id AS asset_id, CASE location_id % 3 WHEN 0 THEN lat + CAST(0.00022465 AS DOUBLE) WHEN 1 THEN lat + CAST(0.000224 AS DOUBLE) ELSE lat - CAST(0.0003 AS DOUBLE) END AS lat, lon, lane, capture, model FROM locations)"
_METERS = "2 * CAST(6371000 AS DOUBLE) * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(
    "import_duplicates",
    f"""WITH {W.LOCATIONS}, {_ARRIVALS}, old AS (SELECT * FROM locations WHERE location_id % 2 = 0)
    SELECT position, asset_id, EXISTS (SELECT 1 FROM old b WHERE b.lane = a.lane AND b.capture = a.capture AND b.model = a.model AND b.asset_id <> a.asset_id
            AND abs(b.lat - a.lat) <= CAST(25 AS DOUBLE) / 111320 AND abs(b.lon - a.lon) <= CAST(25 AS DOUBLE) / greatest(1, 111320 * abs(cos(radians(a.lat)))) AND {_METERS} <= 25)
        OR EXISTS (SELECT 1 FROM arrivals b WHERE b.position < a.position AND b.lane = a.lane AND b.capture = a.capture AND b.model = a.model AND b.asset_id <> a.asset_id AND {_METERS} <= 25) AS deferred FROM arrivals a""",
)
def import_duplicates(spark, d):
    """Arrivals of which every third lies 24.98 m north of a stored row: within the distance and outside the box."""
    rows, k = W.locations(spark, d), F.col("location_id")
    moved = F.when(k % 3 == 0, F.col("lat") + 0.00022465).when(k % 3 == 1, F.col("lat") + 0.000224).otherwise(F.col("lat") - 0.0003)
    arrivals = rows.select(k.alias("position"), F.concat(F.lit("new-"), k.cast("string")).alias("asset_id"), moved.alias("lat"), "lon", "lane", "capture", "model")
    return spatial.import_flags(arrivals, rows.where("location_id % 2 = 0")).select("position", "asset_id", "deferred")


_CHECKED = f"""true_vectors AS (SELECT * FROM ({formats.SQL["scene_embedding"]}) UNION ALL SELECT * FROM ({formats.SQL["object_embedding"]})),
rows AS (SELECT location_id, location_id // 10 AS lease_id, asset_id, capture, lane, model, embedding, NOT starts_with(asset_id, 'Prototype') AS street FROM locations JOIN true_vectors USING (location_id)),
taken AS (SELECT *, NOT street OR location_id = min(location_id) FILTER (street) OVER (PARTITION BY lease_id) AS sampled FROM rows)"""
_WRONG = "CASE WHEN {k} % 13 = 5 THEN '7F' || substr({v}, 3) ELSE {v} END"


@query(
    "recomputed_audit",
    f"""WITH {W.LOCATIONS}, {_CHECKED}, e AS (SELECT *, CASE WHEN lane = 'scene' THEN sha256(CAST('{W.SCENE_MODEL}' || chr(10) || asset_id || chr(10) || capture || chr(10) || lane || chr(10) || model || chr(10) AS BLOB)
            || unhex(CASE WHEN sampled THEN embedding WHEN location_id % 29 = 7 THEN substr(embedding, 1, 10) ELSE {_WRONG.format(k="location_id", v="embedding")} END)) END AS expected_sha256,
        substr(embedding, 1, 2) <> '7F' AND location_id % 13 = 5 AS changed FROM taken)
    SELECT lease_id, location_id, sampled, CASE WHEN lane = 'scene' THEN expected_sha256 END AS expected_sha256,
        CASE WHEN lane <> 'scene' THEN 'model' WHEN location_id % 29 = 7 THEN 'length' WHEN location_id % 17 = 3 OR (NOT sampled AND changed) THEN 'digest' WHEN sampled AND changed THEN 'embedding' END AS problem FROM e""",
)
def recomputed_audit(spark, d):
    """Submissions of which some have a wrong vector, digest, length or model; sampled ones are computed anew."""
    rows, k = spread(W.locations(spark, d), "location_id"), F.col("location_id")
    key = F.concat_ws("\n", "asset_id", "capture", "lane", "model")
    true = rows.withColumn("v", X.vector_of(key, F.col("lane")))
    digest = output_digest(F.lit(W.SCENE_MODEL), F.col("asset_id"), F.col("capture"), F.col("lane"), F.col("model"), F.col("v"))
    wrong = F.when(k % 13 == 5, F.concat(F.unhex(F.lit("7F")), F.substring("v", 2, 1000))).otherwise(F.col("v"))
    given = true.select((F.floor(k / 10)).alias("lease_id"), "location_id", "asset_id", "capture", "lane", "model", F.when(k % 29 == 7, F.substring("v", 1, 5)).otherwise(wrong).alias("embedding"), F.when(k % 17 == 3, F.sha2(digest, 256)).otherwise(digest).alias("output_sha256"))
    out = A.audited(given, W.SCENE_MODEL)
    return out.select("lease_id", "location_id", "sampled", F.when(F.col("lane") == "scene", F.col("expected_sha256")).alias("expected_sha256"), "problem")


_IDENTITY = {n: f"{n} of the test" for n in M.IDENTITY}
_CODEBOOK = "codebook of the test"
_RULES = M.rules(_IDENTITY, _CODEBOOK)
_RULE_NAMES = "[" + ", ".join(f"'{n}'" for n in _RULES) + "]"


@query("manifest_rules", f"SELECT c_custkey AS lease_id, CASE WHEN c_custkey % {len(_RULES) + 1} < {len(_RULES)} THEN {_RULE_NAMES}[c_custkey % {len(_RULES) + 1} + 1] ELSE '' END AS problems FROM customer")
def manifest_rules(spark, d):
    """A manifest per customer, as JSON; the customer's number says which rule, if any, its manifest breaks."""
    k = F.col("c_custkey")
    at = {name: i for i, name in enumerate(_RULES)}
    broken = lambda name: k % (len(_RULES) + 1) == at[name]
    pick = lambda name, good, bad: F.when(broken(name), bad).otherwise(good)
    total, start = (k % 5 + 1), F.lit(2**32) + k
    digest = lambda name: F.sha2(F.concat(k.cast("string"), name), 256)

    def entry(rule, name, records, size, *more):
        whole = records * size
        return F.struct(*more, name.alias("file"), records.cast("long").alias("records"), F.lit(size).cast("long").alias("recordBytes"), pick(rule, whole, whole + 1).cast("long").alias("bytes"), digest(name).alias("sha256")), F.struct(name.alias("key"), F.struct(whole.cast("long").alias("bytes"), digest(name).alias("sha256")).alias("value"))

    def listed(rule, kind, numbered, floors):
        rows = [entry(rule, class_file(kind, F.lit(n), F.lit(name)), (k + n) % 3, M.RECORD_BYTES, F.lit(n).alias("id"), F.lit(name).alias("name"), floor.alias("storageFloor")) for (n, name), floor in zip(numbered, floors, strict=True)]
        return F.array(*[e for e, _ in rows]), [f for _, f in rows]

    singles = {n: entry(n, F.lit(name), total, size) for n, (name, size) in M.PER_LOCATION.items()}
    classes, class_files = listed("classes", "class", M.CLASSES, [storage_floor(F.lit(n)) for n, _ in M.CLASSES])
    hot, hot_files = listed("hotConcepts", "hot", [(i, p[0]) for i, p in enumerate(M.HOT_PHRASES)], list(map(F.lit, M.HOT_FLOORS)))
    own = [pick(f"semantic.{n}", F.lit(v), F.lit("x" if isinstance(v, str) else v + 1)).alias(n) for n, v in M.SEMANTIC.items()] + [pick("semantic.codebookSha256", F.lit(_CODEBOOK), F.lit("x")).alias("codebookSha256")]
    semantic, semantic_file = entry("semantic", F.lit(M.SEMANTIC_FILE), total * M.SEMANTIC["proposalsPerLocation"], M.SEMANTIC_BYTES, *own)
    quality, quality_file = entry("viewQuality", F.lit("view-quality.bin"), total, M.QUALITY_BYTES)
    with_quality = ((k % 2 == 0) | broken("viewQuality")) & ~broken("permanentlyInvalidLocations")
    files = [*(f for _, f in singles.values()), *class_files, *hot_files, semantic_file]
    all_files = F.concat(F.array(*files), F.when(with_quality, F.array(quality_file)).otherwise(F.slice(F.array(quality_file), 1, 0)))
    countries = F.array(F.lit("Chile"), F.lit("Japan"))
    numbers = {
        "totalLocations": total, "indexedLocations": total, "globalStart": start, "minimumGlobalLocation": start, "maximumGlobalLocation": start + total - 1, "sourceBytes": k * 100,
    }
    manifest = F.struct(
        F.map_from_arrays(F.array(*map(F.lit, M.VERSIONS)), F.array(*[pick(f"contractVersions.{n}", F.lit(v), F.lit(v + 1)) for n, v in M.VERSIONS.items()])).alias("contractVersions"),
        *[pick(n, F.lit(v), F.lit(v + 1)).alias(n) for n, v in M.NUMBERS.items()], *[pick(n, F.lit(v), F.lit(v + 0.001)).alias(n) for n, v in M.ABOUT.items()], *[pick(n, F.lit(v), F.lit(None)).alias(n) for n, v in _IDENTITY.items()],
        pick("completed", F.lit(True), F.lit(False)).alias("completed"), pick("viewStrategy", F.lit(M.VIEW_STRATEGY), F.lit("flat")).alias("viewStrategy"), pick("sourceId", digest(F.lit("id")), F.lit("x")).alias("sourceId"),
        *[pick(n, v, v + 1).alias(n) for n, v in numbers.items()], pick("sourceSha256", digest(F.lit("lines")), F.lit("x")).alias("sourceSha256"), pick("permanentlyInvalidLocations", F.lit(None).cast("long"), F.lit(3)).alias("permanentlyInvalidLocations"),
        pick("countries", countries, F.array(F.lit("Chile"), F.lit("Japan"), F.lit("Chile"))).alias("countries"), *[e.alias(n) for n, (e, _) in singles.items()], classes.alias("classes"), hot.alias("hotConcepts"), semantic.alias("semantic"), F.when(with_quality, quality).alias("viewQuality"),
    )
    surplus = F.array(F.struct(F.lit("surplus.bin").alias("key"), F.struct(F.lit(1).cast("long").alias("bytes"), F.lit("").alias("sha256")).alias("value")))
    came = F.map_from_entries(F.concat(all_files, F.when(broken("file names"), surplus).otherwise(F.slice(surplus, 1, 0))))
    facts = F.struct(total.alias("total"), start.alias("global_start"), (k * 100).alias("source_bytes"), digest(F.lit("lines")).alias("source_sha256"), digest(F.lit("id")).alias("source_id"), F.array(F.lit("Japan"), F.lit("Chile"), F.lit("Japan")).alias("countries"), came.alias("files"))
    rows = spread(W.table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("lease_id"), F.to_json(manifest).alias("text"), facts.alias("facts"))
    read = rows.select("lease_id", F.from_json("text", M.SCHEMA).alias("m"), "facts")
    return read.select("lease_id", F.array_join(M.manifest_problems(F.col("m"), F.col("facts"), _RULES), ",").alias("problems"))
