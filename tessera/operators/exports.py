"""Files that other programs take: shards of lines, location queues, four-view blobs, and the discovery of index folders."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bundles import file_digests
from tessera.operators.catalog import indexed, with_prefix
from tessera.operators.tables import drop_path, stored
from tessera.sources.records import FOUR_VIEW_BYTES, VIEW_BYTES, opened, read_bytes, write_bytes

#: Records of a four-view shard, bytes of an index file that is listed, bytes that a slice reads at least and per row.
SHARD_RECORDS, LISTED_BYTES, SLICE_BYTES, ROW_BYTES = 50_000, 32 << 20, 8192, 256


def write_line_shards(lines: DataFrame, path: str, rows_per_shard: int, index: str = "row_index", line: str = "line") -> DataFrame:
    """Write lines as one text file per run of rows_per_shard and list the files: (shard_id, bytes, sha256).

    A shard is one task's stream of its lines in order; Spark's writer renames finished files, so lost tasks leave none.
    """
    rows = lines.select(F.floor(F.col(index) / rows_per_shard).alias("shard_id"), F.col(index).alias("_at"), F.col(line).alias("value"))
    rows.repartition("shard_id").sortWithinPartitions("shard_id", "_at").select("shard_id", "value").write.partitionBy("shard_id").option("maxRecordsPerFile", 0).text(path)
    return shard_files(lines.sparkSession, path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, bytes, sha256) of written line shards, from the bytes of the files."""
    return file_digests(spark, path, "*.txt").select(F.regexp_extract("path", "shard_id=([0-9]+)", 1).cast("long").alias("shard_id"), "bytes", "sha256")


def queue_lines(rows: DataFrame, map_id: str, order: str = "location_id", road: str = "no road name") -> DataFrame:
    """(row_index, line): rows as lines of 11 columns with ids from 1 in the order; names are canonical, an unknown camera is called so.

    A text with a tab or line break is an error. Numbers are written as Spark writes doubles, missing angles as 0.
    """
    from tessera.functions.text import canonical_country

    def cell(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.rlike("[\t\n\r]"), F.raise_error(F.lit("control character")).cast("string")).otherwise(text)

    out = indexed(rows, order)
    angle = lambda n: cell(F.coalesce(F.col(n).cast("double"), F.lit(0.0)))
    camera = F.when(F.coalesce("camera_generation", F.lit("")) == "", "unknown").otherwise(F.col("camera_generation"))
    cells = [F.lit(map_id), (F.col("row_index") + 1).cast("string"), cell(F.col("lat")), cell(F.col("lon")), angle("heading"), angle("pitch"), angle("zoom"), cell(F.col("asset_id")), cell(canonical_country(F.col("country"))), cell(camera), F.lit(road)]
    return out.select("row_index", F.concat_ws("\t", *cells).alias("line"))


def handoff(rows: DataFrame, path: str, map_id: str, rows_per_shard: int = 500_000) -> DataFrame:
    """Write each lane's queue below path and report (lane, shard_id, bytes, sha256); a row of another lane is an error."""
    bad = rows.where(~F.coalesce(F.col("lane").isin("scene", "object"), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("invalid lane")
    reports = [write_line_shards(queue_lines(rows.where(F.col("lane") == lane), map_id), f"{path}/{lane}", rows_per_shard).withColumn("lane", F.lit(lane)) for lane in ("scene", "object")]
    return reports[0].unionByName(reports[1]).select("lane", "shard_id", "bytes", "sha256")


def next_slice(lines: DataFrame, start: int, need: int, line: str = "line", order: str = "row_index") -> DataFrame:
    """The whole lines, need at most, of the bytes that one read from a byte offset gives: (order, line, start, stop).

    A read takes max(8192, 256 * need) bytes, so lines that end beyond it wait for the next one; stop of the last row is
    the new cursor.
    """
    placed = with_prefix(lines.withColumn("_bytes", F.octet_length(line) + 1), [F.col(order)], "sum", F.col("_bytes"), "start").withColumn("stop", F.col("start") + F.col("_bytes"))
    fit = placed.where((F.col("start") >= start) & (F.col("stop") <= start + max(SLICE_BYTES, need * ROW_BYTES)))
    return fit.orderBy(order).limit(need).select(order, line, "start", "stop")


def write_four_view_shards(records: DataFrame, path: str, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Write records (row_index from 0, record) as shards of fixed-width records and their view masks: (shard, records).

    Each task streams whole shards; a record of another width is an error. A mask has a byte per record, its low four bits
    say which views hold a positive scale.
    """

    def write(batches):
        shard, rows, mask = None, [], bytearray()

        def done():
            if rows:
                write_bytes(f"{path}/shard-{shard:06d}.i8", b"".join(rows))
                write_bytes(f"{path}/shard-{shard:06d}.mask", bytes(mask))
                yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [len(rows)]}, schema=pa.schema([("shard", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for number, record in zip(batch.column("shard").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if len(record) != FOUR_VIEW_BYTES:
                    raise ValueError("a record of another width")
                if number != shard:
                    yield from done()
                    shard, rows, mask = number, [], bytearray()
                rows.append(record)
                mask.append(sum(1 << v for v in range(4) if 0 < int.from_bytes(record[v * VIEW_BYTES : v * VIEW_BYTES + 2], "little") < 0x7C00))
        yield from done()

    rows = records.select(F.floor(F.col("row_index") / shard_records).alias("shard"), "row_index", "record")
    return rows.repartition("shard").sortWithinPartitions("shard", "row_index").select("shard", "record").mapInArrow(write, "shard long, records long")


#: Records that may lie between two wanted ones which one read takes together, and records that one read takes at most.
GAP_RECORDS, READ_RECORDS = 16, 4096


def records_at(wanted: DataFrame, path: str, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(row_index, record) of the wanted records, read by shard and offset; one that isn't there whole is an error.

    Wanted records are dealt out in order of their place, and a task reads neighbours together.
    """

    def read(batches):
        for batch in batches:
            at = batch.column("row_index").to_numpy()
            if len(at) and at[0] < 0:
                raise ValueError("no such record")
            breaks = np.flatnonzero((np.diff(at) > GAP_RECORDS) | (np.diff(at // shard_records) > 0)) + 1
            found: list[bytes] = []
            for run in np.split(at, breaks):
                for own in (run[k : k + READ_RECORDS // GAP_RECORDS] for k in range(0, len(run), READ_RECORDS // GAP_RECORDS)):
                    first, n = int(own[0]), int(own[-1] - own[0]) + 1
                    data = read_bytes(f"{path}/shard-{first // shard_records:06d}.i8", first % shard_records * FOUR_VIEW_BYTES, n * FOUR_VIEW_BYTES)
                    found += [data[int(i - first) * FOUR_VIEW_BYTES : int(i - first + 1) * FOUR_VIEW_BYTES] for i in own]
            if any(len(r) != FOUR_VIEW_BYTES for r in found):
                raise ValueError("no such record")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found, pa.binary())], names=["row_index", "record"])

    placed = wanted.select(F.col("row_index").cast("long").alias("row_index")).repartitionByRange("row_index").sortWithinPartitions("row_index")
    return placed.mapInArrow(read, "row_index long, record binary")


def mask_problems(spark: SparkSession, path: str) -> DataFrame:
    """(shard, problem) of shards whose mask is missing, of another length, or lacks a view of a record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*").load(path)
    name = F.regexp_extract("path", r"shard-([0-9]+)\.(i8|mask)$", 1).cast("long")
    data = files.where(F.col("path").endswith(".i8")).select(name.alias("shard"), (F.col("length") / FOUR_VIEW_BYTES).alias("records"))
    masks = files.where(F.col("path").endswith(".mask")).select(name.alias("shard"), F.hex("content").alias("mask"))
    problem = F.when(F.col("mask").isNull(), "missing").when(F.length("mask") != 2 * F.col("records"), "length").when(~F.col("mask").rlike("^(0F)*$"), "incomplete")
    return data.join(masks, "shard", "left").select("shard", problem.alias("problem")).where("problem IS NOT NULL")


def whole_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs (key, bytes, locations) that hold a record for each location of a key that ends in 32 hexadecimal digits."""
    return blobs.where(F.regexp_extract("key", r"([^/]+?)(\.[^./]*)?$", 1).rlike("^[0-9a-f]{32}$") & (F.col("locations") > 0) & (F.col("bytes") == F.col("locations") * FOUR_VIEW_BYTES))


def scene_indexes(files: DataFrame) -> DataFrame:
    """(folder) of the folders that have index/manifest.json, among files (path): the root's own and its children's."""
    return files.select(F.regexp_extract("path", "^(?:(.*)/)?index/manifest\\.json$", 1).alias("folder"), "path").where(F.col("path").endswith("index/manifest.json") & ~F.col("folder").contains("/")).select("folder").distinct()


def object_indexes(files: DataFrame) -> DataFrame:
    """Finished object indexes among files (path, content): (source, folder, start, stop).

    A manifest lies in the root, a child or the child's index folder; it says completed and a positive number of rows, and
    locations.tsv lies beside it or one folder up.
    """
    manifest = F.from_json(F.col("content").cast("string"), "completed boolean, sourceId string, globalStart long, indexedLocations long")
    found = files.where(F.col("path").rlike(r"^([^/]+/)?(index/)?manifest\.json$")).select(F.regexp_replace("path", r"/?manifest\.json$", "").alias("folder"), manifest.alias("m"))
    lines = files.where(F.col("path").rlike(r"(^|/)locations\.tsv$")).select(F.regexp_replace("path", r"/?locations\.tsv$", "").alias("place")).distinct()
    near = found.withColumn("place", F.explode(F.array(F.col("folder"), F.regexp_replace("folder", "/?[^/]+$", ""))))
    kept = near.where("m.completed AND m.indexedLocations > 0").join(lines, "place", "left_semi").dropDuplicates(["folder"])
    start = F.coalesce("m.globalStart", F.lit(0))
    return kept.select(F.coalesce(F.nullif(F.col("m.sourceId"), F.lit("")), F.element_at(F.split("folder", "/"), -1)).alias("source"), "folder", start.alias("start"), (start + F.col("m.indexedLocations")).alias("stop"))


def listed_files(files: DataFrame, prefix: str) -> DataFrame:
    """(folder, key, bytes) of the files (path, bytes) of index folders of 32 hexadecimal digits that are small enough to send."""
    key = F.concat(F.lit(prefix), F.col("path"))
    fit = F.col("path").rlike("^[0-9a-f]{32}/[A-Za-z0-9._-]{1,80}$") & (F.col("bytes") <= LISTED_BYTES)
    return files.where(fit).select(F.concat(F.lit(prefix), F.substring_index("path", "/", 1), F.lit("/")).alias("folder"), key.alias("key"), "bytes")


def sealed_remainder(sources: DataFrame, limit: int) -> DataFrame:
    """Registered sources (start, stop, path) that end within the limit, in order of start and path."""
    return sources.where(F.coalesce("stop", F.lit(0)) <= limit).withColumn("start", F.coalesce("start", F.lit(0))).orderBy("start", "path")


def line_capabilities(line: Column) -> Column:
    """(columns, camera_verified, road_names_absent): what the width of an index's lines tells of its search."""
    width = F.size(F.split(line, "\t", -1))
    return F.struct(width.alias("columns"), (width >= 10).alias("camera_verified"), (width < 11).alias("road_names_absent"))


def nested_hits(documents: DataFrame, column: str = "value") -> DataFrame:
    """(name, index, score, offset) of search outputs: hits of named queries, or a bare list of hits with an empty name."""
    hit = "struct<locationIndex: long, similarity: double, score: double, viewOffset: int>"
    doc = F.from_json(column, f"queries array<struct<name: string, hits array<{hit}>>>, hits array<{hit}>".replace("hits array<struct", "hits: array<struct", 1))
    named = F.flatten(F.transform(doc["queries"], lambda q: F.transform(q["hits"], lambda h: F.struct(F.coalesce(q["name"], F.lit("")).alias("name"), h.alias("h")))))
    bare = F.transform(doc["hits"], lambda h: F.struct(F.lit("").alias("name"), h.alias("h")))
    rows = documents.select(F.explode(F.coalesce(named, bare)).alias("x")).select("x.name", "x.h.*")
    return rows.select("name", F.col("locationIndex").alias("index"), F.coalesce(F.nullif("similarity", F.lit(0.0)), "score", F.lit(0.0)).alias("score"), F.coalesce("viewOffset", F.lit(0)).alias("offset"))


def bundle_line_problems(lines: DataFrame, items: DataFrame, global_start: int) -> DataFrame:
    """(row_index, problem) for lines of an object bundle that don't fit the ordered items of its lease.

    lines has row_index from 0 and line; items has row_index, asset_id, lat, lon. A line without an item, or an item
    without a line, is a problem too.
    """
    from tessera.functions.checks import near

    c = lambda i: F.get("_c", F.lit(i))
    both = lines.select("row_index", F.split("line", "\t", -1).alias("_c")).join(items.select("row_index", "asset_id", "lat", "lon", F.lit(True).alias("_item")), "row_index", "full_outer")
    problem = (
        F.when(F.col("_c").isNull(), "missing line").when(F.col("_item").isNull(), "surplus line").when(F.size("_c") != 12, "columns").when(~c(7).eqNullSafe(F.col("asset_id")), "panorama")
        .when(~near(c(2), F.col("lat")) | ~near(c(3), F.col("lon")), "coordinates").when(c(11) != (F.col("row_index") + global_start).cast("string"), "global id")
    )
    return both.select("row_index", problem.alias("problem")).where("problem IS NOT NULL")


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write (name, content) as files below path, each by a task and under a temporary name first, and list what is there.

    A name that would leave the folder is an error. Returns (name, bytes, sha256) of the files, read back.
    """
    from tessera.functions.checks import safe_key

    def write(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                write_bytes(f"{path}/{name}", content or b"")
                there = read_bytes(f"{path}/{name}")
                rows.append((name, len(there), hashlib.sha256(there).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["name", "bytes", "sha256"])

    name = F.when(safe_key(F.col("name")), F.col("name")).otherwise(F.raise_error(F.lit("unsafe name")).cast("string"))
    return stored(files.select(name.alias("name"), "content").mapInArrow(write, "name string, bytes long, sha256 string"), "written-files")


class Artifacts:
    """A store of named blobs below a folder that all executors reach; keys may not leave it."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _path(self, key: str) -> str:
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError("invalid key")
        return f"{self.root}/{key}"

    def put(self, key: str, data: bytes, content_type: str = "application/octet-stream") -> None:
        write_bytes(self._path(key), data)
        write_bytes(f"{self._path(key)}.meta.json", json.dumps({"contentType": content_type, "bytes": len(data)}).encode())

    def get(self, key: str) -> bytes:
        return read_bytes(self._path(key))

    def exists(self, key: str) -> bool:
        files, place = opened(self._path(key))
        return files.get_file_info(place).is_file


def audit_findings(tables: dict[str, DataFrame], audits: dict) -> dict[str, int]:
    """Numbers of findings by audit; audits maps a name to a function of the tables that gives the rows with a problem."""
    return {name: audit(tables).count() for name, audit in audits.items()}


def backed_up(tables: dict[str, DataFrame], path: str, audits: dict) -> dict[str, int]:
    """Copy tables below path and run audits on the copies; a finding is an error and the copies go. Returns the copies' row counts.

    A path where something is already is refused and left as it is.
    """
    spark = next(iter(tables.values())).sparkSession
    files, place = opened(path)
    if files.get_file_info(place).type != FileType.NotFound:
        raise ValueError("there is something at the backup's path")
    copies = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        copies[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    found = [name for name, n in audit_findings(copies, audits).items() if n]
    if found:
        drop_path(spark, path)
        raise ValueError(f"the backup fails its audit: {', '.join(found)}")
    return {name: df.count() for name, df in copies.items()}


def restored(spark: SparkSession, archive: str, names, path: str, audits: dict) -> dict[str, DataFrame]:
    """The tables of a backup copied to a new path, audited there as a backup is; the archive stays as it is."""
    backed_up({name: spark.read.parquet(f"{archive}/{name}") for name in names}, path, audits)
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
