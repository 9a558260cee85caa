"""Fixed-width record files as Spark data sources, and the writer of sealed segments.

sealed_segments: a registry and, per segment, three parallel files of vectors, ids and poses. flat_shard: a header and
pose-and-vector records. four_view: 3,080-byte records of four half-precision scales with 768 signed bytes each. Records
have a fixed width, so a partition is a range of records, read by its offset; a file of any size is split.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Fixed values of the formats.
POSE = np.dtype([("location_id", "<u8"), ("lat", "<f8"), ("lng", "<f8"), ("heading", "<f8"), ("pitch", "<f8"), ("zoom", "<f8"), ("pano_id", "S64"), ("capture", "S16"), ("country", "S32"), ("camera_generation", "S16")])
FLAT_MAGIC = b"VCIDX001"
FOUR_VIEW_BYTES, VIEWS, VIEW_BYTES = 3080, 4, 770
CAPACITY = 500_000
ROWS_PER_PARTITION = 100_000

POSE_SCHEMA = "location_id long, lat double, lng double, heading double, pitch double, zoom double, pano_id string, capture string, country string, camera_generation string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def read_bytes(path: str, offset: int = 0, size: int | None = None) -> bytes:
    files, place = opened(path)
    with files.open_input_file(place) as f:
        return f.read_at(f.size() - offset if size is None else size, offset)


def write_bytes(path: str, data: bytes) -> None:
    """Write a file under another name, then rename it."""
    files, place = opened(path)
    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
    temporary = f"{place}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, place)


def _fit(values, width: int) -> list[bytes]:
    return [(v or "").encode()[:width] for v in values]


def pack_poses(rows: dict[str, list]) -> np.ndarray:
    """Records of poses; text is cut to its field's bytes, missing numbers are 0."""
    out = np.zeros(len(rows["location_id"]), dtype=POSE)
    for name in POSE.names:
        kind = POSE[name]
        out[name] = _fit(rows[name], kind.itemsize) if kind.kind == "S" else [v or 0 for v in rows[name]]
    return out


def pose_columns(poses: np.ndarray) -> list[pa.Array]:
    text = lambda raw: raw.split(b"\0", 1)[0].decode("utf-8", "replace")
    return [pa.array([text(x) for x in poses[n].tolist()], pa.string()) if POSE[n].kind == "S" else pa.array(poses[n].astype(np.int64 if n == "location_id" else np.float64)) for n in POSE.names]


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, **more):
        super().__init__((path, start))
        self.path, self.start, self.stop, self.more = path, start, stop, more


def _ranges(path: str, count: int, step: int, **more) -> list[Range]:
    return [Range(path, i, min(count, i + step), **more) for i in range(0, count, step)]


class _Source(DataSource):
    def reader(self, schema):
        return self.kind(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.step = options, int(options.get("rowsPerPartition", ROWS_PER_PARTITION))


class SegmentReader(_Reader):
    """Options: path; lane, to read one; verify, to check every digest and fail on a difference; pushdown, to take filters over.

    The driver reads the registry and the manifests; the files of a segment are checked by the task that reads its first
    records, as a stream, so segments are verified in parallel, each once and only if it is read. Filters on lane and on
    the range of location_id are taken over: the registry's lane and bounds leave out whole segments, whose manifests and
    files stay unopened, and a task looks the ids up first and reads the poses and vectors between the first and last fit.
    Spark (4.1) keeps one read plan for a loaded table, and each filtered scan replaces it, for unfiltered scans as well:
    a table that is read more than once, under different filters or none, is loaded with the option pushdown=false, which
    leaves filters to Spark, or anew for each scan.
    """

    def pushFilters(self, filters):
        if self.options.get("pushdown", "true") != "true":
            yield from filters
            return
        self.lanes, self.low, self.high = None, -(1 << 63), (1 << 63) - 1
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("lane",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(value)
                self.lanes = own if self.lanes is None else self.lanes & own
            elif column == ("location_id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and column in (("lane",), ("location_id",))):  # neither is ever null
                yield f

    lanes, low, high = None, -(1 << 63), (1 << 63) - 1

    def _wanted(self, source: dict) -> bool:
        lane = self.options.get("lane") in (None, source["lane"]) and (self.lanes is None or source["lane"] in self.lanes)
        return lane and source.get("low", self.low) <= self.high and source.get("high", self.high) >= self.low

    def partitions(self):
        root = self.options["path"]
        registry = json.loads(read_bytes(f"{root}/registry.json"))
        if registry.get("version") != 1:
            raise ValueError("unsupported registry version")
        seen, out = set(), []
        for s in registry["sources"]:
            if not s.get("id") or s["id"] in seen:
                raise ValueError("missing or repeated source id")
            seen.add(s["id"])
            folder = f"{root}/{s['path']}"
            if self._wanted(s):
                digests = segment_digests(folder, s) if self.options.get("verify", "true") == "true" else {}
                out += _ranges(folder, s["count"], self.step, lane=s["lane"], id=s["id"], width=s["width"], digests=digests)
        return out

    def read(self, part):
        if part is None:  # Spark's one task of a table without partitions
            return
        for name, digest in part.more["digests"].items() if part.start == 0 else ():
            if streamed_digest(f"{part.path}/{name}.bin") != digest:
                raise ValueError(f"{part.more['id']}: checksum of {name}.bin")
        width = part.more["width"]
        ids = np.frombuffer(read_bytes(f"{part.path}/ids.bin", part.start * 8, (part.stop - part.start) * 8), dtype="<u8").astype(np.int64)
        fit = np.flatnonzero((ids >= self.low) & (ids <= self.high))
        if not len(fit):
            return
        start, n = part.start + int(fit[0]), int(fit[-1] - fit[0]) + 1
        fit = fit - fit[0]
        poses = np.frombuffer(read_bytes(f"{part.path}/poses.bin", start * POSE.itemsize, n * POSE.itemsize), dtype=POSE)[fit]
        vectors, n = read_bytes(f"{part.path}/embeddings.bin", start * width, n * width), len(fit)
        columns = [*pose_columns(poses), pa.array([vectors[i * width : (i + 1) * width] for i in fit.tolist()], pa.binary()), pa.array([part.more["lane"]] * n), pa.array([part.more["id"]] * n)]
        yield pa.RecordBatch.from_arrays(columns, names=[*POSE.names, "embedding", "lane", "segment_id"])


class SealedSegments(_Source):
    kind = SegmentReader

    @classmethod
    def name(cls):
        return "sealed_segments"

    def schema(self):
        return f"{POSE_SCHEMA}, embedding binary, lane string, segment_id string"


class FlatReader(_Reader):
    """Options: path of one shard; lane."""

    def partitions(self):
        path = self.options["path"]
        head = read_bytes(path, 0, 16)
        if head[:8] != FLAT_MAGIC:
            raise ValueError("no flat shard")
        count, width = np.frombuffer(head[8:], dtype="<u4").tolist()
        files, place = opened(path)
        if files.get_file_info(place).size < 16 + count * (POSE.itemsize + width):
            raise ValueError("the shard is cut off")
        return _ranges(path, count, self.step, width=width)

    def read(self, part):
        width = part.more["width"]
        kind = np.dtype([("pose", POSE), ("embedding", f"V{width}")])
        rows = np.frombuffer(read_bytes(part.path, 16 + part.start * kind.itemsize, (part.stop - part.start) * kind.itemsize), dtype=kind)
        columns = [*pose_columns(rows["pose"]), pa.array([bytes(x) for x in rows["embedding"]], pa.binary()), pa.array([self.options.get("lane", "scene")] * len(rows))]
        yield pa.RecordBatch.from_arrays(columns, names=[*POSE.names, "embedding", "lane"])


class FlatShard(_Source):
    kind = FlatReader

    @classmethod
    def name(cls):
        return "flat_shard"

    def schema(self):
        return f"{POSE_SCHEMA}, embedding binary, lane string"


def four_view_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scales n x 4, vectors n x 4 x 768, valid n) of records; a record is valid if its scales are positive and finite."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, VIEWS, VIEW_BYTES)
    scales = raw[:, :, :2].copy().view("<f2")[:, :, 0].astype(np.float32)
    return scales, raw[:, :, 2:].view(np.int8), (np.isfinite(scales) & (scales > 0) & ~np.signbit(scales)).all(axis=1)


class FourViewReader(_Reader):
    def partitions(self):
        files, place = opened(self.options["path"])
        size = files.get_file_info(place).size
        if size % FOUR_VIEW_BYTES:
            raise ValueError("the file is no whole number of records")
        return _ranges(self.options["path"], size // FOUR_VIEW_BYTES, self.step)

    def read(self, part):
        for start in range(part.start, part.stop, 4096):
            n = min(part.stop, start + 4096) - start
            data = read_bytes(part.path, start * FOUR_VIEW_BYTES, n * FOUR_VIEW_BYTES)
            scales, _, valid = four_view_arrays(data)
            columns = [pa.array(np.arange(start, start + n)), pa.array([data[i * FOUR_VIEW_BYTES : (i + 1) * FOUR_VIEW_BYTES] for i in range(n)], pa.binary()), pa.array(scales.tolist(), pa.list_(pa.float32())), pa.array(valid)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_index", "record", "scales", "valid"])


class FourView(_Source):
    kind = FourViewReader

    @classmethod
    def name(cls):
        return "four_view"

    def schema(self):
        return "row_index long, record binary, scales array<float>, valid boolean"


class ArrowReader(_Reader):
    """Options: path of an Arrow file; metadata, its parallel byte file. One partition per record batch."""

    def partitions(self):
        files, place = opened(self.options["path"])
        with files.open_input_file(place) as f:
            reader = pa.ipc.open_file(f)
            sizes = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
        side, where = opened(self.options["metadata"])
        if side.get_file_info(where).size < sum(sizes):
            raise ValueError("the metadata is shorter than the table")
        starts = np.cumsum([0, *sizes]).tolist()
        return [Range(self.options["path"], s, s + n, batch=i) for i, (s, n) in enumerate(zip(starts, sizes, strict=False))]

    def read(self, part):
        files, place = opened(part.path)
        with files.open_input_file(place) as f:
            batch = pa.ipc.open_file(f).get_batch(part.more["batch"])
        flags = np.frombuffer(read_bytes(self.options["metadata"], part.start, part.stop - part.start), dtype=np.uint8).astype(np.int32)
        kinds = {"id": pa.int64(), "pano_id": pa.string(), "tags": pa.list_(pa.int32())}
        names = ("id", "lat", "lng", "heading", "pitch", "zoom", "pano_id", "tags")
        yield pa.RecordBatch.from_arrays([*(batch.column(n).cast(kinds.get(n, pa.float64())) for n in names), pa.array(flags), pa.array(np.arange(part.start, part.stop))], names=[*names, "flags", "row_index"])


class ArrowCatalog(_Source):
    kind = ArrowReader

    @classmethod
    def name(cls):
        return "arrow_catalog"

    def schema(self):
        return "id long, lat double, lng double, heading double, pitch double, zoom double, pano_id string, tags array<int>, flags int, row_index long"


def street_rows(rows: DataFrame, pano: str = "pano_id", limit: int | None = None) -> DataFrame:
    """Catalogue rows with a panorama id that is neither blank nor a URL, all or the first limit; row_index still counts the others."""
    p = F.trim(F.coalesce(pano, F.lit("")))
    kept = rows.where((p != "") & ~p.startswith("http") & ~p.contains("maps.googleapis.com"))
    return kept if limit is None else kept.orderBy("row_index").limit(limit)


def register(spark: SparkSession) -> None:
    """Makes the sources known. Spark hands filters to a Python source only if the session allows it, so this allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SealedSegments, FlatShard, FourView, ArrowCatalog):
        spark.dataSource.register(source)


def streamed_digest(path: str, step: int = 8 << 20) -> str:
    """SHA-256 of a file, read piece by piece."""
    files, place = opened(path)
    digest = hashlib.sha256()
    with files.open_input_stream(place) as f:
        while piece := f.read(step):
            digest.update(piece)
    return digest.hexdigest()


def segment_digests(folder: str, source: dict) -> dict[str, str]:
    """The digests of a segment's files, from its manifest, which has to fit the registry."""
    text = read_bytes(f"{folder}/segment.json")
    manifest = json.loads(text)
    if hashlib.sha256(text).hexdigest() != source["sha256"] or manifest["id"] != source["id"]:
        raise ValueError(f"{source['id']}: the manifest doesn't fit the registry")
    return {name: manifest[f"{name}Sha256"] for name in ("embeddings", "ids", "poses")}


def publish_segments(rows: DataFrame, root: str, lane: str, width: int, capacity: int = CAPACITY) -> list[dict]:
    """Write rows (pose columns and embedding) as segments of at most capacity rows and add them to the registry.

    Repeated ids and ids that any segment has are refused. Tasks write whole folders; the registry names them last, in one
    rename, so readers see all segments or none.
    """
    spark = rows.sparkSession
    register(spark)
    files, place = opened(f"{root}/registry.json")
    old = json.loads(read_bytes(f"{root}/registry.json")) if files.get_file_info(place).type != pafs.FileType.NotFound else {"version": 1, "sources": []}
    total, distinct, bad = rows.agg(F.count("*"), F.countDistinct("location_id"), F.count_if(F.length("embedding") != width)).first()
    if total != distinct or bad or lane not in ("scene", "object"):
        raise ValueError("repeated ids, a wrong vector length or an unknown lane")
    if old["sources"]:
        there = spark.read.format("sealed_segments").option("path", root).option("verify", "false").load().select("location_id")
        if not rows.join(there, "location_id", "left_semi").isEmpty():
            raise ValueError("an id is already published")

    def write(batches):
        pending: list[pa.RecordBatch] = []
        size = 0

        def flush(table):
            name = f"{lane}-{uuid.uuid4().hex}"
            poses = pack_poses({c: table.column(c).to_pylist() for c in POSE.names})
            data = {"embeddings": b"".join(table.column("embedding").to_pylist()), "ids": poses["location_id"].tobytes(), "poses": poses.tobytes()}
            for part, raw in data.items():
                write_bytes(f"{root}/{name}/{part}.bin", raw)
            text = json.dumps({"id": name, "lane": lane, "count": len(poses)} | {f"{p}Sha256": hashlib.sha256(d).hexdigest() for p, d in data.items()}, sort_keys=True).encode()
            write_bytes(f"{root}/{name}/segment.json", text)
            ids = poses["location_id"].astype(np.int64)
            return pa.RecordBatch.from_pydict({"id": [name], "count": [len(poses)], "sha256": [hashlib.sha256(text).hexdigest()], "low": [int(ids.min())], "high": [int(ids.max())]})

        for batch in batches:
            pending.append(batch)
            size += batch.num_rows
            while size >= capacity:
                table = pa.Table.from_batches(pending)
                yield flush(table.slice(0, capacity))
                pending, size = table.slice(capacity).to_batches(), size - capacity
        if size:
            yield flush(pa.Table.from_batches(pending))

    ordered = rows.select(*POSE.names, "embedding").repartitionByRange(-(-max(1, total) // capacity), "location_id").sortWithinPartitions("location_id")
    done = [r.asDict() | {"path": r.id, "lane": lane, "width": width} for r in ordered.mapInArrow(write, "id string, count long, sha256 string, low long, high long").collect()]  # a row per segment
    write_bytes(f"{root}/registry.json", json.dumps({"version": 1, "sources": [*old["sources"], *sorted(done, key=lambda s: s["id"])]}).encode())
    return done


def write_flat_shards(rows: DataFrame, path: str, width: int, capacity: int = CAPACITY, index: str = "row_index") -> DataFrame:
    """Write rows (pose columns and embedding), by a dense index, as flat shards of at most capacity rows: (file, rows).

    A task takes whole shards and holds one. A vector of another width is an error.
    """

    def write(batches):
        shard, size, parts = None, 0, []

        def done():
            if size:
                name = f"shard-{shard:06d}.bin"
                write_bytes(f"{path}/{name}", FLAT_MAGIC + np.array([size, width], dtype="<u4").tobytes() + b"".join(parts))
                yield pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([size], pa.int64())})

        for batch in batches:
            poses = pack_poses({n: batch.column(n).to_pylist() for n in POSE.names})
            for number, pose, vector in zip(batch.column("_shard").to_pylist(), poses, batch.column("embedding").to_pylist(), strict=True):
                if len(vector) != width:
                    raise ValueError("a vector of another width")
                if number != shard:
                    yield from done()
                    shard, size, parts = number, 0, []
                parts.append(pose.tobytes() + vector)
                size += 1
        yield from done()

    placed = rows.select(F.floor(F.col(index) / capacity).alias("_shard"), F.col(index).alias("_at"), *POSE.names, "embedding")
    return placed.repartition("_shard").sortWithinPartitions("_shard", "_at").mapInArrow(write, "file string, rows long")


def byte_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differing locations, views, scales and bytes of two four-view tables, by row_index."""
    both = left.select("row_index", F.col("record").alias("a")).join(right.select("row_index", F.col("record").alias("b")), "row_index", "full_outer")

    def count(batches):
        for batch in batches:
            a, b = ([x or b"" for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            if any(len(x) != FOUR_VIEW_BYTES for x in (*a, *b)):
                raise ValueError("incomparable files")
            d = (np.frombuffer(b"".join(a), np.uint8) != np.frombuffer(b"".join(b), np.uint8)).reshape(-1, VIEWS, VIEW_BYTES)
            yield pa.RecordBatch.from_pydict({"locations": [int(d.any(axis=(1, 2)).sum())], "views": [int(d.any(axis=2).sum())], "scales": [int(d[:, :, :2].any(axis=2).sum())], "bytes": [int(d.sum())]})

    parts = both.select("a", "b").mapInArrow(count, "locations long, views long, scales long, bytes long")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("locations", "views", "scales", "bytes")])
