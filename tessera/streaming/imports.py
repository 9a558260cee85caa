"""Imports of location shards that can be stopped anywhere and started again.

A stream lists files, which are imported in batches of a bounded number of files, in the order in which they came. A
micro-batch of the stream is a step of many batches: one job reads their digests (SHA-256), one writes their jobs, and then
each batch is recorded, in order. A step that is run again after a failure or a stop has the same files; batches that
have been recorded stay as they are, the others follow. Rows of files that the registry doesn't name are not read by anyone.

A step looks at nothing that earlier ones have written, so its cost does not grow with the import. Who reads the tables
leaves out files whose bytes an earlier batch has recorded, and jobs whose identity has come before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalog import IDENTITY, first_wins, with_prefix
from tessera.sources import byte_lines
from tessera.sources.records import opened, read_bytes, streamed_digest, write_bytes

#: Fixed value: jobs that are inserted together.
BATCH_JOBS = 500
#: Batches that a step begins with at most; a batch's number is its step's number times STEP, and its place in the step.
STEP_BATCHES, STEP = 256, 1 << 32
JOBS = "asset_id string, capture string, lane string, model string, lat double, lon double, country string"
_PLACED = f"{JOBS}, shard string, start long"
_FILES = "sha256 string, shard string"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def file_digests(files: DataFrame) -> DataFrame:
    """files (path and more) with sha256; tasks read the files as streams."""

    def digest(batches):
        for batch in batches:
            digests = pa.array([streamed_digest(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, "sha256"])

    return files.mapInArrow(digest, files.withColumn("sha256", F.lit("")).schema)


def jobs_of_lines(lines: DataFrame, lane: str, model: str) -> DataFrame:
    """Jobs of 9- or 11-column lines (shard, start, line), with their place (shard, start)."""
    c = F.split("line", "\t", -1)
    rows = lines.where(F.size(c).isin(9, 11)).select("shard", "start", c.alias("c"))
    number = lambda i: F.expr(f"try_cast(c[{i}] AS DOUBLE)")
    out = rows.select("shard", "start", F.col("c")[7].alias("asset_id"), F.lit("unknown").alias("capture"), F.lit(lane).alias("lane"), F.lit(model).alias("model"), number(2).alias("lat"), number(3).alias("lon"), F.col("c")[8].alias("country"))
    return out.where("asset_id <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


class Import:
    """The tables of one import: jobs and recorded files, below path."""

    def __init__(self, spark: SparkSession, path: str, lane: str = "scene", model: str = "visual-v1"):
        self.spark, self.path, self.lane, self.model = spark, path, lane, model

    def _read(self, name: str, kind: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(schema).option("pathGlobFilter", f"*.{kind}").format(kind).load(where) if there else self.spark.createDataFrame([], schema)

    def _recorded(self) -> DataFrame:
        """(sha256, batch, shard): the first file of each content that the registry has."""
        first = self._read("files", "json", f"{_FILES}, batch long").groupBy("sha256").agg(F.min(F.struct("batch", "shard")).alias("f"))
        return first.select("sha256", "f.batch", "f.shard")

    def files(self) -> DataFrame:
        """Recorded files: (sha256, name, jobs, batch)."""
        counts = self.jobs().groupBy("batch", "shard").agg(F.count("*").alias("jobs"))
        out = self._recorded().join(counts, ["batch", "shard"], "left")
        return out.select("sha256", F.element_at(F.split("shard", "/"), -1).alias("name"), F.coalesce("jobs", F.lit(0)).alias("jobs"), "batch")

    def jobs(self) -> DataFrame:
        """Imported jobs with their batch and shard, the first of each identity; files that the registry doesn't have are left out."""
        recorded = self._recorded().select("batch", "shard", F.expr(f"batch div {STEP}").alias("step"))
        rows = self._read("jobs", "parquet", f"{_PLACED}, step long").join(recorded, ["step", "shard"]).drop("step")
        return first_wins(rows.withColumn("position", F.struct("batch", "shard", "start"))).select("batch", *_names(JOBS), "shard")

    def _place(self, number: int) -> str:
        return f"{self.path}/files/batch={number}/files.json"

    def take(self, listed: list[Row], number: int) -> None:
        """Records one batch of files (path, sha256) whose jobs have been written; it is there whole or not at all."""
        write_bytes(self._place(number), "".join(json.dumps({"sha256": r.sha256, "shard": r.path}) + "\n" for r in listed).encode())

    def _taken(self, step: int) -> list[list[str]]:
        """Paths of the batches of a step that have been recorded; they are recorded in their order."""
        out, system = [], opened(self.path)[0]
        while system.get_file_info(opened(self._place(step * STEP + len(out)))[1]).is_file:
            out.append([json.loads(x)["shard"] for x in read_bytes(self._place(step * STEP + len(out))).splitlines()])
        return out

    def batches(self, listed: DataFrame, step: int, files_per_batch: int) -> Iterator[tuple[int, list[Row]]]:
        """The batches of a step of files (path, at, length) that are to be recorded, by number; their jobs are written before the first of them comes."""
        files = sorted(file_digests(listed).collect(), key=lambda r: (r.at, r.path))  # as many as a step takes
        taken = self._taken(step)
        if not taken:  # else the rows of the step are whole
            rows = jobs_of_lines(byte_lines.lines_of(self.spark, {r.path: r.length for r in files}), self.lane, self.model)
            rows.select(*_names(_PLACED)).write.mode("overwrite").parquet(f"{self.path}/jobs/step={step}")
        known = {p for paths in taken for p in paths}
        rest = [r for r in files if r.path not in known]
        for i in range(0, len(rest), files_per_batch):
            yield step * STEP + len(taken) + i // files_per_batch, rest[i : i + files_per_batch]

    def run(self, folder: str, files_per_batch: int = 100, batches: int | None = None) -> int:
        """Import what lies in folder and hasn't been; stop after so many batches if batches says so. Gives the number of batches run."""
        ran = 0
        most = files_per_batch * (STEP_BATCHES if batches is None else max(1, min(STEP_BATCHES, batches)))
        files = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most).option("recursiveFileLookup", "true").load(folder)
        listing = files.select("path", F.unix_micros("modificationTime").alias("at"), "length")

        def ended() -> None:
            if batches is not None and ran >= batches:
                raise StopImport

        def step(listed: DataFrame, number: int) -> None:
            nonlocal ran
            ended()
            for own, files in self.batches(listed, number, files_per_batch):
                ended()
                self.take(files, own)
                ran += 1

        query = listing.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if batches is None or ran < batches:
                raise
        return ran


class StopImport(Exception):
    """Ends a bounded run before its next batch is recorded; the log takes its step up again."""


def limited(jobs: DataFrame, table: DataFrame, limit: int, order: str = "position", batch: int = BATCH_JOBS) -> DataFrame:
    """The new rows of one file's jobs under the limit rule of an import.

    Jobs are inserted by batches in their order; only identities that table lacks count. No full batch begins once limit
    rows have been inserted, so the last full one may go beyond it; the rest of the file that fills no batch is cut to
    what is left of the limit, copies included, before its new rows are taken.
    """
    placed = with_prefix(jobs, [F.col(order)], "sum", F.lit(1), "_k")
    known = table.select(*IDENTITY).distinct().withColumn("_known", F.lit(True))
    first = placed.groupBy(*IDENTITY).agg(F.min("_k").alias("_first"))
    fresh = first.join(known, list(IDENTITY), "left").where("_known IS NULL").select("_first")
    per_batch = fresh.groupBy(F.floor(F.col("_first") / batch).alias("_batch")).agg(F.count("*").alias("_new"))
    batches = placed.groupBy(F.floor(F.col("_k") / batch).alias("_batch")).agg(F.count("*").alias("_size")).join(per_batch, "_batch", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    before = with_prefix(batches, [F.col("_batch")], "sum", F.col("_new"), "_earlier")
    begins = before.where((F.col("_earlier") < limit) | (F.col("_batch") == 0) & (F.col("_size") == batch))
    room = F.when(F.col("_size") == batch, batch).otherwise(limit - F.col("_earlier"))
    taken = placed.withColumn("_batch", F.floor(F.col("_k") / batch)).join(begins.select("_batch", room.alias("_room")), "_batch").where(F.col("_k") - F.col("_batch") * batch < F.col("_room"))
    return taken.join(fresh, F.col("_k") == F.col("_first"), "left_semi").select(*jobs.columns)
