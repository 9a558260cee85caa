"""Shards of a fixed number of records that a job or a stream fills, behind a registry.

Tasks write finished files under names of their own; what a reader sees is the registry, which is replaced by one rename
after all tasks of a job or micro-batch have ended. A failed job deletes what its tasks report; what a lost task leaves
behind is not in the registry, so it is never read.

A stream goes on filling: the records of a task that fill no whole shard are an open piece of its partition, which that
partition's task of the next micro-batch takes up again. So every sealed shard is full, whatever the size of the
micro-batches, and a task rewrites less than one shard. A micro-batch that is run again after it was registered adds
nothing. close_shards() seals what is open as short shards and reports the rows.

Kinds: lines (a column line; text lines) and flat (pose columns and embedding; a header and fixed-width records).
Options: path, kind, rowsPerShard, width (flat), and key: rows written under a key replace those of the same key.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, WriterCommitMessage

from tessera.sources.records import CAPACITY, FLAT_MAGIC, POSE, POSE_SCHEMA, Range, opened, pack_poses, pose_columns, read_bytes, write_bytes

REGISTRY = "shards.json"
HEAD = 16


def registry_of(path: str) -> dict:
    files, place = opened(f"{path}/{REGISTRY}")
    there = files.get_file_info(place).type != pafs.FileType.NotFound
    return json.loads(read_bytes(f"{path}/{REGISTRY}")) if there else {"version": 1, "batch": -1, "shards": [], "open": []}


def _delete(path: str, names: list[str]) -> None:
    for name in names:
        files, place = opened(f"{path}/{name}")
        if files.get_file_info(place).type != pafs.FileType.NotFound:
            files.delete_file(place)


class Kind:
    """How records are laid out in a file."""

    def __init__(self, options):
        self.flat, self.width = options.get("kind", "lines") == "flat", int(options.get("width", 0))
        self.size = POSE.itemsize + self.width

    def records(self, batch: pa.RecordBatch) -> list[bytes]:
        if not self.flat:
            lines = [(x or "").encode() for x in batch.column("line").to_pylist()]
            if any(b"\n" in x for x in lines):
                raise ValueError("a line with a line break")
            return [x + b"\n" for x in lines]
        poses = pack_poses({c: batch.column(c).to_pylist() for c in POSE.names})
        vectors = batch.column("embedding").to_pylist()
        if any(v is None or len(v) != self.width for v in vectors):
            raise ValueError("a vector of another width")
        return [p.tobytes() + v for p, v in zip(poses, vectors, strict=True)]

    def file(self, records: list[bytes]) -> bytes:
        head = FLAT_MAGIC + np.array([len(records), self.width], dtype="<u4").tobytes() if self.flat else b""
        return head + b"".join(records)

    def parsed(self, data: bytes) -> list[bytes]:
        """The records of a file."""
        if not self.flat:
            return data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]]
        return [data[i : i + self.size] for i in range(HEAD, len(data), self.size)]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    shards: list
    open: dict | None


class _Writer:
    def __init__(self, options):
        self.options, self.path, self.kind = options, options["path"].rstrip("/"), Kind(options)
        self.rows, self.key = int(options.get("rowsPerShard", CAPACITY)), options.get("key")

    def _put(self, records: list[bytes]) -> dict:
        data, name = self.kind.file(records), f"shard-{uuid.uuid4().hex}.{'bin' if self.kind.flat else 'tsv'}"
        write_bytes(f"{self.path}/{name}", data)
        return {"file": name, "rows": len(records), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "key": self.key}

    def _fill(self, batches: Iterator[pa.RecordBatch], pending: list[bytes]) -> tuple[list[dict], list[bytes]]:
        done: list[dict] = []
        try:
            for batch in batches:
                pending += self.kind.records(batch)
                while len(pending) >= self.rows:
                    done.append(self._put(pending[: self.rows]))
                    pending = pending[self.rows :]
        except BaseException:
            _delete(self.path, [s["file"] for s in done])
            raise
        return done, pending

    def _register(self, registry: dict) -> None:
        write_bytes(f"{self.path}/{REGISTRY}", json.dumps(registry, sort_keys=True).encode())

    def _discard(self, messages) -> None:
        _delete(self.path, [s["file"] for m in messages if m for s in (*m.shards, *([m.open] if m.open else []))])


def _in_order(messages) -> list[Written]:
    return sorted((m for m in messages if m), key=lambda m: m.partition)


class ShardWriter(_Writer, DataSourceArrowWriter):
    """A job: the last shard of a task may be short."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def write(self, iterator):
        done, rest = self._fill(iterator, [])
        return Written(TaskContext.get().partitionId(), [*done, *([self._put(rest)] if rest else [])], None)

    def commit(self, messages):
        registry = registry_of(self.path)
        gone = [s for s in registry["shards"] if self.overwrite or self.key is not None and s["key"] == self.key]
        kept = [s for s in registry["shards"] if s not in gone]
        self._register(registry | {"shards": [*kept, *(s for m in _in_order(messages) for s in m.shards)]} | ({"open": []} if self.overwrite else {}))
        _delete(self.path, [s["file"] for s in gone])

    def abort(self, messages):
        self._discard(messages)


class ShardStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def write(self, iterator):
        number = TaskContext.get().partitionId()
        pending = [r for s in registry_of(self.path)["open"] if s["partition"] == number for r in self.kind.parsed(read_bytes(f"{self.path}/{s['file']}"))]
        done, rest = self._fill(iterator, pending)
        return Written(number, done, self._put(rest) | {"partition": number} if rest else None)

    def commit(self, messages, batchId):
        registry = registry_of(self.path)
        if batchId <= registry["batch"]:
            self._discard(messages)
            return
        mine = {m.partition for m in messages if m}
        gone = [s for s in registry["open"] if s["partition"] in mine]
        left = [s for s in registry["open"] if s["partition"] not in mine]
        parts = _in_order(messages)
        self._register(registry | {"batch": batchId, "shards": [*registry["shards"], *(s for m in parts for s in m.shards)], "open": [*left, *(m.open for m in parts if m.open)]})
        _delete(self.path, [s["file"] for s in gone])

    def abort(self, messages, batchId):
        self._discard(messages)


def close_shards(path: str) -> dict:
    """Seal the open pieces as short shards; (shards, full, rows, bytes) of all."""
    registry = registry_of(path)
    shards = [*registry["shards"], *({k: v for k, v in s.items() if k != "partition"} for s in registry["open"])]
    write_bytes(f"{path}/{REGISTRY}", json.dumps(registry | {"shards": shards, "open": []}, sort_keys=True).encode())
    return {"shards": len(shards), "full": len(registry["shards"]), "rows": sum(s["rows"] for s in shards), "bytes": sum(s["bytes"] for s in shards)}


class ShardReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.path, self.kind = options, options["path"].rstrip("/"), Kind(options)

    def partitions(self):
        wanted = self.options.get("key")
        return [Range(s["file"], 0, s["rows"], number=i, sha256=s["sha256"]) for i, s in enumerate(registry_of(self.path)["shards"]) if wanted in (None, s["key"])] or [Range("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        data = read_bytes(f"{self.path}/{part.path}")
        if hashlib.sha256(data).hexdigest() != part.more["sha256"]:
            raise ValueError(f"{part.path}: checksum")
        n = part.stop
        ends = [pa.array([part.more["number"]] * n, pa.int64()), pa.array(np.arange(n))]
        if not self.kind.flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1].decode() for x in self.kind.parsed(data)], pa.string()), *ends], names=["line", "shard", "row"])
            return
        rows = np.frombuffer(data, dtype=np.dtype([("pose", POSE), ("embedding", f"V{self.kind.width}")]), offset=HEAD)
        yield pa.RecordBatch.from_arrays([*pose_columns(rows["pose"]), pa.array([bytes(x) for x in rows["embedding"]], pa.binary()), *ends], names=[*POSE.names, "embedding", "shard", "row"])


class RecordShards(DataSource):
    @classmethod
    def name(cls):
        return "record_shards"

    def schema(self):
        return f"{POSE_SCHEMA + ', embedding binary' if Kind(self.options).flat else 'line string'}, shard long, row long"

    def reader(self, schema):
        return ShardReader(self.options)

    def writer(self, schema, overwrite):
        return ShardWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return ShardStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordShards)
