"""Lines of text shards by byte ranges, as a table and as a stream whose offsets are bytes per shard.

A shard is a file; only lines that end in a line break count, so a line that is still being written waits for the next
start. A large shard is read by many tasks: a task reads the lines whose first byte is in its range. Offsets are stored by
the stream's own log, so a second start goes on at the byte where the first one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.records import opened

BLOCK = 4 << 20
RANGE_BYTES = 64 << 20
#: Tasks that the ranges are dealt to at most, and files whose ends are looked for at once.
MOST_TASKS, LOOKED_AT = 256, 16
SCHEMA = "shard string, start long, stop long, line string"
_TYPES = pa.schema([("shard", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("line", pa.string())])


class ByteRange(InputPartition):
    def __init__(self, shard: str, start: int, stop: int):
        super().__init__((shard, start))
        self.shard, self.start, self.stop = shard, start, stop


class ByteRanges(InputPartition):
    """Neighbouring ranges that one task reads."""

    def __init__(self, parts: list[ByteRange]):
        super().__init__((parts[0].shard, parts[0].start))
        self.parts = parts


def dealt(ranges: list[ByteRange], tasks: int = 0) -> list[ByteRanges]:
    """Ranges by task: one each, and where there are more of them than tasks neighbours share one."""
    each = -(-len(ranges) // (tasks or MOST_TASKS)) or 1
    return [ByteRanges(ranges[i : i + each]) for i in range(0, len(ranges), each)]


def shards_of(path: str, pattern: str = "") -> dict[str, int]:
    """Name and size of the files below path, hidden ones left out; pattern is an ending."""
    files, place = opened(path)
    info = files.get_file_info(place)
    if info.type == pafs.FileType.File:
        return {"": info.size}
    found = files.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=True))
    names = {f.path[len(place) :].lstrip("/"): f.size for f in found if f.type == pafs.FileType.File}
    return {n: size for n, size in sorted(names.items()) if n.endswith(pattern) and not any(p[:1] in "._" for p in n.split("/"))}


def joined(path: str, shard: str) -> str:
    return f"{path.rstrip('/')}/{shard}" if shard else path


def last_line_end(path: str, size: int, least: int = 0, block: int = 1 << 16) -> int:
    """The byte after the last line break before size, or least; read backwards, block by block."""
    files, place = opened(path)
    with files.open_input_file(place) as f:
        stop = size
        while stop > least:
            start = max(least, stop - block)
            at = f.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return least


def tail_range(path: str, tail: int, skip_last: int = 0, block: int = 1 << 16) -> tuple[int, int, int]:
    """(start, stop, bytes read) of a file's last tail whole lines without the last skip_last ones, read backwards from its end."""
    files, place = opened(path)
    with files.open_input_file(place) as f:
        ends: list[int] = []  # bytes after line breaks, the last first
        at, read = f.size(), 0
        while at and len(ends) <= tail:
            start = max(0, at - block)
            found = np.flatnonzero(np.frombuffer(f.read_at(at - start, start), np.uint8) == 0x0A)
            ends += (found[::-1] + start + 1).tolist()
            at, read = start, read + at - start
    ends.append(0)
    return ends[min(max(tail, skip_last), len(ends) - 1)], ends[min(skip_last, len(ends) - 1)], read


def lines_between(path: str, start: int, stop: int, block: int = BLOCK) -> Iterator[list[tuple[int, int, bytes]]]:
    """(first byte, byte after the line break, line) of the whole lines whose first byte is from start to stop."""
    files, place = opened(path)
    with files.open_input_file(place) as f:
        at = max(0, start - 1)  # the byte before may be the line break that a line of this range follows
        f.seek(at)
        inside, open_ = start > 0, []
        while data := f.read(block):
            first, *rest = data.split(b"\n")
            if not rest:
                open_.append(first)
                continue
            pieces = [b"".join([*open_, first]), *rest]
            open_ = [pieces.pop()]
            out = []
            for piece in pieces:
                end = at + len(piece) + 1
                if inside:
                    inside = False
                elif at >= stop:
                    break
                else:
                    out.append((at, end, piece))
                at = end
            if out:
                yield out
            if at >= stop:
                return


def _batches(path: str, shard: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    for rows in lines_between(path, start, stop):
        starts, stops, lines = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows)), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines])], schema=_TYPES)


def lines_of(spark: SparkSession, sizes: dict[str, int], step: int = RANGE_BYTES) -> DataFrame:
    """The whole lines of files that the caller has listed, by path and size; shard is the path. Small files share a task, a large one is read by many."""
    ranges = [(p, i, min(size, i + step)) for p, size in sorted(sizes.items()) for i in range(0, size, step)]
    tasks = min(MOST_TASKS, len(ranges), max(spark.sparkContext.defaultParallelism, sum(sizes.values()) // BLOCK)) or 1

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _batches(r["shard"], r["shard"], r["start"], r["stop"])

    return spark.createDataFrame(ranges, "shard string, start long, stop long").repartition(tasks).mapInArrow(read, SCHEMA)


class _Options:
    def __init__(self, options):
        self.options, self.path, self.pattern, self.step = options, options["path"], options.get("endsWith", ""), int(options.get("bytesPerPartition", RANGE_BYTES))

    def ranges(self, start: dict, end: dict) -> list[ByteRange]:
        return [ByteRange(s, i, min(stop, i + self.step)) for s, stop in sorted(end.items()) for i in range(start.get(s, 0), stop, self.step)]

    def batches(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(joined(self.path, part.shard), part.shard, part.start, part.stop)


class ByteLinesReader(_Options, DataSourceReader):
    def partitions(self):
        if "tail" in self.options:
            start, stop, _ = tail_range(self.path, int(self.options["tail"]), int(self.options.get("skipLast", 0)))
            return dealt(self.ranges({"": start}, {"": stop}) or [ByteRange("", 0, 0)])
        return dealt(self.ranges({}, shards_of(self.path, self.pattern)) or [ByteRange("", 0, 0)])

    def read(self, part):
        return (batch for own in part.parts if own.stop for batch in self.batches(own))


class ByteLinesStreamReader(_Options, DataSourceStreamReader):
    """Offsets: the byte after the last whole line, per shard that has one."""

    known: dict[str, tuple[int, int]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        known, self.known = self.known, {}

        def ended(shard: str, size: int) -> tuple[int, int]:
            before, end = known.get(shard, (0, 0))
            return size, end if before == size else last_line_end(joined(self.path, shard), size, end)

        found = shards_of(self.path, self.pattern)
        with ThreadPoolExecutor(LOOKED_AT) as pool:
            self.known = dict(zip(found, pool.map(ended, found.keys(), found.values()), strict=True))
        return {s: end for s, (_, end) in self.known.items() if end}

    def partitions(self, start, end):
        return dealt(self.ranges(start, end))

    def read(self, part):
        return (batch for own in part.parts for batch in self.batches(own))


class ByteLines(DataSource):
    """Options: path (a file or folder), endsWith, bytesPerPartition; tail and skipLast, to read a file's end only."""

    @classmethod
    def name(cls):
        return "byte_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ByteLinesReader(self.options)

    def streamReader(self, schema):
        return ByteLinesStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteLines)
