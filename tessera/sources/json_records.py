"""Records of large JSON documents, read by byte ranges.

A document holds one long array of objects, at the top or under a name of the top object. Where a range begins inside the
text of a record can't be told from its bytes alone, so the work is in two passes over blocks of bytes. The first one gives
per block, for both cases of beginning outside or inside a string, whether its quotes leave a string open and by how much
its brackets change the depth. The driver adds these up, one row of five numbers per block, so every block's state at its
first byte is known. In the second pass each task takes the records whose opening bracket lies in its block, reads on to
the end of the last one, and numbers them by the counts of the blocks before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.byte_lines import shards_of
from tessera.sources.records import opened

BLOCK = 32 << 20
_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
for _c in b"{[":
    _OPEN[_c] = 1
for _c in b"}]":
    _CLOSE[_c] = 1


def read_block(path: str, start: int, size: int) -> tuple[bytes, bool]:
    """Bytes from start on, and whether a run of backslashes before them escapes the first one."""
    files, place = opened(path)
    with files.open_input_file(place) as f:
        data, run, at = f.read_at(size, start), 0, start
        while at:
            before = f.read_at(min(at, 256), at - min(at, 256))
            tail = len(before) - len(before.rstrip(b"\\"))
            run += tail
            if tail < len(before):
                break
            at -= len(before)
    return data, run % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where a quote begins or ends a string: those that an odd run of backslashes doesn't precede."""
    slash = data == 0x5C
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))  # before any other byte: -1
    run = at - last_other  # length of the run of backslashes that ends here
    run = run + (escaped & (last_other == -1))
    before = np.concatenate([[int(escaped)], run[:-1]]) if len(data) else run
    return (data == 0x22) & (before % 2 == 0)


def depths(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte is in a string, depth after it relative to the start); quotes count as in the string."""
    flips = quotes(data, escaped)
    state = (np.cumsum(flips) + inside) % 2 == 1
    step = np.where(state | flips, 0, _OPEN[data] - _CLOSE[data])
    return state | flips, np.cumsum(step, dtype=np.int64)


def summary(path: str, start: int, size: int) -> tuple[bool, int, int, int, int]:
    """(odd number of quotes, change of depth and smallest depth if the block begins outside a string, the same if inside)."""
    raw, escaped = read_block(path, start, size)
    data = np.frombuffer(raw, np.uint8)
    own = [depths(data, escaped, inside)[1] for inside in (False, True)]
    return bool(np.count_nonzero(quotes(data, escaped)) % 2), int(own[0][-1]), int(own[0].min()), int(own[1][-1]), int(own[1].min())


def top_arrays(path: str, start: int, size: int, inside: bool, depth: int) -> list[tuple[int, str, bool]]:
    """(first byte, name, whether it ends here) of the arrays that begin in a block at depth 0 or 1; the top array has no name."""
    raw, escaped = read_block(path, start, size)
    data = np.frombuffer(raw, np.uint8)
    quoted, own = depths(data, escaped, inside)
    out = []
    for i in np.flatnonzero((data == 0x5B) & ~quoted & (own + depth <= 2)).tolist():
        level = depth + int(own[i]) - 1
        ends = bool((own[i:] + depth == level).any())
        if level == 0:
            out.append((start + i, "", ends))
        elif level == 1:
            before = read_block(path, max(0, start + i - 4096), min(4096, start + i))[0].rstrip()
            if before.endswith(b":"):
                before = before[:-1].rstrip()[:-1]
                out.append((start + i, before[before.rfind(b'"') + 1 :].decode("utf-8", "replace"), ends))
    return out


def record_spans(path: str, start: int, size: int, inside: bool, depth: int, begin: int, level: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Places of the objects that begin in a block at level, after the array's bracket at begin, the places after them (0: not in the block), and its bytes."""
    raw, escaped = read_block(path, start, size)
    data = np.frombuffer(raw, np.uint8)
    quoted, own = depths(data, escaped, inside)
    after = own + depth
    closed = np.flatnonzero((data == 0x5D) & ~quoted & (after == level - 1) & (np.arange(len(data)) + start > begin))
    stop = int(closed[0]) if len(closed) else len(data)
    at = np.flatnonzero((data[:stop] == 0x7B) & ~quoted[:stop] & (after[:stop] == level + 1))
    at = at[at + start > begin]
    ends = np.append(np.flatnonzero((data == 0x7D) & ~quoted & (after == level)) + 1, 0)
    return at, ends[np.searchsorted(ends[:-1], at, side="right")], raw


def read_records(spark: SparkSession, path: str, name: str = "", block: int = BLOCK, pattern: str = ".json") -> DataFrame:
    """(document, position, start, record): the objects of the array called name of every document, as JSON text.

    An empty name stands for an array at the top. A document without such an array has no records. The number of blocks,
    not that of records, is what the driver holds.
    """
    places = [(shard, i, size) for shard, size in shards_of(path, pattern if not path.endswith(pattern) else "").items() for i in range(0, size, block)]
    if not places:
        return spark.createDataFrame([], "document string, position long, start long, record string")
    full = lambda shard: f"{path.rstrip('/')}/{shard}" if shard else path

    cores = spark.sparkContext.defaultParallelism
    tasks = lambda rows: min(len(rows), 4096, max(4 * cores, -(-len(rows) * block // BLOCK)))  # noqa: E731  # small blocks share a task

    def per_block(of, schema: str, rows: list, given: str) -> list:
        table = spark.createDataFrame(rows, given).repartition(tasks(rows), "document", "at")
        return table.mapInArrow(of, schema).collect()  # a few numbers per block

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at in zip(batch.column("document").to_pylist(), batch.column("at").to_pylist(), strict=True):
                told = summary(full(shard), at, block)
                yield pa.RecordBatch.from_pydict({"document": [shard], "at": [at]} | {c: [v] for c, v in zip(("odd", "outside", "outside_low", "inside", "inside_low"), told, strict=True)})

    found = {(r.document, r.at): r for r in per_block(passed, "document string, at long, odd boolean, outside long, outside_low long, inside long, inside_low long", [(s, i) for s, i, _ in places], "document string, at long")}
    states, inside, depth = [], False, 0
    for shard, at, _ in places:
        inside, depth = (False, 0) if at == 0 else (inside, depth)
        r = found[shard, at]
        low = min(depth, depth + (r.inside_low if inside else r.outside_low))
        states.append((shard, at, inside, depth, low))
        depth += r.inside if inside else r.outside
        inside ^= r.odd

    def arrays(batches):
        for batch in batches:
            for shard, at, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("document", "at", "inside", "depth")), strict=True):
                for begin, title, ends in top_arrays(full(shard), at, block, inside, depth):
                    yield pa.RecordBatch.from_pydict({"document": [shard], "begin": [begin], "name": [title], "ends": [ends]})

    state_type = "document string, at long, inside boolean, depth int"
    begins: dict[str, tuple[int, bool]] = {}
    shallow = [row[:4] for row in states if row[4] < 2]  # no array at the top begins deeper
    for r in per_block(arrays, "document string, begin long, name string, ends boolean", shallow, state_type):
        if r.name == name:
            begins[r.document] = min((r.begin, r.ends), begins.get(r.document, (r.begin, r.ends)))
    level = 2 if name else 1
    wanted, ended = [], set()
    for shard, at, inside, depth, low in states:
        begin, ends = begins.get(shard, (None, False))
        if begin is None or at + block <= begin or shard in ended:
            continue
        wanted.append((shard, at, inside, depth, begin))
        if ends if at <= begin else low < level:
            ended.add(shard)
    if not wanted:
        return spark.createDataFrame([], "document string, position long, start long, record string")
    wanted_type = f"{state_type}, begin long"

    def counted(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("document", "at", "inside", "depth", "begin")), strict=True):
                yield pa.RecordBatch.from_pydict({"document": [row[0]], "at": [row[1]], "n": [len(record_spans(full(row[0]), row[1], block, *row[2:], level)[0])]})

    counts = {(r.document, r.at): r.n for r in per_block(counted, "document string, at long, n long", wanted, wanted_type)}
    placed, first = [], {}
    for row in wanted:
        placed.append((*row, first.get(row[0], 0)))
        first[row[0]] = first.get(row[0], 0) + counts[row[0], row[1]]

    def records(batches):
        for batch in batches:
            for shard, at, inside, depth, begin, position in zip(*(batch.column(c).to_pylist() for c in ("document", "at", "inside", "depth", "begin", "first")), strict=True):
                starts, stops, raw = record_spans(full(shard), at, block, inside, depth, begin, level)
                texts = [raw[i:j].decode("utf-8", "replace") if j else record_at(full(shard), raw, at, i) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                for k in range(0, len(texts), 2000):
                    own = texts[k : k + 2000]
                    columns = [pa.array([shard] * len(own)), pa.array(range(position + k, position + k + len(own)), pa.int64()), pa.array((starts[k : k + 2000] + at).astype(np.int64)), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(columns, names=["document", "position", "start", "record"])

    table = spark.createDataFrame(placed, f"{wanted_type}, first long").repartition(tasks(placed), "document", "at")
    return table.mapInArrow(records, "document string, position long, start long, record string")


def record_at(path: str, raw: bytes, start: int, i: int, more: int = 1 << 20) -> str:
    """The object that begins at place i of a block, read on beyond the block as far as it goes."""
    window, size = raw[i:], 4096
    while True:
        part = np.frombuffer(window[:size], np.uint8)
        quoted, own = depths(part, False, False)
        ends = np.flatnonzero((own == 0) & ~quoted & (_CLOSE[part] == 1))
        if len(ends):
            return window[: int(ends[0]) + 1].decode("utf-8", "replace")
        if size < len(window):
            size *= 4
            continue
        extra = read_block(path, start + i + len(window), more)[0]
        if not extra:
            raise ValueError("the document ends within a record")
        window, size, more = window + extra, size * 4, more * 2


def parsed(records: DataFrame, schema: str) -> DataFrame:
    """document, position and the fields of the records."""
    return records.select("document", "position", F.from_json("record", schema).alias("r")).select("document", "position", "r.*")
