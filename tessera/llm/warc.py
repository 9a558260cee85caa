"""WARC archives, one dictionary-compressed .warc.zst file per part.

The writer gives each page a record; of pages with byte-equal payloads of at least ``min_revisit`` bytes the one with
the smallest id is a response and the others are revisits without a body. Each task writes its own archives of at most
``archive_bytes`` of records: it builds a Zstandard dictionary from records of that archive, embeds it in a leading
skippable frame (magic 0x184D2A5D, as the .warc.zst convention has it) and compresses every record as a frame of its own,
so that a reader can seek to any record. A file is written under a name of its attempt and then renamed; a manifest of
finished files is stored beside them, and the reader takes only what the manifest names, so retried and lost tasks leave
nothing behind that would be read.

Null payloads are empty, null urls an empty target. A page without an id is a response whose record id is empty and reads
back as null; a page that stands twice is archived twice, in the role of its id. Other columns are not archived.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import urllib.parse
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batched, new_path, read_table

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 64 << 10
#: Bytes of records that a dictionary is built from.
SAMPLE_BYTES = 4 << 20
DICT_MAGIC = 0x184D2A5D
LEVEL = 5
#: Parts that the copies of a payload are dealt into.
SALTS = 32

_MANIFEST = "path string, records long, bytes long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Distinct (id, digest, refers_to): the page whose record the pages of that id and payload revisit. Others have no row.

    A payload's copies are dealt out by their ids, so that one that a third of all pages share fills no single task.
    """
    body = F.encode(F.coalesce(payload_col, F.lit("")), "utf-8")
    narrow = pages.select(F.col(id_col).alias("_id"), F.length(body).alias("_n"), F.sha2(body, 256).alias("_sha"), F.pmod(F.xxhash64(id_col), F.lit(SALTS).cast("long")).alias("_salt"))
    long = narrow.where(F.col("_n") >= min_revisit).drop("_n")
    first = long.groupBy("_sha").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return long.join(first, ["_sha", "_salt"]).where(F.col("_id") != F.col("_first")).select("_id", "_sha", F.col("_first").alias("refers_to")).distinct()


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes], limit: int = DICT_BYTES) -> bytes:
    """A trained Zstandard dictionary, or the start of the records as raw content where too few can be trained on."""
    samples, total = [], 0
    for r in records[:: 1 + sum(map(len, records)) // SAMPLE_BYTES]:
        samples.append(r[: 8 * limit])
        total += len(samples[-1])
    try:
        return zstandard.train_dictionary(min(limit, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:limit]


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    trained = dictionary(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    packed = zstandard.ZstdCompressor(level=19).compress(trained)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(packed)), packed, *map(packer.compress, records)])


_HEAD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def read_archive(data: bytes):
    """Yields (headers, body) of each record."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    with unpacker.stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True) as stream:
        rest = bytearray()
        while True:
            end = rest.find(b"\r\n\r\n")
            while end < 0:
                more = stream.read(1 << 20)
                if not more:
                    if rest:
                        raise ValueError("a record is cut off")
                    return
                rest += more
                end = rest.find(b"\r\n\r\n")
            if not rest.startswith(b"WARC/1.1\r\n"):
                raise ValueError("no WARC record")
            head = {k.decode(): v.decode() for k, v in _HEAD.findall(bytes(rest[10 : end + 2]))}
            n = int(head["Content-Length"])
            while len(rest) < end + 4 + n + 4:
                more = stream.read(1 << 20)
                if not more:
                    raise ValueError("a record is cut off")
                rest += more
            yield head, bytes(rest[end + 4 : end + 4 + n])
            del rest[: end + 4 + n + 4]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of pages and their manifest below path, a folder that all executors reach."""
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/archives"))
    role = roles(pages, id_col, payload_col, min_revisit)
    rows = batched(pages).select(F.col(id_col).alias("_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "utf-8").alias("body"))
    rows = rows.join(role, (rows["_id"] == role["_id"]) & (F.sha2("body", 256) == F.col("_sha")), "left").select(rows["_id"], "url", "body", "refers_to")

    def write(batches):
        files, folder = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
        pending, size = [], 0

        def flush():
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            data = archive(pending)
            with files.open_output_stream(f"{folder}/archives/.{name}.tmp") as out:
                out.write(data)
            files.move(f"{folder}/archives/.{name}.tmp", f"{folder}/archives/{name}")
            return pa.RecordBatch.from_pydict({"path": [name], "records": [len(pending)], "bytes": [len(data)]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_id", "url", "body", "refers_to")), strict=True):
                pending.append(record_bytes(*row))
                size += len(pending[-1])
                if size >= archive_bytes:
                    yield flush()
                    pending, size = [], 0
        if pending:
            yield flush()

    rows.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/manifest")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below path. Their number is checked, and digest and length where a record has its payload."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select(F.col("path").alias("name"), "records")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{path}/archives")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(manifest, "name")

    def read(batches):
        for batch in batches:
            for data, records in zip(batch.column("content").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows = {c: [] for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
                for head, body in read_archive(data):
                    kind, digest, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
                    if kind == "response" and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't fit its digest")
                    ref = head.get("WARC-Refers-To")
                    number = head["WARC-Record-ID"][10:-1]
                    values = (int(number) if number else None, urllib.parse.unquote(head["WARC-Target-URI"]), kind, ref and int(ref[10:-1]), n, digest, body if payloads else None)
                    for c, v in zip(rows, values, strict=True):
                        rows[c].append(v)
                if len(rows["page_id"]) != records:
                    raise ValueError(f"{len(rows['page_id'])} records of {records}: the archive is cut off")
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(rows.values(), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=list(rows))

    return named.select("content", "records").mapInArrow(read, _RECORDS)


def op9_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    out = read_archives(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(coalesce(html, '')) >= {MIN_REVISIT} AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(coalesce(html, '')) >= {MIN_REVISIT} AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY sha256(coalesce(html, '')))
"""  # noqa: S608
