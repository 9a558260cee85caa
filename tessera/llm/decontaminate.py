"""Removal of benchmark passages from training texts.

Both sides are normalised to words: runs of ASCII letters and digits and of any character beyond ASCII, with A-Z lower-
cased. A benchmark item gives all its windows of ``n`` words; a shorter one with words gives one window of all of them.
The distinct pairs of item and window are a table. A set of them is broadcast and the training texts are scanned: the
words that no window has get number 0, a rolling sum over the numbers is looked up in the set, and a hit is verified word
by word (the numbers stand for words one to one). Every word inside an occurrence is hit.

A broadcast holds at most ``block_windows`` pairs, whatever the benchmark's size or an item's length: pairs are dealt into
blocks by a hash, and the blocks' sizes are counted before any is sent. Each block but the last is a job of its own that
writes what it hits, by the texts' SHA-256; the last is scanned in the final plan, where the earlier hits join. So the
driver, a plan and a task hold one block, and size never drops a window.

Null texts and texts without words have no words and no hits. Items with null or empty text match nothing. Repeated
items each count. Items without an id count for nothing in contamination(), which names items (its SQL leaves them out),
but decontaminate() removes their passages too. Other columns pass through the annotating and removing functions; those named like a result are
replaced, and names that begin with an underscore are kept for the work.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER_SQL, as_bytes, batched, mix64, others, read_table, stored

N = 10
#: Pairs of item and window that one broadcast may hold (about 200 bytes each).
BLOCK_WINDOWS = 500_000

#: Each byte that is no word byte becomes a space, A-Z become a-z.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_windows(words: list[bytes], n: int = N) -> list[bytes]:
    """The windows of an item, their words joined by spaces."""
    size = min(n, len(words))
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1 if size else 0)]


class Windows:
    """Numbered words and windows, by length, with their items; find() gives the verified occurrences in a word list."""

    def __init__(self, pairs: list[tuple[str | None, bytes]]):
        self.number: dict[bytes, int] = {}
        rows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        place: dict[str | None, int] = {}
        for name, gram in pairs:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in gram.split(b" "))
            rows.setdefault(len(ids), {}).setdefault(ids, set()).add(place.setdefault(name, len(place)))
        self.names = list(place)
        self.tables = []
        for size, found in sorted(rows.items()):
            grams = np.array(list(found), dtype=np.uint64).reshape(-1, size)
            keys = self._roll(mix64(grams.ravel()).reshape(grams.shape), size, axis=1)
            order = np.argsort(keys, kind="stable")
            flags = np.zeros(1 << 20, dtype=bool)
            flags[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((size, grams[order].astype(np.int64), keys[order], flags, [sorted(found[tuple(map(int, grams[i]))]) for i in order]))

    @staticmethod
    def _roll(mixed: np.ndarray, size: int, axis: int = 0) -> np.ndarray:
        total = np.zeros(mixed.shape[0] if axis else len(mixed) - size + 1, dtype=np.uint64)
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + (mixed[:, k] if axis else mixed[k : k + len(total)])
        return mix64(total)

    def find(self, words: list[bytes]):
        """Yields (first word, words, item numbers) of each verified occurrence."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        if not ids.any():
            return
        mixed = mix64(ids.astype(np.uint64))
        known = ids > 0
        inside = np.concatenate([[0], np.cumsum(known)])
        for size, grams, keys, flags, owners in self.tables:
            if len(ids) < size:
                continue
            starts = np.flatnonzero(inside[size:] - inside[:-size] == size)
            if not len(starts):
                continue
            total = np.zeros(len(starts), dtype=np.uint64)
            for k in range(size):
                total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[starts + k]
            total = mix64(total)
            maybe = flags[(total >> np.uint64(44)).astype(np.int64)]
            starts, total = starts[maybe], total[maybe]
            at = np.searchsorted(keys, total)
            for s, key, a in zip(starts.tolist(), total, at.tolist(), strict=True):
                while a < len(keys) and keys[a] == key:
                    if np.array_equal(grams[a], ids[s : s + size]):
                        yield s, size, owners[a]
                    a += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) in order, touching and overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def scan_text(windows: Windows, text: bytes) -> tuple[int, list[tuple[int, int]], list[str | None]]:
    """Number of words, merged word spans that are hit, names of the items that occur."""
    words = words_of(text)
    found = list(windows.find(words))
    return len(words), merged([(s, s + size) for s, size, _ in found]), [windows.names[i] for i in {i for _, _, owners in found for i in owners}]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_HITS = T.StructType([T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def _hits_udf(windows: Windows):
    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(_HITS)
    def hits(text: pa.Array) -> pa.Array:
        rows = (scan_text(windows, t) for t in as_bytes(text))
        return pa.array([{"spans": [{"start": a, "end": b} for a, b in spans], "items": items} for _, spans, items in rows], type=kind)

    return hits.asNondeterministic()  # else a filter on the result would be pushed below and scan all texts once more, in a second worker


def _final_udf(windows: Windows, cut: bool):
    """(n_words, n_hit, items, text) from a text and the hits of earlier blocks; text is null unless spans are to be cut."""

    @F.arrow_udf("n_words long, n_hit long, items array<string>, text string")
    def final(text: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        counts, hits, names, texts = [], [], [], []
        for t, before, known in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist(), items.to_pylist(), strict=True):
            n, own, found = scan_text(windows, t or b"")
            own = merged([*own, *((s["start"], s["end"]) for s in before)]) if before else own
            counts.append(n)
            hits.append(sum(b - a for a, b in own))
            names.append(sorted({x for x in (*found, *(known or ())) if x is not None}))
            texts.append((cut_spans(t, own) if own else t).decode() if cut and t is not None else None)
        columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(texts, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "items", "text"])

    return final.asNondeterministic()  # as above


def window_pairs(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(item, gram, slot): the distinct windows of each item and a hash that deals them into blocks."""

    def windows(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text")), strict=True):
                grams = item_windows(words_of(text), n)
                for i in range(0, len(grams), 10_000):
                    part = grams[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "gram"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(windows, "item string, gram binary")
    return rows.distinct().withColumn("slot", F.xxhash64("item", "gram"))


def _blocks(pairs: DataFrame, block_windows: int) -> list[DataFrame]:
    """pairs in blocks of at most block_windows rows, whose sizes are counted first."""
    total = pairs.count()
    n = 1 if total <= block_windows else 1 + total * 5 // (4 * block_windows)
    while n > 1 and pairs.groupBy(F.pmod("slot", F.lit(n))).count().agg(F.max("count")).first()[0] > block_windows:
        n += 1 + n // 8
    return [pairs.where(F.pmod("slot", F.lit(n)) == k) for k in range(n)]


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS, unnamed: bool = False, cut: bool = False) -> DataFrame:
    """docs with _scan: n_words, n_hit, items (sorted names) and, with cut, the text without its hit spans.

    Items without an id are searched if unnamed.
    """
    named = benchmark if unnamed else benchmark.where(F.col(item_col).isNotNull())
    *early, last = _blocks(stored(window_pairs(named, item_col, item_text, n), "benchmark-windows"), block_windows)
    held = lambda block: Windows([(r.item, bytes(r.gram)) for r in block.select("item", "gram").toLocalIterator()])
    key = F.unhex(F.sha2(text_col, 256))
    texts = batched(docs)
    parts = []
    for block in early:
        found = texts.where(F.col(text_col).isNotNull()).select(key.alias("_key"), _hits_udf(held(block))(F.col(text_col)).alias("h"))
        parts.append(stored(found.where(F.size("h.spans") > 0).dropDuplicates(["_key"]).select("_key", "h.spans", "h.items"), "benchmark-hits"))
    spans, items = F.lit(None).cast(_SPANS), F.lit(None).cast("array<string>")
    if parts:  # at most one row per block and text meets here
        hits = reduce(DataFrame.union, parts).groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
        texts, spans, items = texts.join(hits, key == F.col("_key"), "left"), F.col("_spans"), F.col("_items")
    return texts.withColumn("_scan", _final_udf(held(last), cut)(F.col(text_col), spans, items)).select(*docs.columns, "_scan")


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with n_words, n_hit, items (sorted names), contaminated."""
    out = scanned(docs, benchmark, text_col, **options)
    return out.select(*others(docs, "n_words", "n_hit", "items", "contaminated"), "_scan.n_words", "_scan.n_hit", "_scan.items", (F.col("_scan.n_hit") > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the bytes from the first to the last word of each of the ordered, separate spans."""
    folded = np.frombuffer(text.translate(_FOLD), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : begin[s]])
        at = int(end[e - 1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_share: float | None = None, **options) -> DataFrame:
    """docs without the hit spans; with drop_share, documents whose share of hit words reaches it go as a whole."""
    out = scanned(docs, benchmark, text_col, unnamed=True, cut=True, **options)
    if drop_share is not None:
        out = out.where((F.col("_scan.n_hit") == 0) | (F.col("_scan.n_hit") < drop_share * F.col("_scan.n_words")))
    return out.select(*[F.col("_scan.text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op10_decontaminate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, read_table(spark, sf_dir, "benchmark"), unnamed=True)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({N}, len(w)) AS n FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, unnest(list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1:k + n], ' '))) AS gram FROM i),
s AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, range(len(w) - n + 1) AS ks, list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1:k + n], ' ')) AS grams FROM d JOIN s ON len(w) >= n),
q AS (SELECT doc_id, n, unnest(ks) AS k, unnest(grams) AS gram FROM p),
h AS (SELECT doc_id, n, k, item FROM q JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""  # noqa: S608


def brute(text: str | None, items: list[tuple[str, str | None]], n: int = N) -> tuple[int, int, str, bool]:
    """The same by plain search, for tests."""
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for name, t in items:
        own = words_of((t or "").encode())
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(name)
    return len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
