"""Token counts through a digest cache.

A cache is a table of (tokenizer, content, n_tokens): the digest of a tokenizer's version (its file and the library that
reads it), the digest of a normalised content, and its count. A call digests every text, looks the digests up, encodes each
distinct content that the cache lacks once, appends the new counts, and joins the documents' digests to the stored counts.

The normalised content of a text is what the tokenizer's own normaliser makes of it, so equal digests have equal counts; a
text that holds one of the tokenizer's special strings stands for itself, as these are matched before normalising, and so
does any text where the file has no normaliser.

A text moves only if its content is missing: each task sends one copy of every content that it meets, packed with
Zstandard, and an aggregate by digest leaves one copy of all. The table of digests is written once to the shared folder and
read twice: to find the contents that over a thousandth of all rows share (a thousand at most, whose counts are broadcast),
and for the last join, which thus has no hot key. Counts are a function of content and tokenizer: an append that was
repeated after a failure, or two calls at once, may store a row twice and change no result.

Cases: a null text is the empty one, 0 tokens. Rows that repeat are counted one by one, rows without an id too. Very long
texts are counted whole. Columns other than the text pass through; those named like a result are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import as_bytes, batched, new_path, others, read_table, stored

CACHE = "tokenizer binary, content binary, n_tokens long"
LIMIT = 1024
#: Digests that a task remembers while it leaves out its own repeats; when full it forgets them, and sends a content again.
REMEMBERED = 500_000
#: Characters of text that are encoded at a time.
GROUP_CHARS = 2_000_000
#: A content that more than this part of all rows share is hot.
HOT_SHARE = 1000


class Counter:
    """Normalised contents and counts of one tokenizer file: .json (tokenizers) or .model (sentencepiece)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, "rb") as f:
            data = f.read()
        self.path, self.normalizer, self.special, self.own = path, None, [], None
        if path.endswith(".model"):
            import sentencepiece as library

            model = library.SentencePieceProcessor(model_proto=data)
            self.many = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
        else:
            import tokenizers as library

            model = library.Tokenizer.from_str(data.decode())
            model.no_truncation()
            model.no_padding()
            self.normalizer = model.normalizer
            self.special = [t.content for t in model.get_added_tokens_decoder().values()]
            self.many = lambda texts: list(map(len, model.encode_batch_fast(texts, add_special_tokens=False)))
            if walkable(json.loads(data)):  # the same ids at a third of the time
                self.own = bpe.Coder(path, bpe.LARGE_CACHE)
                self.many = lambda texts: [len(ids) // 4 for ids in self.own.encode_all(texts)]
        self.version = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + data).digest()

    def content(self, text: str) -> bytes:
        if self.normalizer is None or any(s in text for s in self.special):
            return b"=" + text.encode()
        return b"~" + self.normalizer.normalize_str(text).encode()

    def counts(self, texts: list[str]) -> list[int]:
        out, begin = [], 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size <= GROUP_CHARS:
                size += len(texts[end])
                end += 1
            out += self.many(texts[begin:end])
            begin = end
        return out

    def forget(self) -> None:
        """Drop remembered words; the worker may go on with other stages."""
        if self.own:
            self.own.forget()


def walkable(doc: dict) -> bool:
    """Whether bpe.Coder reads this file: byte-level BPE with the usual pattern and nothing else."""
    model, split = doc["model"], doc["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    strict = all(not t[k] for t in doc["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    return model.get("type", "BPE") == "BPE" and doc["normalizer"] is None and all(split.get(k, v) == v for k, v in plain.items()) and "type" in split and strict and not any(model.get(k) for k in odd)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def content_digest(path: str, text: Column | str) -> Column:
    """SHA-256 of the normalised content, null as empty."""
    if counter(path).normalizer is None:  # no need to leave the JVM
        return F.unhex(F.sha2(F.concat(F.lit("="), F.coalesce(text, F.lit(""))), 256))

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([hashlib.sha256(own.content(t or "")).digest() for t in texts.to_pylist()], type=pa.binary())

    return digest(text)


def cached_counts(spark, cache_path: str, version: bytes) -> DataFrame:
    """(content, n_tokens) of one tokenizer version, one row per content; empty where there is no cache yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    rows = spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == F.lit(version)).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def _distinct_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, pack = set(), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        keys, data = [], []
        for key, text in zip(batch.column("content").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                data.append(pack.compress(text))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.large_binary()).cast(pa.binary())], names=["content", "packed"])


def missing_counts(docs: DataFrame, path: str, known: DataFrame, text_col: str = "text") -> DataFrame:
    """(content, n_tokens) of each distinct content of docs that known lacks; each is encoded once."""
    texts = batched(docs).select(content_digest(path, text_col).alias("content"), F.col(text_col).alias("text"))
    once = texts.mapInArrow(_distinct_packed, "content binary, packed binary").join(known.select("content"), "content", "left_anti").groupBy("content").agg(F.any_value("packed").alias("packed"))

    def count(batches):
        own, unpack = counter(path), zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [unpack.decompress(x).decode() for x in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(own.counts(texts), pa.int64())], names=["content", "n_tokens"])
        own.forget()

    return once.mapInArrow(count, "content binary, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache_path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; the cache at cache_path has every content of docs afterwards."""
    spark, version = docs.sparkSession, counter(path).version
    fresh = missing_counts(docs, path, cached_counts(spark, cache_path, version), text_col)
    fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    counts = cached_counts(spark, cache_path, version)

    own = others(docs, "n_bytes", "n_tokens", "over_limit")
    rest = [c for c in own if c != text_col]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = stored(docs.select(F.struct(*rest).alias("row") if rest else F.lit(None).cast("int").alias("row"), size.alias("n_bytes"), content_digest(path, text_col).alias("content")), "token-digests")
    per_content = rows.groupBy("content").agg(F.count("*").alias("copies"))
    hot = F.broadcast(per_content.where(F.col("copies") > max(1, rows.count() // HOT_SHARE)).select("content"))  # HOT_SHARE rows at most
    joined = rows.join(hot, "content", "left_anti").join(counts, "content").unionByName(rows.join(F.broadcast(counts.join(hot, "content", "left_semi")), "content"))
    return joined.select(*[F.col("row")[c].alias(c) for c in rest], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir):
    """Counts of all documents with a cache of the call's own: a cold one, so that a call's cost doesn't hang on earlier ones."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, bpe.default_path(), new_path(spark, "token-cache"))
