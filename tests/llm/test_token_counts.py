"""Token counts against the libraries, and what the cache stores and spares."""

import public_tokenizers
import pytest

from tessera.llm import bpe
from tessera.llm import token_counts as C
from tessera.llm.common import new_path

TEXTS = [None, "", " ", "the the cat", "it's we'll x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "中文 😀 ẞ é", "a" * 3000, "0123 456.789!!", "The  Cat", "the cat", "THE\ncat", "<|ENDOFTEXT|>", "x y " * 40_000]
SCHEMA = "doc_id long, text string, n_tokens string, lang string"


def library(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda t: len(model.encode(t or ""))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: len(model.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_equals_the_library(spark, name):
    rows = [(i if i != 3 else None, t, "own", "en") for i, t in enumerate(TEXTS)] * 2
    count, path = library(name), new_path(spark, "cache")
    out = C.token_counts(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path(name), path)
    assert out.columns == ["doc_id", "lang", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(repr((i, "en", len((t or "").encode()), n := count(t), n > 1024)) for i, t, *_ in rows)
    assert sorted(repr(tuple(r)) for r in out.collect()) == want


def test_only_distinct_misses_are_encoded_and_stored(spark):
    path, tok, asked = new_path(spark, "cache"), bpe.default_path(), "doc_id long, text string"
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], asked)
    assert C.token_counts(first, tok, path).count() == 3
    assert spark.read.parquet(path).count() == 2
    version = C.counter(tok).version
    second = spark.createDataFrame([(4, "three"), (5, "four"), (6, None), (7, "one two")], asked)
    fresh = C.missing_counts(second, tok, C.cached_counts(spark, path, version))
    assert fresh.count() == 2  # "four" and the empty text
    # what is stored is used: a planted count comes back, and one of another tokenizer version doesn't
    key = second.where("doc_id = 5").select(C.content_digest(tok, "text")).first()[0]
    spark.createDataFrame([(bytearray(version), key, 77), (bytearray(b"other"), key, 5)], C.CACHE).write.mode("append").parquet(path)
    got = {r.doc_id: r.n_tokens for r in C.token_counts(second, tok, path).collect()}
    assert got[5] == 77 and got[6] == 0 and spark.read.parquet(path).count() == 5
    # a row that was stored twice changes nothing, and nothing is left to add
    spark.read.parquet(path).limit(3).collect()
    again = spark.createDataFrame([(bytearray(version), key, 77)], C.CACHE)
    again.write.mode("append").parquet(path)
    assert sorted(r.n_tokens for r in C.token_counts(second, tok, path).collect()) == sorted(got.values())
    assert spark.read.parquet(path).count() == 6


def test_hot_and_cold_contents_meet_once(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_SHARE", 10)
    monkeypatch.setattr(C, "REMEMBERED", 2)
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 40}") for i in range(300)]
    count = library("byte_bpe_50k.json")
    out = C.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_path(), new_path(spark, "cache"))
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(i, count(t)) for i, t in rows]


def test_empty_table(spark):
    out = C.token_counts(spark.createDataFrame([], "doc_id long, text string"), bpe.default_path(), new_path(spark, "cache"))
    assert out.count() == 0


def test_query(spark, sf):
    count = library("byte_bpe_50k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = C.op13_token_counts(spark, sf).collect()
    assert len(rows) == len(texts) and all((r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), count(texts[r.doc_id])) for r in rows)
