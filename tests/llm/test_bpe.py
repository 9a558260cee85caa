import random

import numpy as np
import pytest

from tessera.llm import bpe as B

TEXTS = [None, "", " ", "\n\n \t", "the the", "it's we'll x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "中文 😀 ẞ é", "a" * 3000, "x\x85y z\x1c", "0123 456.789!!"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_path())


def test_equals_the_library_on_edges_and_random_texts(library):
    rng, own = random.Random(5), B.Coder(B.default_path())
    texts = [t or "" for t in TEXTS] + ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x2000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_texts_and_a_full_cache_change_nothing(monkeypatch, library):
    monkeypatch.setattr(B, "GROUP_CHARS", 50)
    monkeypatch.setattr(B, "CHUNK_WORDS", 7)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcde'") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    assert np.frombuffer(B.Coder(B.default_path(), 20).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens string")
    out = B.bpe_decode(B.bpe_encode(docs, B.default_path()), B.default_path()).collect()
    assert len(out) == 2 * len(TEXTS) and all(r.decoded == (r.text or "") for r in out)
    assert B.bpe_encode(docs.limit(0), B.default_path()).count() == 0


def test_query_equals_the_library(spark, sf, library):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in B.op4_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
