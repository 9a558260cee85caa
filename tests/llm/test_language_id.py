import itertools

import numpy as np
import pytest

from tessera.llm import language_id as X


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    length = np.array([4, 2])
    post, pair = X.forward_backward(score, move, length)
    alone = X.chain_posteriors(score, move, length, np.array([True, True]))
    want_pair = np.zeros((3, 3))
    for i, n in enumerate(length):
        total, by, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(score[i, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                by[t, y] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(post[i, :n], by / total) and np.allclose(alone[i, :n], by / total)
        want_pair += pairs / total
    assert np.allclose(pair, want_pair)


def test_blocks_of_a_chain_equal_the_unbroken_chain():
    rng = np.random.default_rng(2)
    move = rng.normal(size=(4, 4))
    for sizes in ([1], [5, 17, 3, 40], [8, 9, 16, 1, 0, 33]):
        chains = [rng.normal(size=(n, 4)) * 2 for n in sizes]
        blocks, length, first = [], [], []
        for c in chains:
            for i in range(0, len(c), 8):
                part = c[i : i + 8]
                blocks.append(np.concatenate([part, np.zeros((8 - len(part), 4))]))
                length.append(len(part))
                first.append(i == 0)
        got = X.chain_posteriors(np.array(blocks), move, np.array(length), np.array(first)).reshape(-1, 4)
        at = 0
        for c in chains:
            want, _ = X.forward_backward(c[None], move, np.array([len(c)])) if len(c) else (np.zeros((1, 0, 4)), None)
            assert np.allclose(got[at : at + len(c)], want[0])
            at += -(-len(c) // 8) * 8


@pytest.fixture(scope="module")
def field(spark):
    return X.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(doc_id as string)) % 4 <> 2"))


def test_held_out_accuracy(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = X.identify(docs.where("crc32(cast(doc_id as string)) % 4 = 2"), field).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98


def test_code_switched_text_gets_its_shares(spark, field):
    docs = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if len(X.words_of(r.text.encode())) > 300}
    mixed = " ".join(docs["de"].split()[:200] + docs["fr"].split()[:150])
    (words, post), = X.label_words(field, [mixed.encode()])
    assert (post[:180].argmax(axis=1) == field.labels.index("de")).mean() > 0.9 and (post[220:].argmax(axis=1) == field.labels.index("fr")).mean() > 0.9


def test_repeated_ids_and_ties(spark):
    rows = [(1, "der die das und", "de"), (1, "le la les des", "de"), (1, "le la les des", "fr"), (2, "der die das und", "de"), (None, "the and of", "en"), (3, "zz", None), (4, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = X.train(docs)
    assert field.labels == ["de", "fr"]
    got = X.identify(docs, field).collect()
    assert len(got) == len(rows) and all(r.lang_pred == ("und" if r.text is None else r.lang_pred) and 0 <= r.score <= 1 for r in got)
    flat = X.Field(["a", "b"], np.zeros((X.TABLE, 2), dtype=np.float32), np.zeros((2, 2)))
    assert [(r.lang_pred, r.score) for r in X.identify(docs.where("doc_id = 2"), flat).collect()] == [("a", 0.5)]


def test_edges_and_rounds(spark, field, monkeypatch):
    texts = [None, "", "123 !?", "—…", "Ü", "the " * 50000, "the and of"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").drop("score").withColumnRenamed("text", "body")
    got = {r.doc_id: (r.lang_pred, r.score) for r in X.identify(docs, field, "body").collect()}
    assert all(got[i] == ("und", 0.0) for i in range(4)) and got[4][0] in field.labels and got[5][0] == got[6][0] == "en" and 0 < got[6][1] <= 1
    assert X.train(docs.withColumnRenamed("body", "text").selectExpr("doc_id", "text", "cast(null as string) lang")) is None
    assert {r.lang_pred for r in X.identify(docs, None, "body").collect()} == {"und"} and X.identify(docs.limit(0), field, "body").count() == 0
    whole = [p for _, p in X.label_words(field, [b"the and", b"", b"le la des"])]
    monkeypatch.setattr(X, "ROUND", 3)
    assert all(np.allclose(a, b) for a, b in zip(whole, [p for _, p in X.label_words(field, [b"the and", b"", b"le la des"])]))


def test_query_equals_unbroken_chains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = X.train(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = X.op3_language_id(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = X.words_of((texts[r.doc_id] or "").encode())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        post, _ = X.forward_backward(own.potentials(words)[None], own.move, np.array([len(words)]))
        mean = post[0].mean(axis=0)
        assert abs(r.score - mean.max()) < 1e-5 and r.lang_pred == own.labels[int(mean.argmax())]
