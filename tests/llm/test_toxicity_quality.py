import numpy as np

from tessera.llm import quality as Q
from tessera.llm import toxicity as X

EDGES = [None, "", "   ", "!!!", "word " * 40000, "é"]


def edge_docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGES)] + [(2, "   ", "again")], "doc_id long, text string, grade string").withColumnRenamed("grade", "y")


def test_ordinal_fit_orders_its_cuts_and_grades():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 600)
    rows = [(np.array([0] if n else [], dtype=int), np.log1p([n] if n else [])) for n in counts]
    grade = np.digitize(counts, [1, 3, 6])
    w, cuts = X.fit_ordinal(rows, grade, 1, 4)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()
    model = X.Model({b"bad": 0}, w, cuts)
    severity = [model.score(b"bad " * n)[0] for n in range(9)]
    assert (np.diff(severity) > 0).all()
    assert np.mean([model.score(b"bad " * int(n))[2] == g for n, g in zip(counts, grade)]) > 0.9


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = X.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = X.severity(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.rejected for r in toxic]) > 0.85 and np.mean([r.rejected for r in clean]) < 0.01
    assert np.mean([r.severity for r in toxic]) > 1 and all(0 <= r.severity <= 3 for r in rows)


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, none)
    rows = X.severity(docs, model).collect()
    assert len(rows) == 7 and all(r.severity < 0.01 and not r.rejected for r in rows)
    assert X.train(docs, spark.createDataFrame([(0, 1), (1, 1), (4, None), (None, 0)], "doc_id long, toxic int")).vocabulary == {}
    assert X.severity(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in Q.op6_quality(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_word_vectors_equal_a_plain_count(spark):
    texts = ["a b c a", None, "", "b b 7 !!", "é a b"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = sorted({w for t in texts for w in Q._TOKEN.findall((t or "").encode())})
    h = Q.hashes_of(words)
    (places, signs), (rows, turns) = Q.index_vectors(h), Q.sketch_rows(h)
    want = np.zeros((len(words), Q.DIMS))
    for t in texts:
        ids = [words.index(w) for w in Q._TOKEN.findall((t or "").encode())]
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    np.add.at(want[a], places[ids[j]], signs[ids[j]])
    sketch = np.zeros((Q.BUCKETS, Q.DIMS))
    for j in range(Q.COPIES):
        np.add.at(sketch, rows[:, j], turns[:, j, None] * want)
    got = Q.word_vectors(docs)
    assert np.array_equal(got, sketch)
    assert len({*map(tuple, rows.tolist())}) == len(words)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(Q.vectors_of(got, words), want, atol=1e-6)


def test_pooling_equals_a_plain_mean(monkeypatch):
    sketch = np.random.default_rng(3).normal(size=(Q.BUCKETS, Q.DIMS)).astype(np.float32)
    text = b"a b c a a 7 !! long word list " * 3
    v = np.array([Q.vectors_of(sketch, [w])[0] for w in Q._TOKEN.findall(text)], dtype=np.float64)
    want = np.concatenate([v.mean(axis=0), v.std(axis=0)])
    assert np.allclose(Q.pooled(sketch, text), want, atol=1e-6)
    monkeypatch.setattr(Q, "POOL", 2)
    assert np.allclose(Q.pooled(sketch, text), want, atol=1e-6)


def test_repeated_labels_and_ids(spark):
    docs = spark.createDataFrame([(i, f"good fine text {i} {'nice ' * (i % 3)}" if i % 2 else f"bad 0x{i} !!! {'$ ' * (i % 4)}") for i in range(400)] + [(1, "another text of one"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    again = labels.union(labels).union(spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    scores = [{(r.doc_id, r.text): r.score for r in Q.quality(docs, *Q.train(docs, x)).collect()} for x in (labels, again)]
    assert scores[0] == scores[1] and len(scores[0]) == 402 and scores[0][3, docs.where("doc_id = 3").first().text] > 0.5
    toxic = labels.withColumnRenamed("quality", "toxic")
    a, b = X.train(docs, toxic), X.train(docs, toxic.union(toxic))
    assert a.vocabulary == b.vocabulary and np.array_equal(a.weights, b.weights) and b"good" in a.vocabulary and b"bad" in a.vocabulary


def test_quality_edges(spark):
    docs = edge_docs(spark)
    vectors, net = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = Q.quality(docs, vectors, net).collect()
    assert len(rows) == 7 and {round(r.score, 6) for r in rows} == {0.5} and Q.quality(docs.limit(0), vectors, net).count() == 0
    vectors, net = Q.train(docs.limit(0), spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert not vectors.any()


def test_toxicity_query_equals_a_plain_formula(spark, sf):
    import math
    import re

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = X.train(docs, labels, min_g=5.0)
    assert len(model.vocabulary) > 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in X.severity(docs, model).collect():
        words = [w.encode() for w in re.findall("[a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in texts[r.doc_id] or ""))]
        z = sum(model.weights[i] * math.log(1 + words.count(w)) for w, i in model.vocabulary.items())
        above = [1 / (1 + math.exp(min(60, c - z))) for c in model.cuts]
        assert abs(r.severity - sum(above)) < 1e-6 and abs(r.p_toxic - above[0]) < 1e-6 and r.rejected == (r.p_toxic >= X.REJECT)
    assert X.op5_toxicity(spark, sf).count() == len(texts)


def test_quality_query_equals_plain_pooling(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").where("crc32(cast(doc_id as string)) % 4 <> 2")
    sketch, net = Q.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = Q.op6_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = Q._TOKEN.findall((texts[r.doc_id] or "").encode())
        v = Q.vectors_of(sketch, words).astype(np.float64) if words else np.zeros((1, Q.DIMS))
        x = np.concatenate([v.mean(axis=0), v.std(axis=0)])
        hidden = np.tanh((x - net.middle) / net.scale @ net.w1 + net.b1)
        assert abs(r.score - 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature))) < 1e-4 and r.predicted == (r.score >= 0.7)
