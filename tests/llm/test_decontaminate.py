import random

from tessera.llm import decontaminate as D

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, A), (2, "Short One"), (3, None), (4, ""), (5, A), (6, "x " * 12), (None, "not an item")]
DOCS = [
    (1, "so ALPHA, beta; gamma delta epsilon zeta eta theta iota kappa! end", 1),
    (2, "short\tone short-one", 2), (3, None, 3), (4, "", 4), (5, "été x x x x x x x x x x x x x x été", 5), (5, "clean text here", 6),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", 7), (8, "word " * 60000 + A, 8),
]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items long")
    return docs.withColumnRenamed("items", "extra"), spark.createDataFrame(ITEMS, "item_id long, text string")


def check(rows):
    import hashlib

    items = [(str(i), t) for i, t in ITEMS if i is not None]
    for r in rows:
        got = (r.n_words, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
        assert got == D.brute(r.text, items), r.doc_id


def test_edges_match_brute_force_in_one_and_in_many_blocks(spark):
    docs, bench = frames(spark)
    one = D.contamination(docs, bench).collect()
    assert len(one) == len(DOCS)
    check(one)
    check(D.contamination(docs, bench, block_windows=8).collect())


def test_random_texts_match_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("a b C".split()) for _ in range(n))
    items = [(i, words(rng.choice([1, 3, 10, 11, 14]))) for i in range(12)]
    docs = [(i, words(rng.randint(0, 80))) for i in range(60)]
    out = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n=5)
    for r in out.collect():
        assert (r.n_words, r.n_hit, r.contaminated) == (lambda x: (x[0], x[1], x[3]))(D.brute(r.text, [(str(i), t) for i, t in items], 5))


def test_a_plan_holds_one_bounded_block(spark, monkeypatch):
    docs, bench = frames(spark)
    sizes, build = [], D.Windows.__init__

    def noted(self, pairs):
        sizes.append(len(pairs))
        build(self, pairs)

    monkeypatch.setattr(D.Windows, "__init__", noted)
    long = bench.union(spark.createDataFrame([(9, " ".join(f"w{i}" for i in range(100)))], "item_id long, text string"))
    pairs = D.window_pairs(long.where("item_id is not null")).count()
    out = D.contamination(docs, long, block_windows=20)
    assert len(sizes) > 4 and max(sizes) <= 20 and sum(sizes) == pairs  # the item of 91 windows is spread too
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    check(out.collect())


def test_spans_and_documents_go(spark):
    docs, bench = frames(spark)
    cut = {(r.doc_id, r.extra): r.text for r in D.decontaminate(docs, bench).collect()}
    assert cut == {(r.doc_id, r.extra): r.text for r in D.decontaminate(docs, bench, block_windows=8).collect()}
    assert cut[1, 1] == "so ! end" and cut[3, 3] is None and cut[5, 6] == "clean text here" and cut[7, 7] == ""
    kept = {r.extra for r in D.decontaminate(docs, bench, drop_share=0.9).collect()}
    assert kept == {1, 3, 4, 5, 6, 8}


def test_filters_on_the_result_scan_no_text_twice(spark, monkeypatch):
    docs, bench = frames(spark)
    scans, store = [], D.stored
    times = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    def noted(df, name):
        scans.extend([times(df)] * (name == "benchmark-hits"))
        return store(df, name)

    monkeypatch.setattr(D, "stored", noted)
    one, many = (D.decontaminate(docs, bench, drop_share=0.5, block_windows=n) for n in (D.BLOCK_WINDOWS, 8))
    assert [times(one), times(many)] == [1, 1] and set(scans) == {1}
    assert sorted(one.collect(), key=str) == sorted(many.collect(), key=str)


def test_empty_tables(spark):
    docs, bench = frames(spark)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination(docs, bench.limit(0)).collect())


def test_query_matches_brute_force(spark, sf):
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = D.op10_decontaminate(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        if r.contaminated or r.doc_id % 4 == 0:
            assert (r.n_words, r.n_hit, r.items_sha256, r.contaminated) == D.brute(texts[r.doc_id], bench)


def test_items_without_an_id_hit_but_are_not_named(spark, tmp_path):
    import duckdb

    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:15])), (2, " ".join(words[20:38])), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words[2:13])), (7, " ".join(words[20:31])), (None, None)], "item_id long, text string")
    for name, table in (("documents", docs), ("benchmark", bench)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in D.op10_decontaminate(spark, str(tmp_path)).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(11, 0, True), (11, 1, True), (0, 0, False)]
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({D.SQL})").fetchall()) == sorted(tuple(r) for r in got.values())
