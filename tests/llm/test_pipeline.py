import numpy as np

import corpus_pipeline as C
from tessera.llm import bpe, decontaminate, jaccard_join
from tests.llm.test_jaccard_join import brute


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    steps = [docs]
    for _, stage in C.STAGES:
        steps.append(stage(spark, steps[-1], sf).cache())
    rows = [{r.doc_id: r for r in d.collect()} for d in steps]
    assert all(d.columns == C.COLUMNS for d in steps[:-1])
    gone = rows[0].keys() - rows[1].keys()
    assert not any(labels.get(i) == 0 for i in gone) and all(rows[0][i] == rows[1][i] for i in rows[1])
    kept = {x for r in rows[2].values() for x in r.text.split("\n")}
    for i, r in rows[1].items():
        assert all(x in kept for x in r.text.split("\n") if x.strip() and (i not in rows[2] or x not in rows[2][i].text.split("\n")))
    want = {i for i, (_, c) in brute([(i, r.text) for i, r in rows[2].items()], C.NGRAM, *C.THRESHOLD).items() if i == c}
    assert rows[3].keys() == want
    for i, r in rows[3].items():
        n, hit, _, bad = decontaminate.brute(r.text, bench)
        assert (i not in rows[4]) == (bad and hit >= C.DROP_SHARE * n)
        if i in rows[4]:
            assert (rows[4][i].text == r.text) == (not bad)
    coder = bpe.coder(bpe.default_path())
    assert rows[5].keys() == rows[4].keys()
    whole = {r.doc_id: r for r in C.run(spark, sf).collect()}
    assert whole == rows[5]
    assert all(coder.decode(np.array(r.ids, "<u4").tobytes()) == rows[4][i].text and len(r.ids) == r.n_tokens for i, r in rows[5].items())


def test_run_gives_the_last_stage(spark, sf):
    out = C.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 0


def test_null_and_empty_rows_pass(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x", None, "s", 1), (4, "x", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data, ids in ((docs, [1, 2, 3]), (docs.limit(0), [])):
        for _, stage in C.STAGES:
            data = stage(spark, data, str(tmp_path))
        assert sorted(r.doc_id for r in data.collect()) == ids


def test_null_and_shared_ids(spark, tmp_path):
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(20))
    rows = [(None, words("n")), (None, words("a")), (1, words("a")), (5, words("a") + " more"), (5, words("b")), (7, words("b")), (8, words("c")), (8, words("d")), (9, words("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.keep_one_of_near_copies(spark, docs, str(tmp_path)).collect()
    want = [(None, words("n")), (1, words("a")), (5, words("b")), (8, words("c")), (8, words("d"))]
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted((i or 0, t) for i, t in want)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, C.NGRAM, *C.THRESHOLD).collect()}
    assert {(i, c) for i, _, c in got} == {(None, None), (1, 1), (5, 1), (7, 1), (8, 8), (9, 8)}
    spark.createDataFrame([(None, words("c")), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert words("c") not in [r.text for r in C.remove_benchmarks(spark, docs, str(tmp_path)).collect()]
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert words("c") not in [r.text for r in decontaminate.decontaminate(docs, bench, block_windows=5).collect()]


def test_rows_that_stand_twice_and_rows_without_an_id(spark, tmp_path):
    text = lambda tag: "\n".join(" ".join(f"{tag}{k}x{j}" for j in range(12)) for k in range(3))
    rows = [(1, text("a")), (1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (None, text("a")), (2, text("c")), (None, text("c") + "\nand " + text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = C.drop_repeated_lines(spark, docs, str(tmp_path))
    # equal rows are one document so far; a row without an id yields its repeated lines to one with an id
    assert sorted((r.doc_id or 0, r.text) for r in lines.collect()) == sorted([(1, text("a"))] * 3 + [(0, text("b"))] * 2 + [(2, text("c")), (0, "and " + text("d"))])
    for given in (docs, lines):
        kept = sorted((r.doc_id or 0, r.text) for r in C.keep_one_of_near_copies(spark, given, str(tmp_path)).collect())
        assert [k for k in kept if k[1] in (text("a"), text("b"), text("c"))] == sorted([(0, text("b")), (1, text("a")), (2, text("c"))])
