"""Inputs that already have the columns that operators add or use."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, quality, toxicity, vp_search, warc
from tessera.llm.common import new_path

NAMES = (
    "n_lines removed lines h words spans start end key from_id wanted chunk n_sentences sentence_ids licenses permissive n_words n_hit items contaminated severity p_toxic grade "
    "rejected lang_pred score word_shares n_tokens ids_sha256 decoded_sha256 ids decoded predicted id size node sig component i t y k v dim shard url_ record_type refers_to"
).split()


def test_every_operator(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a b\n{long}"), (2, f"c\n{long}"), (3, None), (4, "Released under the MIT License."), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(n) for n in NAMES])
    bench = spark.createDataFrame([(1, long)], "item_id long, text string").select("*", *[F.lit("x").alias(n) for n in NAMES])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").select("*", *[F.lit("x").alias(n) for n in NAMES])
    vectors, net = quality.train(docs, labels)
    path = bpe.default_path()
    outputs = [
        line_dedup.line_dedup(docs), license_scan.license_scan(docs), decontaminate.contamination(docs, bench), decontaminate.decontaminate(docs, bench, drop_share=2.0),
        decontaminate.decontaminate(docs, bench, block_windows=5), toxicity.severity(docs, toxicity.train(docs, labels)), quality.quality(docs, vectors, net),
        language_id.identify(docs, language_id.train(docs.withColumn("lang", F.lit("en")))), bpe.bpe_decode(bpe.bpe_encode(docs, path), path), bpe.bpe_digests(docs, path), jaccard_join.near_duplicates(docs),
    ]
    for out in outputs:
        assert len(set(out.columns)) == len(out.columns) and out.count() == 5
        out.write.format("noop").mode("overwrite").save()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *NAMES)
    where = new_path(spark, "warc")
    warc.write_archives(pages, where)
    assert warc.read_archives(spark, where).count() == 5
    rng = np.random.default_rng(0)
    table = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(n) for n in NAMES])
    assert vp_search.search(vp_search.build_index(table), vp_search.query_blocks(table.where("vec_id % 20 = 0")), 2).count() == 4
