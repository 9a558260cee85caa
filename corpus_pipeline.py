"""Corpus cleaning in five stages, each written as Parquet and read again as the next one's documents.

toxicity: documents that the ordinal model rejects go.
line dedup: passages that repeat go, by the chunks of op1_line_dedup; a document that had text and loses all of it goes too, as its lines stand elsewhere.
n-gram Jaccard join: of documents linked at 0.8 or more over five-word shingles the smallest doc_id stays, and of rows with
the same doc_id and text one. Each text of a shared doc_id is decided by itself. Rows without a doc_id are decided by their
text, in this stage and in line dedup: they come after all others, in order of a hash of the text.
benchmark decontamination: benchmark spans go from the texts, those of items without an id too; a document that is hit in half of its words or more goes.
BPE coding: token ids of the texts that are left.

A null text passes the first four stages as it is. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tessera.llm.common import new_path, read_table, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NGRAM, THRESHOLD = 5, (80, 100)
DROP_SHARE = 0.5


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _id: doc_id, or a number of the text beyond all usual ids."""
    return docs.withColumn("_id", F.coalesce("doc_id", F.lit(2**63 - 1) - F.pmod(F.xxhash64("text"), F.lit(2**48))))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).where("NOT rejected").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_keyed(docs), id_col="_id")
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"\S")
    return _with_length(out.where(~F.coalesce(emptied, F.lit(False))))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    groups = jaccard_join.near_groups(rows, NGRAM, *THRESHOLD, id_col="_id")
    kept = groups.where("first.id = id AND first.t = t").select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct()
    # equal rows are brought down to one before and after the shuffle that the join needs anyway
    of_equal = Window.partitionBy("_id", "_t").orderBy("lang", "source", "n_chars")
    one = rows.withColumn("_t", F.xxhash64("text")).withColumn("_n", F.row_number().over(of_equal)).where("_n = 1")
    return one.join(kept, ["_id", "_t"], "left_semi").select(COLUMNS)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), drop_share=DROP_SHARE))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", keep_civil),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The fitted model, the hashes of the coder and the graph search have no SQL; tests hold the stages against plain code.
ORACLE_SQL = None
