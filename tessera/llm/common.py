"""Helpers that several operators share."""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import new_path, scratch, stored

__all__ = ["LOWER_SQL", "as_bytes", "batched", "bounded_sample", "fold_of", "fold_of_id", "mix64", "new_path", "others", "pin", "read_table", "scratch", "stored"]

#: SQL: a text with A-Z lower-cased, null as empty.
LOWER_SQL = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df; Python functions on whole texts get at most rows of them at once, unless the session sets its own number."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "10000") == "10000":
        conf.set(key, str(rows))
    return df


def pin(df: DataFrame, *keep: str, **cols: Column) -> DataFrame:
    """Compute cols once per row; the optimizer can't repeat them inside later lambda functions."""
    one = F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])))
    return df.select(*(keep or df.columns), one)


def others(df: DataFrame, *new: str) -> list[str]:
    """The columns of df that keep their place beside new ones; those of the same name are replaced."""
    return [c for c in df.columns if c not in new]


def fold_of(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 4."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def fold_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """docs joined with at most rows rows of labels, chosen by a hash of their id.

    The chosen rows are narrow and at most rows many, so they are broadcast and the texts don't move.
    """
    chosen = labels.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.join(F.broadcast(chosen), id_col)
