"""Columns on vectors held as arrays; sums run in array order, in double precision, inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.constants import DIRECTIONS


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; -1 for zero vectors, unlike lengths, empty or null ones."""
    dot = _total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_total(F.transform(a, lambda x: x * x))) * F.sqrt(_total(F.transform(b, lambda x: x * x)))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms), F.lit(-1.0))


def part(vector: Column, at: int | Column, width: int) -> Column:
    """The at-th stretch of width entries, from 0."""
    return F.slice(vector, (F.lit(at) if isinstance(at, int) else at) * width + 1, width)


def best_view(query: Column, vector: Column, direction: str = "bestOfFour", width: int = 16) -> Column:
    """(score, offset) of the face most like the query's first face; the first of equal ones."""
    faces = DIRECTIONS.get(direction, DIRECTIONS["bestOfFour"])
    front = F.slice(query, 1, width)
    scored = F.array_max(F.array(*[F.struct(cosine(front, part(vector, k, width)).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("offset")) for i, k in enumerate(faces)]))
    return F.struct(scored["score"].alias("score"), scored["offset"].alias("offset"))


def best_region(query: Column, vector: Column, regions: int, width: int = 8, whole_query: bool = False) -> Column:
    """The largest cosine between the query's first region (or any of its regions) and any region of the vector."""
    own = range(regions) if whole_query else range(1)
    return F.array_max(F.array(*[cosine(part(query, q, width), part(vector, r, width)) for q in own for r in range(regions)]))


def quantized(vector: Column, scale: float = 127.0) -> Column:
    """Entries as whole numbers from -127 to 127."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * scale, 0).cast("int"))))


def mixed(visual: Column, text: Column, weight: int) -> Column:
    """Weighted average of whole-number vectors, cut off towards zero."""
    return F.zip_with(visual, text, lambda v, t: F.greatest(F.lit(-127), F.least(F.lit(127), ((v * (100 - weight) + t * weight) / 100.0).cast("int"))))


def as_bytes(vector: Column) -> Column:
    """A whole-number vector as two's-complement bytes."""
    return F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(256).cast("long"))), 2, "0")), ""))


def signed(byte: Column) -> Column:
    return F.when(byte > 127, byte - 256).otherwise(byte)


def output_digest(model_id: Column, asset: Column, capture: Column, lane: Column, model: Column, embedding: Column) -> Column:
    """SHA-256 of five texts, each with a line feed, and the raw bytes of a vector."""
    head = F.concat(*[F.encode(F.concat(c, F.lit("\n")), "utf-8") for c in (model_id, asset, capture, lane, model)])
    return F.sha2(F.concat(head, embedding), 256)


def best_view_of_bytes(query: bytes, direction: str = "bestOfFour", width: int = 16):
    """best_view for vectors held as signed bytes: a function of a binary column that gives (score, offset).

    Batches are scored as matrices. Dot products and squares are whole numbers, so the scores are those of cosine(). A
    null or a vector without the faces scores -1.
    """
    faces = list(DIRECTIONS.get(direction, DIRECTIONS["bestOfFour"]))
    front = np.frombuffer(query[:width], dtype=np.int8).astype(np.float64)
    norm = np.sqrt(front @ front)
    need = width * (max(faces) + 1)

    @F.arrow_udf("score double, offset int")
    def scored(vectors: pa.Array) -> pa.Array:
        rows = [v[:need] if v is not None and len(v) >= need else bytes(need) for v in vectors.to_pylist()]
        views = np.frombuffer(b"".join(rows), dtype=np.int8).reshape(len(rows), -1, width)[:, faces].astype(np.float64)
        norms = np.sqrt(np.einsum("nfw,nfw->nf", views, views)) * norm
        score = np.where(norms > 0, (views @ front) / np.where(norms > 0, norms, 1.0), -1.0)
        best = score.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(score[np.arange(len(rows)), best]), pa.array(np.array(faces, dtype=np.int32)[best])], names=["score", "offset"])

    return scored
