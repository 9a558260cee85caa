"""Text quality from random-indexing word vectors and a small calibrated network.

Tokens are runs of letters, of digits and of other characters. Each distinct token has a sparse index vector (``NONZERO``
entries of +1 or -1, fixed by its hash); its word vector is the sum of the index vectors of the tokens within two places
of it, over all texts of the corpus. The vectors of all words, of which there is no bound, are kept as a count sketch of
fixed size: a word's vector is added, with a sign, to ``COPIES`` of ``BUCKETS`` rows, and read as the mean of these with
their signs. No two words share their rows and signs, but by a chance of one in 2^34, so a frequent word reads as itself
and what other words add cancels out on average. Every task adds up its own sketch and Spark sums these per row.

A document is pooled as the mean and the spread of its tokens' normalised vectors. A two-layer network (tanh, logistic
output) is fitted in numpy on at most ``sample_rows`` distinct labelled rows, in at least ``EPOCHS`` epochs and ``STEPS``
steps; a temperature, chosen on a fifth of them that the fit leaves out, calibrates it. An id with both labels enters with
both, and all texts of a shared id enter.

Null and empty texts pool to zeros and get the network's score of that. With labels of one kind or none, every score is
the smoothed share of ones. Texts of any length are read whole; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, batched, bounded_sample, fold_of, mix64, read_table

BUCKETS, COPIES, DIMS, NONZERO = 1 << 16, 2, 32, 4
SAMPLE_ROWS = 20_000
HIDDEN = 24
EPOCHS, STEPS = 60, 12_000
THRESHOLD = 0.7
HELD_OUT = 2
#: Tokens that are put into one round of counting, and distinct ones that are pooled at once.
ROUND, POOL = 500_000, 100_000

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _bits(h: np.ndarray, seed: int, width: int, count: int) -> np.ndarray:
    """count numbers of width bits for each hash."""
    return (mix64(h + np.uint64(seed))[:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))[None, :] & np.uint64((1 << width) - 1)).astype(np.int64)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each word's index vector."""
    return _bits(h, 1, 5, NONZERO), 1.0 - 2.0 * _bits(h, 2, 1, NONZERO)


def sketch_rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signs of each word in the sketch."""
    return _bits(h, 3, 16, COPIES), 1.0 - 2.0 * _bits(h, 4, 1, COPIES)


def add_contexts(sketch: np.ndarray, ids: np.ndarray, words: list[bytes]) -> None:
    """Add the contexts of numbered words to the sketch; ids has -1 between texts, which windows don't cross."""
    if not words:
        return
    h = hashes_of(words)
    places, signs = index_vectors(h)
    total = np.zeros(len(words) * DIMS)
    for k in (1, 2):
        a, b = ids[:-k], ids[k:]
        fine = (a >= 0) & (b >= 0)
        a, b = a[fine], b[fine]
        for i in range(0, len(a), ROUND):
            for left, right in ((a[i : i + ROUND], b[i : i + ROUND]), (b[i : i + ROUND], a[i : i + ROUND])):
                total += np.bincount((left[:, None] * DIMS + places[right]).ravel(), weights=signs[right].ravel(), minlength=len(total))
    total = total.reshape(-1, DIMS)
    rows, signs = sketch_rows(h)
    for j in range(COPIES):
        at = rows[:, j, None] * DIMS + np.arange(DIMS)
        sketch += np.bincount(at.ravel(), weights=(signs[:, j, None] * total).ravel(), minlength=sketch.size).reshape(sketch.shape)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sketch of the word vectors of all texts."""
    columns = [f"d{i}" for i in range(DIMS)]
    gap = np.full(2, -1, dtype=np.int64)

    def count(batches):
        sketch = np.zeros((BUCKETS, DIMS))
        number: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal number, parts, size
            if parts:
                add_contexts(sketch, np.concatenate(parts), list(number))
            number, parts, size = {}, [], 0

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                parts += [np.array([number.setdefault(w, len(number)) for w in _TOKEN.findall(text)], dtype=np.int64), gap]
                size += len(parts[-2])
                if size >= ROUND:
                    flush()
        flush()
        seen = np.flatnonzero(sketch.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(sketch[seen, i]) for i in range(DIMS))], names=["bucket", *columns])

    parts = batched(docs).select(F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(count, "bucket long, " + ", ".join(f"{c} double" for c in columns))
    # entries are whole numbers, so the sums don't depend on their order; at most BUCKETS rows come back
    summed = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    if len(summed):
        out[summed["bucket"].to_numpy()] = summed[columns].to_numpy()
    return out


def vectors_of(sketch: np.ndarray, words) -> np.ndarray:
    """The normalised word vectors."""
    rows, signs = sketch_rows(hashes_of(words))
    out = np.einsum("nj,njd->nd", signs.astype(np.float32), sketch[rows])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pooled(sketch: np.ndarray, text: bytes) -> np.ndarray:
    counts = Counter(_TOKEN.findall(text))
    if not counts:
        return np.zeros(2 * DIMS)
    words, n = list(counts), np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    first, second = np.zeros(DIMS), np.zeros(DIMS)
    for i in range(0, len(words), POOL):
        v = vectors_of(sketch, words[i : i + POOL]).astype(np.float64)
        first += n[i : i + POOL] @ v
        second += n[i : i + POOL] @ (v * v)
    mean = first / n.sum()
    return np.concatenate([mean, np.sqrt(np.maximum(second / n.sum() - mean**2, 0))])


@dataclass
class Network:
    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, l2: float = 1e-4, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        n = x.shape[1]
        return Network(np.zeros(n), np.ones(n), np.zeros((n, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    left_out = np.arange(len(y)) % 5 == 4
    if not 0 < y[~left_out].sum() < (~left_out).sum() or not 0 < y[left_out].sum() < left_out.sum():
        left_out[:] = False
    tx, ty = x[~left_out], y[~left_out]
    net = Network(tx.mean(axis=0), tx.std(axis=0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = (tx - net.middle) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(ty) // 64)))):
        order = rng.permutation(len(ty))
        for i in range(0, len(order), 64):
            at = order[i : i + 64]
            h = np.tanh(z[at] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60))) - ty[at]) / len(at)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[at].T @ back + l2 * params[0], back.sum(axis=0), h.T @ d + l2 * params[2], np.array([d.sum()])]
            step += 1
            for p, g, m in zip(params, grads, moment, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if left_out.any():
        logit, own = net.logit(x[left_out]), y[left_out]
        loss = lambda t: np.mean(np.logaddexp(0, -logit / t * (2 * own - 1)))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Vectors from all of docs, a network from at most sample_rows rows of 0/1 labels and their texts."""
    vectors = word_vectors(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y")).distinct()
    rows = bounded_sample(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")), known, sample_rows, id_col)

    def pool(batches):
        for batch in batches:
            x = np.array([pooled(vectors, t) for t in as_bytes(batch.column("t"))]).reshape(-1, 2 * DIMS)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "x": x.tolist()})

    got = rows.select("t", "y").mapInArrow(pool, "y int, x array<double>").toPandas()
    x = np.array([np.asarray(v) for v in got["x"]]).reshape(-1, 2 * DIMS)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # the fit doesn't depend on the order of arrival
    return vectors, fit(x[order], got["y"].to_numpy(dtype=np.float64)[order])


def quality(docs: DataFrame, vectors: np.ndarray, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (probability of label 1) and predicted."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(net.probability(np.array([pooled(vectors, t) for t in as_bytes(text)]).reshape(-1, 2 * DIMS)))

    return batched(docs).withColumn("score", score(text_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold_of("doc_id") != HELD_OUT)
    vectors, net = train(docs, labels)
    return quality(docs, vectors, net).select("doc_id", F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
