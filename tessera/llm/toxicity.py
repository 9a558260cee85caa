"""Severity of toxic text by cumulative-link ordinal regression over sparse word features.

Labels say toxic or not. Grades come from them: 0 for not toxic, and 1 to ``grades`` - 1 for toxic rows by the quantile of
their evidence, the sum over their words of log(1 + count) times the word's log odds of toxicity. The rows fall into two
halves by a hash of the text, and a row's evidence uses the odds that the other half gives, so no row grades itself. The
vocabulary is every word whose presence tells toxic rows from the others, either way, with a likelihood ratio (G
statistic) of at least ``min_g``. A row's features are log(1 + count) per vocabulary word. One weight vector is shared by
all thresholds: P(grade <= j) = sigmoid(t_j - w x) with ordered t; fitted by gradient steps with an L2 penalty. The output
is the expected severity, sum over j of P(grade > j), and the probability of any toxicity, P(grade > 0).

The fit takes at most ``sample_rows`` labelled rows, chosen by a hash of their id; copies of a text count once among
them, as toxic if one is. The counts that choose the vocabulary are Spark aggregates over these rows. Scoring reads every
text whole. Null and empty texts and texts without vocabulary words have no features; an empty label table gives severity
0 throughout. Other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, batched, bounded_sample, others, read_table

SAMPLE_ROWS = 20_000
#: Present by chance in five toxic rows and no other, at one toxic row in nine, a word reaches 22.
MIN_G = 22.0
GRADES = 4
#: Rows of at least this probability of toxicity are rejected.
REJECT = 0.5

#: ASCII letters (lower-cased) and bytes beyond ASCII make words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    cuts: np.ndarray  # ascending

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        own = self.vocabulary
        found = np.array([own[w] for w in words_of(text) if w in own], dtype=np.int64)
        at, n = np.unique(found, return_counts=True)
        return at, np.log1p(n)

    def score(self, text: bytes) -> tuple[float, float, int]:
        """(expected severity, probability of any toxicity, likeliest grade)."""
        at, x = self.features(text)
        above = 1 / (1 + np.exp(np.clip(self.cuts - float(self.weights[at] @ x), -60, 60)))
        each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), float(above[0]), int(each.argmax())


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, n_features: int, grades: int, l2: float = 1e-5, steps: int = 600, rate: float = 0.3):
    """Weights and ordered cuts by Adam on the full batch; cuts are a first one plus exponentials."""
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, np.int64)
    x = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    theta = np.concatenate([np.zeros(n_features), [1.0], np.zeros(grades - 2)])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.full(len(rows), 1 / max(1, len(rows)))
    n = np.arange(len(rows))
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(np.clip(theta[n_features + 1 :], -8, 8))
        cuts = theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, weights=w[at] * x, minlength=len(rows))
        upto = 1 / (1 + np.exp(-np.clip(cuts[None, :] - z[:, None], -60, 60)))
        padded = np.concatenate([np.zeros((len(rows), 1)), upto, np.ones((len(rows), 1))], axis=1)
        p = np.maximum(padded[n, grade + 1] - padded[n, grade], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), upto * (1 - upto), np.zeros((len(rows), 1))], axis=1)
        high, low = slope[n, grade + 1] / p * weight, slope[n, grade] / p * weight
        by_z = high - low  # of the loss, as z enters with a minus
        by_cut = np.zeros(grades - 1)
        np.add.at(by_cut, np.minimum(grade, grades - 2), np.where(grade <= grades - 2, -high, 0))
        np.add.at(by_cut, np.maximum(grade - 1, 0), np.where(grade >= 1, low, 0))
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(at, weights=by_z[owner] * x, minlength=n_features) + l2 * w, [tail[0]], tail[1:] * gaps])
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
    gaps = np.exp(np.clip(theta[n_features + 1 :], -8, 8))
    return theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, min_g: float = MIN_G, grades: int = GRADES) -> Model:
    """A model from at most sample_rows rows of 0/1 labels and their texts."""
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    rows = bounded_sample(batched(docs).where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("t")), known, sample_rows, id_col)
    texts = rows.groupBy(F.xxhash64("t").alias("k")).agg(F.max("y").alias("y"), F.any_value("t").alias("t"))

    def distinct_words(batches):
        for batch in batches:
            ys, halves, words = [], [], []
            for text, y, k in zip(as_bytes(batch.column("t")), batch.column("y").to_pylist(), batch.column("k").to_pylist(), strict=True):
                own = {w.decode("utf-8", "ignore") for w in words_of(text)}
                words += own
                ys += [y] * len(own)
                halves += [k & 1] * len(own)
            yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "half": pa.array(halves, pa.int32()), "word": pa.array(words, pa.string())})

    totals = {(r.y, r.half): r.n for r in texts.groupBy("y", F.col("k").bitwiseAND(1).alias("half")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = (sum(totals.get((y, half), 0) for half in (0, 1)) for y in (1, 0))
    of = lambda y, half: F.when((F.col("y") == y) & (F.col("half") == half), 1).otherwise(0)
    counts = texts.mapInArrow(distinct_words, "y int, half int, word string").groupBy("word").agg(*[F.sum(of(y, half)).alias(f"c{y}{half}") for y in (1, 0) for half in (0, 1)])
    counts = counts.withColumn("a", F.col("c10") + F.col("c11")).withColumn("b", F.col("c00") + F.col("c01"))
    p, q = F.lit(n1 / max(1, n1 + n0)), F.col("a") / (F.col("a") + F.col("b"))
    part = lambda n, x: F.when(n > 0, n * F.log(x)).otherwise(0.0)
    g = 2 * (part(F.col("a"), q / p) + part(F.col("b"), (1 - q) / (1 - p)))
    markers = counts.where(g >= min_g).orderBy("word").collect() if n1 and n0 else []  # words of sample_rows rows, those that tell them apart
    empty = Model({r.word.encode(): i for i, r in enumerate(markers)}, np.zeros(len(markers)), np.full(grades - 1, 50.0))
    if not markers:
        return empty

    def featurize(batches):
        for batch in batches:
            out = [empty.features(t) for t in as_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "k": batch.column("k"), "at": [o[0].tolist() for o in out], "x": [o[1].tolist() for o in out]})

    fetched = texts.mapInArrow(featurize, "y int, k long, at array<long>, x array<double>").toPandas().sort_values("k")
    rows = [(np.asarray(a, dtype=np.int64), np.asarray(x, dtype=np.float64)) for a, x in zip(fetched["at"], fetched["x"], strict=True)]
    y, half = fetched["y"].to_numpy(), fetched["k"].to_numpy() & 1
    odds = np.array([[np.log((m[f"c1{h}"] + 0.5) / (totals.get((1, h), 0) + 1)) - np.log((m[f"c0{h}"] + 0.5) / (totals.get((0, h), 0) + 1)) for m in markers] for h in (0, 1)])
    evidence = np.array([odds[1 - h, a] @ x for (a, x), h in zip(rows, half, strict=True)])
    edges = np.quantile(evidence[y == 1], np.linspace(0, 1, grades)[1:-1])
    grade = np.where(y == 1, 1 + np.searchsorted(edges, evidence), 0)
    weights, cuts = fit_ordinal(rows, grade, len(markers), grades)
    return Model(empty.vocabulary, weights, cuts)


def severity(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs with severity (0 to grades - 1), p_toxic, grade and rejected."""

    @F.arrow_udf("severity double, p_toxic double, grade int")
    def score(text: pa.Array) -> pa.Array:
        out = np.array([model.score(t) for t in as_bytes(text)]).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32))], names=["severity", "p_toxic", "grade"])

    return batched(docs).withColumn("_score", score(text_col)).select(*others(docs, "severity", "p_toxic", "grade", "rejected"), "_score.*", (F.col("_score.p_toxic") >= reject).alias("rejected"))


def op5_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return severity(docs, train(docs, read_table(spark, sf_dir, "labels"))).drop("text")
