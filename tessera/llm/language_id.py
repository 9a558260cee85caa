"""Language of text by a linear-chain conditional random field over words.

A word's features are its byte n-grams of two to four bytes with the word's ends marked (so that prefixes and suffixes
are among them) and the whole word, as a lexicon; each hashes to one of ``TABLE`` rows of weights, one weight per
language. Transition weights are learned with them. A text is one chain, whatever its length, so code-switched text gets
its own label per word by forward-backward; a document's score of a language is the mean of its words' posteriors, its
language the one with the largest score (ties: the first by name).

Forward-backward over a chain goes by blocks of ``BLOCK`` words. The product of a block's transition matrices carries the
forward message from its first word to the next block's and the backward message the other way, so the blocks of all
texts are worked on together and the result is that of the unbroken chain.

Training takes at most ``sample_rows`` labelled rows, chosen by a hash of their id, and all words of them, in sequences of
``BLOCK`` words; as many again are pieces of random length from several of these texts put together, which is how
transitions between languages are seen. Words are lower-cased runs of ASCII letters and of bytes beyond ASCII; a text that
is null or has no letter is ``und`` with score 0. Without labelled rows every text is ``und``. Rows that share an id are
each predicted; the sample is of distinct pairs of id and label, and takes all texts of such an id. Other columns pass
through, those named like a result are replaced. Prediction reads whole texts, in groups of bounded size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, batched, bounded_sample, fold_of, mix64, others, read_table

TABLE = 1 << 16
BLOCK = 64
SAMPLE_ROWS = 600
ORDERS = (2, 3, 4)
HELD_OUT = 2
UNKNOWN = "und"
#: Bytes of text that are labelled in one round.
ROUND = 3_000_000

_LETTER = re.compile(rb"[A-Za-z]")
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(_FOLD).split()
    if words and not _LETTER.search(text) and not any(c.isalpha() for c in text.decode("utf-8", "ignore")):
        return []  # only marks beyond ASCII
    return words


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, row): the table rows of each word's features, by word."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, rows = [], []
    rolled = data.copy()
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(257) + data[n - 1 :]
        if n in ORDERS:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            owners.append(owner[: len(rolled)][inside])
            rows.append(mix64(rolled[inside] + np.uint64(n << 48)) % np.uint64(TABLE))
    whole = np.zeros(len(words), dtype=np.uint64)
    if len(words):
        places = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.add.reduceat(mix64(data + (places.astype(np.uint64) << np.uint64(8))), np.cumsum(sizes) - sizes)
    owners.append(np.arange(len(words)))
    rows.append(mix64(whole) % np.uint64(TABLE))
    owner, row = np.concatenate(owners), np.concatenate(rows).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], row[order]


@dataclass
class Field:
    labels: list[str]
    emit: np.ndarray  # TABLE x labels, float32
    move: np.ndarray  # labels x labels

    def potentials(self, words: list[bytes]) -> np.ndarray:
        """Emission scores per word."""
        owner, row = features(words)
        return np.add.reduceat(self.emit[row], np.searchsorted(owner, np.arange(len(words))), axis=0)


def forward_backward(score: np.ndarray, move: np.ndarray, length: np.ndarray):
    """Posteriors of labels (n x steps x labels) and summed ones of moves, for padded chains of the given lengths."""
    n, steps, k = score.shape
    inside = np.arange(steps)[None, :] < length[:, None]
    e = np.exp(score - score.max(axis=2, keepdims=True))
    e[~inside] = 1.0
    a = np.exp(move - move.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        x /= x.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(inside[:, t + 1, None], x, 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    post[~inside] = 0.0
    pair = np.zeros((k, k))
    for t in range(steps - 1):
        live = inside[:, t + 1]
        x = alpha[live, t][:, :, None] * a[None] * (e[live, t + 1] * beta[live, t + 1])[:, None, :]
        pair += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, pair


def chain_posteriors(score: np.ndarray, move: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label posteriors (blocks x steps x labels) of chains that are cut into blocks.

    score and length are those of blocks, first tells which of them begin a chain; only the last block of a chain may be
    short. Messages cross the cuts.
    """
    n, steps, k = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True)).astype(np.float64).transpose(1, 0, 2).copy()
    inside = np.arange(steps)[:, None] < length[None, :]
    e[~inside] = 1.0
    a = np.exp(move - move.max())
    into, behind = np.ones((n, k)), np.ones((n, k))  # what a block's first word hears from before, its last one from behind
    cut = np.flatnonzero(~first)
    if len(cut):
        both = np.union1d(cut - 1, cut)  # the blocks of chains of several blocks
        product = e[0][both][:, None, :] * np.eye(k)
        for t in range(1, steps):
            x = (product.reshape(-1, k) @ a).reshape(-1, k, k) * e[t][both][:, None, :]
            product = np.where(inside[t][both][:, None, None], x / x.sum(axis=(1, 2), keepdims=True), product)
        place = np.full(n, -1)
        place[both] = np.arange(len(both))
        for i in cut:
            x = into[i - 1] @ product[place[i - 1]] @ a
            into[i] = x / x.sum()
        for i in cut[::-1]:
            x = a @ (product[place[i]] @ behind[i])
            behind[i - 1] = x / x.sum()
    alpha = np.empty_like(e)
    alpha[0] = e[0] * into
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[t - 1] @ a) * e[t]
        alpha[t] = x / x.sum(axis=1, keepdims=True)
    beta = behind
    for t in range(steps - 1, -1, -1):
        post = alpha[t] * beta
        alpha[t] = post / post.sum(axis=1, keepdims=True)
        if t:
            x = (e[t] * beta) @ a.T
            beta = np.where(inside[t][:, None], x / x.sum(axis=1, keepdims=True), behind)
    return alpha.transpose(1, 0, 2)


def fit(sequences: list[tuple[list[bytes], np.ndarray]], labels: list[str], epochs: int = 2, rate: float = 0.15, l2: float = 1e-6, batch: int = 128) -> Field:
    """Weights by Adagrad on the conditional likelihood; sequences are words and label numbers."""
    k = len(labels)
    emit, move = np.zeros((TABLE, k)), np.zeros((k, k))
    emit2, move2 = np.full_like(emit, 1e-3), np.full_like(move, 1e-3)
    for epoch in range(epochs):
        for i in range(0, len(sequences), batch):
            part = sequences[i : i + batch]
            words = [w for s, _ in part for w in s]
            length = np.array([len(s) for s, _ in part])
            owner, row = features(words)
            seq, at = np.repeat(np.arange(len(part)), length), np.concatenate([np.arange(n) for n in length])
            scores = np.zeros((len(part), BLOCK, k))
            scores[seq, at] = np.add.reduceat(emit[row], np.searchsorted(owner, np.arange(len(words))), axis=0)
            post, pair = forward_backward(scores, move, length)
            gold = np.concatenate([y for _, y in part])
            diff = post[seq, at]
            diff[np.arange(len(words)), gold] -= 1
            joined = at[1:] > 0
            truth = np.bincount(gold[:-1][joined] * k + gold[1:][joined], minlength=k * k).reshape(k, k)
            g = np.stack([np.bincount(row, weights=diff[owner, j], minlength=TABLE) for j in range(k)], axis=1) / len(part) + l2 * emit
            emit2 += g * g
            emit -= rate * g / np.sqrt(emit2)
            gm = (pair - truth) / len(part)
            move2 += gm * gm
            move -= rate * gm / np.sqrt(move2)
    return Field(labels, emit.astype(np.float32), move)


def sequences_of(texts: list[tuple[str, list[bytes]]], labels: list[str], seed: int = 11) -> list[tuple[list[bytes], np.ndarray]]:
    """All words of the texts in sequences of up to BLOCK words, and as many sequences spliced from several of them."""
    rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(labels)}
    pieces = [(lang, words[i : i + BLOCK]) for lang, words in texts for i in range(0, len(words), BLOCK)]
    out = [(w, np.full(len(w), number[lang])) for lang, w in pieces]
    for _ in range(len(out)):
        words, gold = [], []
        while len(words) < BLOCK:
            lang, w = pieces[rng.integers(len(pieces))]
            n = int(rng.integers(4, 33))
            start = int(rng.integers(max(1, len(w) - n + 1)))
            got = w[start : start + n]
            words += got
            gold += [number[lang]] * len(got)
        out.append((words[:BLOCK], np.array(gold[:BLOCK])))
    rng.shuffle(out)
    return out


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Field | None:
    """A field from the whole texts of at most sample_rows rows with label and text."""
    named = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = bounded_sample(batched(docs).select(id_col, F.col(text_col).alias("t")), named.select(id_col, F.col(label_col).cast("string").alias("y")).distinct(), sample_rows, id_col)
    got = sorted({(r.y, r.t) for r in rows.where("t is not null").select("y", "t").toLocalIterator()})
    texts = [(y, words) for y, words in ((y, words_of(t.encode())) for y, t in got) if words]
    if not texts:
        return None
    labels = sorted({y for y, _ in texts})
    return fit(sequences_of(texts, labels), labels)


def label_words(field: Field, texts: list[bytes]):
    """Yields (words, posteriors) of each text, in rounds of bounded size."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and size <= ROUND:
            size += len(texts[end])
            end += 1
        docs = [words_of(t) for t in texts[begin:end]]
        number: dict[bytes, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in docs]
        full = [-(-len(i) // BLOCK) for i in ids]
        starts = np.cumsum([0, *full])
        post = np.zeros((0, len(field.labels)))
        if number:
            score = field.potentials(list(number))
            padded = np.zeros((starts[-1] * BLOCK, score.shape[1]), dtype=np.float32)
            length, first = np.full(starts[-1], BLOCK), np.zeros(starts[-1], dtype=bool)
            for i, s, n in zip(ids, starts, full, strict=False):
                padded[s * BLOCK : s * BLOCK + len(i)] = score[i]
                if n:
                    length[s + n - 1] = len(i) - BLOCK * (n - 1)
                    first[s] = True
            post = chain_posteriors(padded.reshape(-1, BLOCK, score.shape[1]), field.move, length, first).reshape(-1, score.shape[1])
        for words, s in zip(docs, starts, strict=False):
            yield words, post[s * BLOCK : s * BLOCK + len(words)]
        begin = end


def identify(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and word_shares (language -> share of words)."""

    @F.arrow_udf("lang_pred string, score double, word_shares array<double>")
    def predict(text: pa.Array) -> pa.Array:
        names, scores, shares = [], [], []
        for words, post in label_words(field, as_bytes(text)) if field else ((None, None) for _ in range(len(text))):
            if not words:
                names.append(UNKNOWN)
                scores.append(0.0)
                shares.append([])
                continue
            mean = post.mean(axis=0)
            names.append(field.labels[int(mean.argmax())])
            scores.append(float(min(1.0, mean.max())))
            shares.append((np.bincount(post.argmax(axis=1), minlength=len(mean)) / len(words)).tolist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], names=["lang_pred", "score", "word_shares"])

    return batched(docs).withColumn("_lang", predict(text_col)).select(*others(docs, "lang_pred", "score", "word_shares"), "_lang.*")


def op3_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = train(docs.where(fold_of("doc_id") != HELD_OUT))
    out = identify(docs.select("doc_id", "text"), field)
    return out.select("doc_id", F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
