"""Byte-level BPE encoding and decoding by a prefix-sharing walk over a trie of distinct words.

A text is split at the special token's string and then into words by the byte-level pattern. The distinct words of some
megabytes of text go into a trie (held as their sorted order: depth-first order visits a shared prefix once). Each trie
node has a last-token state: the only token that ends the encoding of the node's prefix. It is the token t that is a
suffix of the prefix, whose own bytes encode as t, and before which the last token p of the shorter prefix stands such
that p + t encodes as [p, t]; this is so because any part of a merge-ordered encoding is itself the encoding of its
bytes. The states of the current path are a stack, so an encoding is read off backwards from the node of its last byte.
Encoded words are kept in a bounded cache per worker, which keeps the words of the present part when it is
full; that repeats some work and changes nothing.

Null text encodes as no tokens. Texts of any length are encoded whole, in parts of bounded size. Other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batched, others, read_table

CACHE_WORDS = 300_000
#: Where a task does nothing else and the worker isn't shared with other stages.
LARGE_CACHE = 900_000
#: Characters of text whose words are put into one trie.
GROUP_CHARS = 2_000_000
CHUNK_WORDS = 300_000

#: Fixed value: the byte-level pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level files have for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        to_byte = byte_of_symbol()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = doc["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        bytes_of = {i: raw(s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.token_of = {raw(s): i for s, i in vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in doc["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.token_of))
        self.endings = ahocorasick.Automaton()
        for t, i in self.token_of.items():
            self.endings.add_word(t.decode("latin-1"), (len(t), i))
        self.endings.make_automaton()
        #: How each token is made: rank of the rule, left and right token.
        self.made = {token: (rank, a, b) for (a, b), (rank, token) in self.merges.items()}
        #: Rules only join what earlier rules make, so merges run in order of rank.
        self.ordered = len(self.made) == len(self.merges) and all(self.made.get(x, (-1,))[0] < rank for (a, b), (rank, _) in self.merges.items() for x in (a, b))
        self.spine_of: dict[int, list[tuple[int, int, float]]] = {}
        self.follows: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        self.split_lazily = regex.compile(PATTERN).finditer
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by the merge rules themselves."""
        ids = [self.token_of[bytes([b])] for b in data]
        while len(ids) > 1:
            rank, at = min((self.merges.get((a, b), (1 << 60,))[0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(piece, rank that makes it, rank that uses it up) of the pieces that stand at one end of token while it is made."""
        key = token << 1 | side
        found = self.spine_of.get(key)
        if found is None:
            found, used = [], float("inf")
            while True:
                rank, *parts = self.made.get(token, (-1,))
                found.append((token, rank, used))
                if not parts:
                    break
                token, used = parts[side], rank
            self.spine_of[key] = found
        return found

    def stay_apart(self, last: int, token: int) -> bool:
        """Whether no rule joins pieces across the border of the two tokens while they are made.

        Of two places for the same rule the left one is taken: a rule across the border loses to one within last, and
        wins over one within token.
        """
        for x, made_x, used_x in self.spine(last, 1):
            for y, made_y, used_y in self.spine(token, 0):
                rank = self.merges.get((x, y), (None,))[0]
                if rank is not None and made_x < rank < used_x and made_y < rank <= used_y:
                    return False
        return True

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the bytes of both encode as these two; last -1: whether token's own bytes encode as token."""
        key = (last + 1) << 32 | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= self.cache_words:
                self.follows.clear()
            if self.ordered and last >= 0 and self.may_follow(-1, token):
                known = self.stay_apart(last, token)
            else:
                want = [token] if last < 0 else [last, token]
                known = self.merged(b"".join(self.table[i] for i in want)) == want
            self.follows[key] = known
        return known

    def encode_words(self, words) -> dict[str, bytes]:
        """The ids of each distinct word, as little-endian 32-bit integers."""
        out: dict[str, bytes] = {}
        endings, follows, may_follow, longest = self.endings.iter, self.follows.get, self.may_follow, self.longest
        prefix = b""
        state = [-1]  # last token of each prefix of the path
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for a, b in zip(prefix, data):
                if a != b:
                    break
                shared += 1
            del state[shared + 1 :]
            begin = max(0, shared - longest)
            for end, (size, token) in endings(data.decode("latin-1"), begin):
                # tokens that end here, the longest first; the state of this place is known once one fits
                if end == len(state) - 1:
                    last = state[end + 1 - size]
                    fits = follows((last + 1) << 32 | token)
                    if fits or (fits is None and may_follow(last, token)):
                        state.append(token)
            if len(state) <= len(data):
                raise ValueError("the merge rules give no encoding")
            prefix = data
            ids, n = [], len(data)
            while n:
                ids.append(state[n])
                n -= len(self.table[state[n]])
            out[word] = np.array(ids[::-1], dtype="<u4").tobytes()
        return out

    def forget(self) -> None:
        self.words, self.follows, self.spine_of = {}, {}, {}

    def _learn(self, words) -> None:
        own = set(words)
        fresh = own.difference(self.words)
        if len(self.words) + len(fresh) > self.cache_words:  # common words are among those of this part and stay
            self.words = {w: self.words[w] for w in own.difference(fresh)}
        if fresh:
            self.words |= self.encode_words(fresh)

    def _join(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def _ids(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        out, found = [], (m.group() for m in self.split_lazily(text)) if len(text) > GROUP_CHARS else iter(self.split(text))
        while words := list(islice(found, CHUNK_WORDS)):
            self._learn(words)
            out.append(self._join(words))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._ids(text)
        return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if x in self.special else self._ids(x) for x in self.at_special.split(text))

    def encode_all(self, texts: list[str | None]):
        """Yields the ids of each text; the words of several short texts share a trie."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size <= GROUP_CHARS:
                size += len(texts[end] or "")
                end += 1
            group = [t or "" for t in texts[begin:end]]
            alone = [len(t) > GROUP_CHARS or any(s in t for s in self.special) for t in group]
            words = [None if one else self.split(t) for t, one in zip(group, alone, strict=True)]
            fresh: set[str] = set()
            for w in words:
                fresh.update(w or ())
            self._learn(fresh)
            done = [None if w is None else self._join(w) for w in words]
            for t, ids in zip(group, done, strict=True):
                yield self.encode(t) if ids is None else ids
            begin = end

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@cache
def coder(path: str, cache_words: int = CACHE_WORDS) -> Coder:
    return Coder(path, cache_words)


def _texts(column) -> list[str | None]:
    return column.to_pylist()


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, an array of token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for text in texts:
            ids = list(own.encode_all(_texts(text)))
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
        own.forget()  # the worker may go on with other stages

    return batched(docs).withColumn(ids_col, encode(text_col))


def bpe_decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with text_col, the text of the ids (special tokens included); null ids give null."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else coder(path).decode(np.array(x, dtype="<u4").tobytes()) for x in ids.to_pylist()], type=pa.string())

    return batched(docs).withColumn(text_col, decode(ids_col))


def bpe_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, of a round trip within one task."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.arrow_udf(kind)
    def digest(text: pa.Array) -> pa.Array:
        own, n, ids_sha, decoded_sha = coder(path, LARGE_CACHE), [], [], []
        for ids in own.encode_all(_texts(text)):
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return batched(docs).withColumn("_digest", digest(text_col)).select(*others(docs, "n_tokens", "ids_sha256", "decoded_sha256"), "_digest.*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir):
    return bpe_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()).drop("text")
