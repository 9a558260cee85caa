"""Exact self-join on the Jaccard similarity of word n-gram sets, and the components of its links.

Method. Let two sets of sizes a <= b be linked; then their symmetric difference is at most (1 - t)(a + b)/(1 + t), t
being the threshold, and b <= a / t. Sizes fall into bands; the instance of a band finds the pairs whose smaller set is in
the band, so a set takes part in its own band's instance and, if it is small enough, in that of the band below. An
instance with largest difference H hashes the universe of n-grams into segments and gives each segment a number e of 0, 1
or 2 with sum H + 1. By the pigeonhole principle a linked pair has a segment in which it differs by less than e elements:
the two subsets are equal (e = 1), or equal up to one deletion (e = 2). Each set is indexed by a signature per subset
and, where e = 2, by one per subset less one element.

Allocation. Counting rows and collisions decides e. One pass over all texts adds up, per instance and segment, the number
of signatures and sign sums of their hashes (the square of a sign sum estimates how many pairs meet). A segment that many
sets share gets 0 and the cheapest other one 2 for it, as long as that lowers the cost; and an instance takes half as many
segments, all with e = 2, where that is cheaper. The choice changes the work, never the result.

Verification. Equal sets are one node. Nodes that share a signature are compared by a parity sketch (bit i is the parity
of the elements that hash to i; sketches differ in at most as many bits as the sets in elements, so this drops no link),
and a bucket yields a forest over the pairs that pass, not all pairs. The few forest edges that join different components
are verified on the texts' own sets. A bucket in which one fails is gone through again with the sets themselves, which
decides every pair between different components there. So no link between different components is missed, and no group
of copies is expanded. A bucket of more than ``BLOCK`` nodes, or of more than ``BLOCK_ELEMENTS`` elements in the second
pass, is dealt out in pairs of blocks.

Elements are 64-bit hashes of n-grams. Nodes are 64-bit hashes of sets, checked against a second hash; the salt changes
if two sets ever meet. A text with fewer than n words has one element, the whole sequence; null, empty and blank texts
have none and link with nothing. Rows without an id get a null component; rows that share an id
count as one document that has the links of all its texts. Which of several rows of an id comes first plays no part.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_SQL, as_bytes, batched, mix64, new_path, read_table, scratch, stored
from tessera.llm.components import components

RATIO = 1.5
BLOCK = 2048
BLOCK_ELEMENTS = 2_000_000
#: Cost of comparing two sketches, in units of handling one signature.
PAIR_COST = 0.03
SIGNS = 8
#: Instances with more segments than this keep the plain allocation, which bounds the table of counts.
COUNTED_SEGMENTS = 4096
#: Parts that the holders of a signature are dealt into.
SALTS = 16
#: Copies that a task remembers, so as not to index them again.
REMEMBERED = 100_000

_U = np.uint64


def shingles(text: bytes, n: int, salt: int = 0) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w, salt) for w in words], dtype=_U)
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, dtype=_U)
    for i in range(k):
        total = mix64(total * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(total)


class Bands:
    """Sizes, bands and largest differences for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = max(RATIO, den / num)
        top = 0
        while (top + 1) * den < num * (top + 2):  # such sets link with equal ones only
            top += 1
        self.tops = [top]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int((self.tops[-1] + 1) * ratio)))

    def difference(self, a, b):
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest_partner(self, a: int) -> int:
        return a * self.den // self.num

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(x) + len(y) - len(np.union1d(x, y))
        return self.den * both >= self.num * (len(x) + len(y) - both)

    def of(self, size: int) -> int:
        return bisect_left(self.tops, size)

    def h(self, instance: int) -> int:
        top = self.tops[instance]
        return self.difference(top, self.largest_partner(top))

    def instances(self, size: int) -> list[int]:
        own = self.of(size)
        below = own - 1
        return [i for i in (own, below) if i >= 1 and (i == own or size <= self.largest_partner(self.tops[i]))]

    def sketch_bits(self, size: int) -> int:
        own = self.of(size)
        return 64 if own < 1 else min(1 << 15, max(64, 1 << (8 * self.h(own) - 1).bit_length()))


class Elements:
    """A set's sorted elements, with the sums that the subsets' hashes are differences of."""

    def __init__(self, elements: np.ndarray):
        self.values = elements
        self.high = elements >> _U(32)
        self.mixed = mix64(elements ^ _U(0xA5A5A5A5A5A5A5A5))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.mixed, dtype=_U)])

    def __len__(self):
        return len(self.values)


class Segments:
    """One set's subsets under m segments; segments are ranges of elements, so subsets are slices."""

    def __init__(self, elements: Elements, instance: int, m: int, plan: int):
        self.of, self.m = elements, m
        edges = ((np.arange(m + 1, dtype=_U) << _U(32)) + _U(m - 1)) // _U(m)
        self.ends = np.searchsorted(elements.high, edges)
        self.sizes = np.diff(self.ends)
        self.whole = elements.sums[self.ends[1:]] - elements.sums[self.ends[:-1]]
        self.base = mix64((_U(instance * 4 + plan + 1) << _U(40)) + np.arange(m, dtype=_U))
        self.full = mix64(self.whole + self.base)

    def less(self) -> np.ndarray:
        """Signatures of the subsets without one element, by element."""
        at = np.repeat(np.arange(self.m), self.sizes)
        return mix64(self.whole[at] - self.of.mixed + self.base[at])

    def one_less(self) -> tuple[np.ndarray, np.ndarray]:
        """For each subset that has elements the signature without its first one, and the segments of these."""
        some = np.flatnonzero(self.sizes)
        return mix64(self.whole[some] - self.of.mixed[self.ends[:-1][some]] + self.base[some]), some

    def signatures(self, e: np.ndarray) -> np.ndarray:
        if not (e == 2).any():
            return self.full[e >= 1]
        return np.concatenate([self.full[e >= 1], self.less()[np.repeat(e == 2, self.sizes)]])


def _signs(keys: np.ndarray) -> np.ndarray:
    bits = np.unpackbits((keys >> _U(24)).astype(np.uint8)[:, None], axis=1)
    return 1 - 2 * bits.astype(np.int64)


class Counts:
    """Sums per instance and segment: sets, elements, sign sums of subsets and of subsets less one, and those of the halved plan."""

    def __init__(self, bands: Bands):
        self.bands, self.of = bands, {}

    def add(self, elements: Elements) -> None:
        for i in self.bands.instances(len(elements)):
            m = self.bands.h(i) + 1
            if m > COUNTED_SEGMENTS:
                continue
            if i not in self.of:
                self.of[i] = [np.zeros((m, 2 + 2 * SIGNS), dtype=np.int64), np.zeros((1, 2 + 2 * SIGNS), dtype=np.int64)]
            seg = Segments(elements, i, m, 0)
            table, halved = self.of[i]
            table[:, 0] += 1
            table[:, 1] += seg.sizes
            table[:, 2 : 2 + SIGNS] += _signs(seg.full)
            keys, some = seg.one_less()
            table[some, 2 + SIGNS :] += _signs(keys)
            half = Segments(elements, i, -(-m // 2), 1)
            halved[0, 0] += half.m
            halved[0, 1] += len(elements)
            halved[0, 2 : 2 + SIGNS] += _signs(half.full).sum(axis=0)
            halved[0, 2 + SIGNS :] += _signs(half.one_less()[0]).sum(axis=0)

    def rows(self):
        for i, (table, halved) in sorted(self.of.items()):
            for segment, row in [*enumerate(table), (-1, halved[0])]:
                yield i, segment, row


def allocate(counts: np.ndarray, halved: np.ndarray) -> tuple[int, np.ndarray]:
    """(plan, e): counts has a row per segment, as Counts; halved is the row of the halved plan.

    The sign sums of subsets less one stand for one of a subset's deletions; all of them meet about size^2 times as often.
    """

    def costs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = t[:, 0].astype(float), t[:, 1].astype(float)
        meet = lambda signs: np.maximum(0, (signs.astype(float) ** 2).mean(axis=1) - n) / 2
        full = meet(t[:, 2 : 2 + SIGNS])
        return n + PAIR_COST * full, n + size + PAIR_COST * (full + meet(t[:, 2 + SIGNS :]) * np.maximum(1, size / np.maximum(n, 1)) ** 2)

    one, two = costs(counts)
    n = counts[:, 0]
    e = np.ones(len(n), dtype=np.int64)
    heavy, cheap = np.argsort(-one, kind="stable"), np.argsort(two - one, kind="stable")
    i = j = 0
    while i < len(n) and j < len(n):
        while j < len(n) and e[cheap[j]] != 1:
            j += 1
        while i < len(n) and e[heavy[i]] != 1:
            i += 1
        if i >= len(n) or j >= len(n) or heavy[i] == cheap[j] or one[heavy[i]] <= (two - one)[cheap[j]]:
            break
        e[heavy[i]], e[cheap[j]] = 0, 2
    cost = one[e == 1].sum() + two[e == 2].sum()
    if costs(halved[None])[1][0] < cost:
        return 1, np.full(-(-len(n) // 2), 2)
    return 0, e


def set_hashes(elements: Elements) -> tuple[int, int]:
    a = mix64(elements.sums[-1:] + _U(len(elements)))
    b = mix64(mix64(elements.values + _U(0x7F4A7C159E3779B9)).sum(dtype=_U, keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def sketch(elements: np.ndarray, bits: int) -> bytes:
    at = (mix64(elements ^ _U(0x1234567)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the length of the shortest."""
    words = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), words), dtype=_U)
    for i, s in enumerate(sketches):
        row = np.frombuffer(s, dtype=_U)
        out[i] = np.bitwise_xor.reduce(row.reshape(-1, words), axis=0) if len(row) > words else row
    return out


def _near(i: int, rest: np.ndarray, sizes: np.ndarray, words: np.ndarray, bands: Bands) -> np.ndarray:
    """Those of the positions rest whose sketches allow a link with position i."""
    far = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype=np.int64)
    a, b = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
    return rest[(far <= bands.difference(a, b)) & (b * bands.num <= a * bands.den)]


def forest(sizes: np.ndarray, words: np.ndarray, bands: Bands, component: np.ndarray, sets: list[np.ndarray] | None = None):
    """Pairs of positions that join different components, one for each two components that meet.

    A pair counts if its sketches allow a link and, with sets given, if it is linked.
    """
    comp = component.copy()
    out = []
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if not len(rest):
            continue
        for j in _near(i, rest, sizes, words, bands).tolist():
            if comp[j] != comp[i] and (sets is None or bands.linked(sets[i], sets[j])):
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def may_link(sizes: np.ndarray, words: np.ndarray, bands: Bands, component: np.ndarray) -> np.ndarray:
    """Positions whose sketches allow a link with one of another component."""
    open_ = np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        near = _near(i, rest, sizes, words, bands) if len(rest) else rest
        open_[near] = True
        open_[i] |= len(near) > 0
    return np.flatnonzero(open_)


_DOCS = "id long, t long, size long, h0 long, h1 long, sketch binary, instance int, segment int, " + ", ".join(f"c{i} long" for i in range(2 + 2 * SIGNS))


def _described(docs: DataFrame, id_col: str, text_col: str, n: int, bands: Bands, salt: int) -> DataFrame:
    """A row per document and, from the same pass, the rows of Counts."""

    def describe(batches):
        counts, seen = Counts(bands), set()
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column("t")):
                s = Elements(shingles(text, n, salt))
                h = set_hashes(s) if len(s) else (0, 0)
                rows.append((len(s), *h, sketch(s.values, bands.sketch_bits(len(s))) if bands.of(len(s)) else None))
                if h[0] not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h[0])
                    counts.add(s)
            none = pa.nulls(len(rows), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("x"), *columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int32()), *[none] * (2 + 2 * SIGNS)], names=names)
        found = list(counts.rows())
        none = pa.nulls(len(found), pa.int64())
        table = np.array([r for _, _, r in found], dtype=np.int64).reshape(-1, 2 + 2 * SIGNS)
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(found), pa.binary()), pa.array([i for i, _, _ in found], pa.int32()), pa.array([s for _, s, _ in found], pa.int32()), *(pa.array(table[:, k]) for k in range(2 + 2 * SIGNS))], names=names)

    names = [c.split()[0] for c in _DOCS.split(", ")]
    return batched(docs).select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t")).mapInArrow(describe, _DOCS)


def _plans(counted: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """The allocation of each counted instance; the sums have a row per segment, whatever the number of documents."""
    columns = [f"c{i}" for i in range(2 + 2 * SIGNS)]
    sums = counted.groupBy("instance", "segment").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("instance", "segment").toPandas()
    out = {}
    for i, part in sums.groupby("instance"):
        table = part[columns].to_numpy()
        out[int(i)] = allocate(table[1:], table[0])
    return out


def _signatures(docs: DataFrame, text_col: str, n: int, bands: Bands, salt: int, plans: dict) -> DataFrame:
    def index(batches):
        seen = set()
        for batch in batches:
            sigs, nodes, size = [], [], 0
            for text in as_bytes(batch.column("t")):
                s = Elements(shingles(text, n, salt))
                if not bands.of(len(s)):
                    continue
                h, _ = set_hashes(s)
                if h in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(h)
                for i in bands.instances(len(s)):
                    plan, e = plans.get(i) or (0, np.ones(bands.h(i) + 1, dtype=np.int64))
                    sigs.append(Segments(s, i, len(e), plan).signatures(e))
                    nodes.append(np.full(len(sigs[-1]), h, dtype=np.int64))
                    size += len(sigs[-1])
                if size >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
                    sigs, nodes, size = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(index, "sig long, node long")


def _with_salts(keys: DataFrame) -> DataFrame:
    """keys by signature, once for each salt that rows of a signature have."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")


def _buckets(signatures: DataFrame) -> DataFrame:
    """(sig, salt, node, members) of the signatures that several nodes share; of buckets with the same members one stays.

    Most signatures have one holder, so all rows are dealt out by signature once; the rows that are left are narrow and
    few, and from there on a signature's holders are dealt out by a salt.
    """
    rows = signatures.repartition("sig").dropDuplicates(["sig", "node"])
    w = Window.partitionBy("sig")
    rows = rows.select("sig", "node", F.count("*").over(w).alias("members"), F.bit_xor(F.xxhash64("node")).over(w).alias("x0"), F.bit_xor(F.xxhash64("node", F.lit(7))).over(w).alias("x1")).where("members > 1")
    rows = stored(rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS).cast("long"))), "buckets")
    one = rows.groupBy("members", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig")
    return rows.join(_with_salts(one), ["sig", "salt"], "left_semi").select("sig", "salt", "node", "members")


def _by_bucket(rows: DataFrame, columns: list[str], close, schema: str, blocks) -> DataFrame:
    """close(key, rows) for the rows of each bucket, or of each pair of its blocks; keys are (sig, part)."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long"))
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches):
        key, waiting = None, []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))], names=names)

        for batch in batches:
            out = []
            for sig, part, *row in zip(*(batch.column(c).to_pylist() for c in ("sig", "part", *columns)), strict=True):
                if (sig, part) != key:
                    out += close(key, waiting) if len(waiting) > 1 else []
                    key, waiting = (sig, part), []
                waiting.append(row)
            yield batch_of(out)
        yield batch_of(close(key, waiting) if len(waiting) > 1 else [])

    return rows.select("sig", "part", *columns).repartition("sig", "part").sortWithinPartitions("sig", "part").mapInArrow(scan, schema)


def _candidates(buckets: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """(sig, a, b): forests of the pairs that pass the sketches."""

    def close(key, rows):
        rows.sort(key=lambda r: r[0])
        pairs = forest(np.array([r[1] for r in rows], dtype=np.int64), _folded([r[2] for r in rows]), bands, np.arange(len(rows)))
        return [(key[0], rows[i][0], rows[j][0]) for i, j in pairs]

    rows = buckets.join(nodes.select("node", "id", "size", "sketch"), "node")
    return _by_bucket(rows, ["id", "size", "sketch"], close, "sig long, a long, b long", F.ceil(F.col("members") / BLOCK))


def _components_of(rows: list) -> np.ndarray:
    """Numbers of the components of rows (id, .., component); one without a component is its own."""
    number: dict[int, int] = {}
    return np.array([number.setdefault(r[-1] if r[-1] is not None else r[0], len(number)) for r in rows])


def _open_members(buckets: DataFrame, nodes: DataFrame, found: DataFrame, bands: Bands) -> DataFrame:
    """(sig, id) of the members that by their sketches may link with one of another component: narrow rows, no texts."""

    def close(key, rows):
        rows.sort(key=lambda r: r[0])
        at = may_link(np.array([r[1] for r in rows], dtype=np.int64), _folded([r[2] for r in rows]), bands, _components_of(rows))
        return [(key[0], rows[i][0]) for i in at.tolist()]

    rows = buckets.join(nodes.select("node", "id", "size", "sketch"), "node").join(found, "id", "left")
    return _by_bucket(rows, ["id", "size", "sketch", "component"], close, "sig long, id long", F.ceil(F.col("members") / BLOCK)).distinct()


def _exact_links(buckets: DataFrame, nodes: DataFrame, texts: DataFrame, found: DataFrame, n: int, bands: Bands, salt: int) -> DataFrame:
    """(a, b): links between different components of found within the buckets, decided on whole sets.

    Texts move only for members that the sketches leave open, and of buckets with the same ones once.
    """

    def close(_, rows):
        rows.sort(key=lambda r: r[0])
        sets = [shingles((r[1] or "").encode(), n, salt) for r in rows]
        comp = _components_of(rows)
        if comp.max() == 0:
            return []
        bits = min(1 << 16, 1 << (64 * bands.h(max(1, bands.of(max(map(len, sets))))) - 1).bit_length())
        words = _folded([sketch(s, max(64, bits)) for s in sets])
        return [(rows[i][0], rows[j][0]) for i, j in forest(np.array(list(map(len, sets))), words, bands, comp, sets)]

    rows = stored(_open_members(buckets, nodes, found, bands), "open").join(nodes.select("id", "size"), "id")
    per = rows.groupBy("sig").agg(F.count("*").alias("members"), F.sum("size").alias("elements"), F.bit_xor(F.xxhash64("id")).alias("x0"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("x1"))
    # two that are left open are a candidate, and one that has failed
    one = per.where("members > 2").groupBy("members", "elements", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig", "members", "elements")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS).cast("long"))).join(_with_salts(one), ["sig", "salt"]).join(found, "id", "left").join(texts, "id")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS))
    return _by_bucket(rows, ["id", "text", "component"], close, "a long, b long", blocks)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, bands: Bands, salt: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b), by the sets of their texts."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches):
        known = lru_cache(maxsize=64)(lambda text: shingles(text, n, salt))
        for batch in batches:
            linked = []
            for ta, tb in zip(as_bytes(batch.column("ta")), as_bytes(batch.column("tb")), strict=True):
                x, y = known(ta), shingles(tb, n, salt)
                linked.append(bands.linked(x, y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, linked boolean")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) after more links (a, b): only the components that these join are gone through again."""
    side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    between = stored(between.where("a <> b").distinct(), "between")
    if between.isEmpty():
        return found
    over = components(between)
    up = found.join(over.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return stored(up.union(over.join(found.select("id"), "id", "left_anti").select("id", "component")), "components")


def _components(docs: DataFrame, nodes: DataFrame, plans: dict, n: int, bands: Bands, salt: int, id_col: str, text_col: str) -> DataFrame:
    """(id, component) of the nodes that links join."""
    buckets = _buckets(_signatures(docs.where(F.col(text_col).isNotNull()), text_col, n, bands, salt, plans))
    buckets = stored(buckets, "buckets")
    edges = stored(_candidates(buckets, nodes, bands), "candidates")
    # only ends of candidates are compared by their sets: a member that sketches leave open is one
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    members = ends.join(nodes, "node").select(F.col("first.id").alias("id"), F.col("first.t").alias("t"), "node")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("id is not null").join(members, ["id", "t"])
    texts = stored(texts.dropDuplicates(["id", "t"]).select(F.col("node").alias("id"), "text"), "texts")
    # first the smallest partner of each node, then the pairs that still join different components
    checked = stored(_verified(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, n, bands, salt), "checked")
    found = components(checked.where("linked").select("a", "b"))
    side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    rest = edges.select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")
    rest = stored(rest.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        also = stored(_verified(rest, texts, n, bands, salt), "checked")
        found, checked = _joined(found, also.where("linked").select("a", "b")), checked.union(also)
    failed = stored(edges.join(checked.where("not linked").select("a", "b"), ["a", "b"]).select("sig").distinct(), "failed")
    if not failed.isEmpty():
        # the one pair of a bucket of two is decided by now
        found = _joined(found, _exact_links(buckets.where("members > 2").join(_with_salts(failed), ["sig", "salt"], "left_semi"), nodes, texts, found, n, bands, salt))
    return found


def near_groups(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", one_per_id: bool = False) -> DataFrame:
    """(id, t, size, first) per row; t is xxhash64 of the text, first the smallest (id, t) that links reach from the row.

    The vertices of the links are sets, so each text of a shared id has its own links; with one_per_id all texts of an id
    are linked besides. Rows without an id have a null first.
    """
    bands, salt = Bands(num, den), 0
    while True:
        described = stored(_described(docs, id_col, text_col, n, bands, salt), "described")
        rows = described.where("instance is null")
        nodes = rows.where("size > 0").groupBy("h0").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "t"))).alias("first"), F.max("size").alias("size"), F.min("size").alias("least"), F.max("sketch").alias("sketch"), F.max("h1").alias("h1"), F.min("h1").alias("other"))
        nodes = stored(nodes.withColumnRenamed("h0", "node"), "nodes")
        if nodes.where("h1 <> other or size <> least").isEmpty():
            break
        salt += 1
    nodes = nodes.where("first is not null").select("node", "first", F.col("node").alias("id"), "size", "sketch")
    kept = new_path(docs.sparkSession, "components")
    with scratch(docs.sparkSession):  # signatures, texts and pairs go before the documents move again
        plans = _plans(described.where("instance is not null"))
        _components(docs, nodes, plans, n, bands, salt, id_col, text_col).write.parquet(kept)
    found = docs.sparkSession.read.schema("id long, component long").parquet(kept)
    rows = rows.select("id", "t", "size", F.col("h0").alias("node"))
    if one_per_id:
        shared = rows.where("size > 0 and id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
        found = _joined(found, rows.where("size > 0").join(shared, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    found = found.withColumnRenamed("id", "node")
    linked = nodes.select("node", "first").join(found, "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    copies = rows.join(nodes.select("node", F.col("first").alias("own")), "node", "left").join(found.join(least, "component").select("node", "least"), "node", "left")
    first = F.when(F.col("size") > 0, F.coalesce("least", "own")).otherwise(F.struct("id", "t"))
    return copies.select("id", "t", "size", F.when(F.col("id").isNotNull(), first).alias("first"))


def near_duplicates(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id that links reach, the own id included."""
    out = near_groups(docs, n, num, den, id_col, text_col, one_per_id=True)
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("first.id").alias("component_id"))


def op2_jaccard_join(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
k AS (SELECT doc_id, g, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS node FROM s),
r AS (SELECT node, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM k WHERE n > 0 GROUP BY node),
e AS (SELECT id, n, unnest(g) AS x FROM r),
l AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
        GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, to_id) AS (SELECT id, id FROM r UNION SELECT c.id, t.b FROM c JOIN t ON c.to_id = t.a),
o AS (SELECT id, min(to_id) AS component FROM c GROUP BY id)
SELECT doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM k LEFT JOIN r ON r.node = k.node AND k.n > 0 LEFT JOIN o USING (id)
"""  # noqa: S608
