"""Nearest neighbours by inner product with one vantage-point tree per shard.

Vectors are dealt by a hash of their id into shards of about ``shard_rows`` rows; a task builds a shard's tree. Inside a
shard each vector x gets one more component sqrt(M^2 - |x|^2), M being the shard's largest norm, and a query q is scaled
to norm M with 0 there: Euclidean distance then orders as the inner product does, and it is a metric, so the triangle
inequality holds. A tree node splits its rows at the median distance to a vantage row; a block of queries walks the tree
together, first to each query's home leaf, then to every subtree that the inequality leaves. A subtree whose lower bound
is b goes unless ``factor`` * b <= tau, tau being the distance of the k-th best so far: factor 1 is exact, larger ones
prune more. Queries are a stated subset; their blocks meet every shard by an equi-join, and the k best of each shard are
merged per query. A task holds one shard and one block, whatever the table's size.

Vectors that are null, zero, or hold null or non-finite components take no part, and neither do null ids; vectors of
unlike lengths are never compared. Ids may be negative; of rows that share an id and a length the one with the smallest
vector (component by component) counts. Ties go to the smaller id. Empty tables give no rows. Trees hold vectors scaled by
a power of two, which is exact, so that no square over- or underflows; a score is scaled back.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import read_table, stored

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
LEAF_ROWS = 64
#: Exact. Recall and share of pairs scored by factor, over 10,256 nearly uncorrelated vectors of 64 components:
#: 1: 1.00, 0.99; 4: 0.999, 0.99; 6: 0.98, 0.92; 8: 0.91, 0.76; 12: 0.69, 0.44.
FACTOR = 1.0


class VPTree:
    """A balanced tree in preorder: rows are permuted so that every subtree is a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        vectors, self.shift = _scaled(vectors)
        norm2 = (vectors * vectors).sum(axis=1)
        self.top = float(np.sqrt(norm2.max()))
        extra = np.sqrt(np.maximum(self.top**2 - norm2, 0.0))
        order = np.lexsort((ids,))
        nodes: list[tuple[int, int, int, int, float]] = []  # begin, end, vantage row or -1, index of the outer child, radius
        todo = [(0, len(ids), -1)]
        while todo:
            begin, end, parent = todo.pop()
            here = len(nodes)
            if parent >= 0:
                nodes[parent] = (*nodes[parent][:3], here, nodes[parent][4])
            if end - begin <= leaf_rows:
                nodes.append((begin, end, -1, -1, 0.0))
                continue
            rows = order[begin:end]
            # the row farthest from the first one spreads distances widely and needs no random choice
            far = self._distance(vectors, extra, rows, rows[0])
            vantage = rows[int(far.argmax())]
            d = self._distance(vectors, extra, rows, vantage)
            ranked = np.argsort(d, kind="stable")
            order[begin:end] = rows[ranked]
            half = (end - begin) // 2
            nodes.append((begin, end, int(vantage), -1, float(d[ranked[half - 1]])))
            todo += [(begin + half, end, here), (begin, begin + half, -1)]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes = [(b, e, int(place[v]) if v >= 0 else -1, o, r) for b, e, v, o, r in nodes]

    @staticmethod
    def _distance(vectors, extra, rows, p):
        diff = vectors[rows] - vectors[p]
        return np.sqrt((diff * diff).sum(axis=1) + (extra[rows] - extra[p]) ** 2)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR):
        """(ids, scores, real, visited): the k best rows of each query, which of them are no padding, how many pairs were scored."""
        n = len(queries)
        queries, shift = _scaled(queries, by_row=True)
        scale = self.top / np.sqrt((queries * queries).sum(axis=1))
        best = np.full((n, k), -np.inf)
        found = np.zeros((n, k), dtype=np.int64)
        tau = np.full(n, np.inf)
        visited = 0

        def score(at, begin, end):
            nonlocal visited
            visited += len(at) * (end - begin)
            ids = self.ids[begin:end]
            s = np.einsum("ij,kj->ik", queries[at], self.vectors[begin:end])
            s[ids[None, :] == query_ids[at][:, None]] = -np.inf
            fresh = np.flatnonzero((s >= best[at, -1][:, None]).any(axis=1))
            at, s = at[fresh], s[fresh]
            if len(at):
                every = np.concatenate([best[at], s], axis=1)
                names = np.concatenate([found[at], np.broadcast_to(ids, s.shape)], axis=1)
                order = np.lexsort((names, -every), axis=1)[:, :k]
                best[at] = np.take_along_axis(every, order, axis=1)
                found[at] = np.take_along_axis(names, order, axis=1)
                tau[at] = np.sqrt(np.maximum(2 * self.top**2 - 2 * best[at, -1] * scale[at], 0.0))

        def to(vantage, at):
            return np.sqrt(np.maximum(2 * self.top**2 - 2 * scale[at] * (queries[at] @ self.vectors[vantage]), 0.0))

        home = np.full(n, -1)
        todo = [(0, np.arange(n))]
        while todo:  # each query's own leaf, for a first tau
            here, at = todo.pop()
            begin, end, vantage, outer, radius = self.nodes[here]
            if vantage < 0:
                home[at] = here
                score(at, begin, end)
                continue
            near = to(vantage, at) <= radius
            todo += [(c, at[m]) for c, m in ((here + 1, near), (outer, ~near)) if m.any()]
        # distances come from differences of nearly equal squares, so those near 0 are off by up to the root of the rounding error
        slack = 2e-7 * self.top
        todo = [(0, np.arange(n))]
        while todo:
            here, at = todo.pop()
            begin, end, vantage, outer, radius = self.nodes[here]
            if vantage < 0:
                at = at[home[at] != here]
                if len(at):
                    score(at, begin, end)
                continue
            d = to(vantage, at)
            inner = factor * (d - radius) <= tau[at] + slack
            outside = factor * (radius - d) <= tau[at] + slack
            todo += [(c, at[m]) for c, m in ((outer, outside), (here + 1, inner)) if m.any()]
        return found, np.ldexp(best, (self.shift + shift)[:, None]), np.isfinite(best), visited

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, nodes=np.array(self.nodes, dtype=np.float64).reshape(-1, 5), top=self.top, shift=self.shift)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> VPTree:
        tree, z = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.ids, tree.vectors, tree.top, tree.shift = z["ids"], z["vectors"], float(z["top"]), int(z["shift"])
        tree.nodes = [(int(b), int(e), int(v), int(o), float(r)) for b, e, v, o, r in z["nodes"]]
        return tree


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, dim) of the vectors that take part, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def _scaled(vectors: np.ndarray, by_row: bool = False):
    """vectors with a largest component of about 1 (of all, or of each row), and the power of two that was taken out."""
    largest = np.abs(vectors).max(axis=1) if by_row else np.abs(vectors).max()
    shift = np.frexp(largest)[1]
    return np.ldexp(vectors, -shift[:, None] if by_row else -shift), shift


def _matrix(column, dim: int) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column]).reshape(-1, dim)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, shards, tree): every usable row is in exactly one tree."""
    rows = usable(vectors, id_col, vector_col)
    shards = -(-max(1, rows.count()) // shard_rows)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def build(pdf):
        dim = int(pdf["dim"].iloc[0])
        ids, vectors = pdf["id"].to_numpy(), _matrix(pdf["v"], dim)
        order = np.lexsort((*vectors.T[::-1], ids))
        first = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
        tree = VPTree(ids[first], vectors[first])
        return pdf[["dim", "shard"]].head(1).assign(shards=shards, tree=[tree.dump()])

    return rows.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, shards int, tree binary")


def query_blocks(queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """(dim, ids, vectors): queries in blocks of about block rows."""
    rows = usable(queries, id_col, vector_col).groupBy("id", "dim").agg(F.min("v").alias("v"))
    blocks = -(-max(1, rows.count()) // block)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
    return rows.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("dim", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vectors"))


def search(index: DataFrame, blocks: DataFrame, k: int, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query.

    Every block is repeated for each shard, and a tree only as often as tasks would be idle otherwise: there are at most
    as many copies as shards and tasks together. A tree comes before its blocks, which stream past it.
    """
    spark = index.sparkSession
    tasks = spark.sparkContext.defaultParallelism * 2
    shards = index.agg(F.max("shards")).first()[0] or 1
    lanes = -(-tasks // shards)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    trees = index.select("dim", "shard", each(lanes).alias("lane"), "tree", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<double>").alias("vectors"))
    asked = blocks.select("dim", each(shards).alias("shard"), F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), F.lit(None).cast("binary").alias("tree"), "ids", "vectors")
    rows = trees.unionByName(asked).repartition(tasks, "dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", F.col("tree").isNull())

    def walk(batches):
        place, tree = None, None
        for batch in batches:
            for dim, shard, lane, data, ids, flat in zip(*(batch.column(c) for c in ("dim", "shard", "lane", "tree", "ids", "vectors")), strict=True):
                here = (dim.as_py(), shard.as_py(), lane.as_py())
                if data.is_valid:
                    place, tree = here, VPTree.load(data.as_py())
                elif place == here:
                    q = ids.values.to_numpy()
                    found, best, keep, _ = tree.search(q, flat.values.to_numpy().reshape(-1, here[0]), k, factor)
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q, k)[keep.ravel()], "vec_id": found[keep], "score": best[keep]})

    near = rows.mapInArrow(walk, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vp_search(spark, sf_dir, k: int = 20, factor: float = FACTOR):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = stored(build_index(vectors), "vp-index")
    return search(index, query_blocks(vectors.where("vec_id % 20 = 0")), k, factor)


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
