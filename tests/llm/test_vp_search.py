import numpy as np
import pytest

from tessera.llm import vp_search as V


def brute(ids, vectors, qids, k):
    out = {}
    for q in qids:
        s = [(-float(np.dot(vectors[ids.index(q)], v)), i) for i, v in zip(ids, vectors) if i != q]
        out[q] = [i for _, i in sorted(s)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")


@pytest.mark.parametrize("shard_rows", [50, 4096])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(1)
    vectors = [(rng.normal(size=6) * rng.uniform(0.1, 3)).astype("f4") for _ in range(300)]
    vectors += vectors[:40]  # ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    df = frame(spark, rows)
    got = V.search(V.build_index(df, shard_rows=shard_rows), V.query_blocks(df.where("vec_id % 20 = 0"), block=7), 9).collect()
    truth = brute(list(range(340)), [v.astype("f8") for v in vectors], range(0, 340, 20), 9)
    for q, want in truth.items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_unusable_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (20, [0.5, 0.5], "b"), (1, None, None), (2, [0.0, 0.0], ""), (3, [nan, 1.0], ""), (4, [inf, 1.0], ""), (5, [None, 1.0], ""), (6, [1.0, 2.0, 3.0], ""), (None, [1.0, 1.0], ""), (7, [], ""), (8, [-1.0, -1.0], "")]
    df = frame(spark, rows)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in V.search(V.build_index(df), V.query_blocks(df.where("vec_id % 20 = 0")), 20).collect()}
    assert got == {(0, 1): (20, 0.5), (0, 2): (8, -1.0), (20, 1): (0, 0.5), (20, 2): (8, -1.0)}
    none = df.limit(0)
    assert V.search(V.build_index(none), V.query_blocks(none), 3).count() == 0


def test_larger_factors_prune_and_keep_most(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype="f8")
    tree, q = V.VPTree(ids, v, leaf_rows=16), np.flatnonzero(ids % 20 == 0)
    exact, _, _, every = tree.search(ids[q], v[q], 20, 1.0)
    near, _, _, some = tree.search(ids[q], v[q], 20, 6.0)
    assert some < every and np.mean([len({*a} & {*b}) / 20 for a, b in zip(exact, near)]) >= 0.9


def test_negative_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    df = frame(spark, [(-i, x.tolist(), "") for i, x in enumerate(v)] + [(-20, [9.0] * 5, "later"), (-21, [9.0] * 5, "later")])
    got = V.search(V.build_index(df, shard_rows=16), V.query_blocks(df.where("vec_id % 20 = 0")), 5).collect()
    want = brute([-i for i in range(60)], [x.astype("f4").astype("f8") for x in v], [0, -20, -40], 5)
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want} == want


@pytest.mark.parametrize("size", [1e160, 1e-160])
def test_huge_and_tiny_components(size):
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(400, 8))
    ids, q = np.arange(400), np.arange(0, 400, 20)
    want = V.VPTree(ids, plain, leaf_rows=8).search(ids[q], plain[q], 6)
    got = V.VPTree(ids, plain * size, leaf_rows=8).search(ids[q], plain[q], 6)
    assert (got[0] == want[0]).all() and np.allclose(got[1], want[1] * size) and got[2].all()


def test_many_copies_of_a_longest_vector_keep_the_smallest_ids():
    rng = np.random.default_rng(6)
    for _ in range(20):
        one = rng.normal(size=64)
        others = rng.normal(size=(300, 64))
        others *= 0.9 * np.linalg.norm(one) / np.linalg.norm(others, axis=1).max()
        ids = rng.permutation(500)
        v = np.concatenate([np.repeat(one[None], 200, axis=0), others])
        found = V.VPTree(ids, v, leaf_rows=16).search(ids[:1], v[:1], 20)[0]
        assert found[0].tolist() == sorted(set(ids[:200].tolist()) - {ids[0]})[:20]
