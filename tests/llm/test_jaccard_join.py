import itertools
import os
import random

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.components import components


def brute(rows, n, num, den):
    """{id: (size, component)} over all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i = rng.randrange(len(words))
        op = rng.randrange(3)
        words[i : i + 1] = [[], [f"new{rng.randrange(999)}"], [words[i], f"more{rng.randrange(999)}"]][op]
    return words


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_components_equal_brute_force(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "BLOCK_ELEMENTS", 2000)
    rng = random.Random(n)
    rows, i = [], 0
    for size in (1, 2, 3, 4, 9, 10, 11, 30, 31, 90, 400):
        base = [f"w{rng.randrange(2000)}" for _ in range(size)]
        for k in range(24):
            rows.append((i, " ".join(edited(rng, base, min(k // 3, size)))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, rows[50][1].upper()), (i + 4, rows[50][1] + "  ")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, sig string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs, n, num, den).collect()}
    assert got == brute(rows, n, num, den)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op2_jaccard_join(spark, sf).collect()}
    assert got == brute(rows, 3, 90, 100) and any(i != c for i, (_, c) in got.items())


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()} == {(None, 2, None), (1, 2, 1), (2, 0, 2)}
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_every_allocation_meets_the_pigeonhole_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        m = int(rng.integers(1, 30))
        counts = rng.integers(0, 5000, (m, 2 + 2 * J.SIGNS))
        plan, e = J.allocate(counts, rng.integers(0, 50000, 2 + 2 * J.SIGNS))
        assert e.sum() >= m and len(e) == (m if plan == 0 else -(-m // 2))


def test_linked_sets_share_a_signature_under_any_allocation():
    rng, bands = np.random.default_rng(3), J.Bands(80, 100)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, int(rng.integers(5, 200)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[len(a) // 12 :], rng.integers(0, 1 << 63, len(a) // 12, dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 80 * (len(a) + len(b) - both)
        shared = set(bands.instances(len(a))) & set(bands.instances(len(b)))
        hit = False
        for i in shared:
            m = bands.h(i) + 1
            e = np.ones(m, dtype=int)
            if m > 1:
                x, y = rng.choice(m, 2, replace=False)
                e[x], e[y] = 0, 2
            for plan, own in ((0, e), (1, np.full(-(-m // 2), 2))):
                s, t = (set(J.Segments(J.Elements(z), i, len(own), plan).signatures(own).tolist()) for z in (a, b))
                hit |= bool(s & t)
                assert i != min(bands.of(len(a)), bands.of(len(b))) or s & t
        assert hit


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_only_members_that_sketches_leave_open_are_compared_exactly():
    rng, bands = np.random.default_rng(5), J.Bands(80, 100)
    near = rng.integers(1, 1 << 63, 200, dtype=np.uint64)
    sets = [rng.integers(1, 1 << 63, 200, dtype=np.uint64) for _ in range(60)] + [near, np.concatenate([near[:198], near[:2] + np.uint64(1)]), np.concatenate([near[:177], near[:23] + np.uint64(3)])]
    sizes, words = np.full(63, 200), J._folded([J.sketch(np.sort(s), bands.sketch_bits(200)) for s in sets])
    component = np.array([*range(60), 60, 60, 61])
    assert J.may_link(sizes, words, bands, component).tolist() == [60, 61, 62]
    assert not len(J.may_link(sizes, words, bands, np.array([*range(60), 60, 60, 60])))


def test_groups_leave_no_texts_behind(spark):
    from tessera.llm.common import new_path, scratch

    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "a b c d")], "doc_id long, text string")
    with scratch(spark):
        path = new_path(spark, "groups").rsplit("/", 1)[0]
        before = {n for n in os.listdir(path.removeprefix("file:"))}
        assert [r["first"].id for r in J.near_groups(docs).orderBy("id").collect()] == [1, 1, 3]
        left = {n.rsplit("-", 1)[0] for n in set(os.listdir(path.removeprefix("file:"))) - before}
    assert left <= {"described", "nodes", "components"}
