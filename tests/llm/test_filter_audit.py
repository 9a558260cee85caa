"""The filter audit against applying the five filters one after the other, in every order."""

import random
import re
from itertools import permutations

from tessera.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, source string, step string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Rows by brute force: each order walks over each part's documents."""
    smallest = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, text, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and text in smallest and doc_id > smallest[text],
        }
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out, sums = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                redundant = sum(f in r[0] for r in rows) - len(gone)
                out[part, order, k + 1] = (len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return {key: (*v, sums[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def texts(rng):
    words = ["aa", "bb", "cc", "É", "x|y", "Q", *(f"w{i}" for i in range(300))]
    space = [" ", "\n", "\t\x0b", " ", "\x85"]
    return ["", None, " \n ", "a", "É #", *("".join(rng.choice(words[: rng.choice([3, 6, 306])]) + rng.choice(space) for _ in range(rng.choice([3, 150, 260, 900]))) for _ in range(30))]


def test_against_every_order(spark):
    rng = random.Random(4)
    some = texts(rng)
    docs = [(rng.choice([None, *range(80)]), rng.choice(some), rng.choice([None, "", "p", "q"]), "own") for _ in range(300)]
    docs += [(1000 + i, some[7], "p", "own") for i in range(150)]  # one text on a third of all rows
    labels = [(rng.choice([None, *range(80)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    want = plain(docs, labels)
    assert len(want) == 3 * 600  # null and empty sources are one part
    assert got(A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))) == want


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit(none, labels).count() == 0
    one = spark.createDataFrame([(None, None, None, "x")], DOCS)
    assert got(A.audit(one, labels)) == plain([(None, None, None, "x")], [])


def test_rows_of_all_subsets_add_up(spark, sf):
    rows = A.op12_filter_audit(spark, sf).toPandas()
    assert rows.columns.tolist() == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    last = rows[rows.step == 5].groupby("part").kept.nunique()
    assert (last == 1).all()  # the order doesn't change what all five leave
