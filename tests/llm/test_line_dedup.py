import hashlib
import random

from tessera.llm import line_dedup as L

LONG = " ".join(f"w{i}" for i in range(60))
PAIR = "first line of a shared passage with quite a few words in it so that it stands alone as a chunk of text for sure yes indeed it does\nsecond shorter line"


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").withColumnRenamed("n_lines", "removed_by")
    return {r.doc_id: (r.text, list(r.removed)) for r in L.line_dedup(docs).collect()}


def test_a_long_line_and_a_passage_go_where_they_repeat(spark):
    out = run(spark, [(1, f"host one\n{LONG}\nend one", ""), (2, f"other\nhost two\n{LONG}", ""), (3, f"{PAIR}\nx y", ""), (4, f"intro\n{PAIR}\nlast", ""), (5, f"{LONG} changed", "")])
    assert out[1][1] == [] and out[2] == ("other\nhost two", [2])
    assert out[3][1] == [] and out[4] == ("intro\nlast", [1, 2]) and out[5][1] == []


def test_nulls_empties_ties_and_copies(spark):
    out = run(spark, [(1, None, ""), (2, "", ""), (3, "\n\n\n\n\n\n\n", ""), (4, "\n\n\n\n\n\n\n", ""), (5, "short", ""), (6, "short", ""), (7, f"a\n{LONG}\n{LONG}", ""), (None, LONG, ""), (8, None, "")])
    assert out[1] == (None, []) and out[2] == ("", []) and out[3] == out[4] == ("\n" * 7, []) and out[5] == out[6] == ("short", [])
    assert out[7] == (f"a\n{LONG}", [2]) and out[None] == (LONG, [])
    same = run(spark, [(9, LONG, ""), (9, LONG, "")])
    assert same == {9: (LONG, [])}
    assert run(spark, [(1, f"q\n{LONG}", ""), (2, "x", "")][:0]) == {}


def test_every_removed_line_has_a_kept_copy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = L.line_dedup(docs).collect()
    kept = {x for r in out for x in r.text.split("\n")}
    assert len(out) == len(before) and any(r.removed for r in out)
    for r in out:
        lines = before[r.doc_id].split("\n")
        assert "\n".join(x for i, x in enumerate(lines) if i not in set(r.removed)) == r.text
        assert all(lines[i] in kept for i in r.removed)


def words_of(rng, tag, lines, words):
    return [" ".join(f"{tag}{rng.randrange(10**9)}" for _ in range(words)) for _ in range(lines)]


def planted(seed, shapes, host_words, copies=2):
    """Rows in which every passage stands in so many hosts, and the lines that should go from each."""
    rng, rows, want = random.Random(seed), [], {}
    for k, (lines, words) in enumerate(shapes):
        passage = words_of(rng, "p", lines, words)
        passage[1:1] = [""] * (k % 3 if lines > 1 else 0)
        for c in range(copies):
            head = words_of(rng, "h", rng.randrange(5), host_words)
            rows.append((copies * k + c, "\n".join([*head, *passage, *words_of(rng, "e", rng.randrange(5), host_words)])))
            want[copies * k + c] = list(range(len(head), len(head) + len(passage))) if c else []
    return rows, want


def test_planted_passages_go_whole(spark):
    for seed, host_words in ((5, 10), (6, 40)):
        # three lines and more, or over 50 words in one line or two
        shapes = [(n, w) for n in range(3, 13) for w in (4, 12, 24)] * 5 + [(1, 51), (2, 26), (2, 40), (1, 300)] * 10
        rows, want = planted(seed, shapes, host_words, 3)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: list(r.removed) for r in L.line_dedup(docs).collect()}
        assert got == want


def test_two_short_lines_go_whole_or_stay(spark):
    rows, want = planted(7, [(2, 6)] * 200, 10)
    got = {r.doc_id: list(r.removed) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] in ([], want[i]) for i in want) and sum(map(bool, got.values())) > 60


def test_shared_null_and_blank_rows(spark):
    rows, want = planted(8, [(4, 8), (6, 12)] * 3, 9)
    other = "\n".join(words_of(random.Random(9), "o", 20, 8))
    # two texts share the id 3: only the one that repeats loses lines
    rows += [(None, rows[0][1]), (100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "one short line"), (105, "one short line\n"), (3, other), (106, " \t\n\x0b"), (107, " \t\n\x0b")]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.removed) == ([] if r.text == other else want.get(r.doc_id, [])), r.doc_id


def test_one_line_of_many_words_and_a_line_of_many_copies(spark):
    huge = " ".join(f"h{i}" for i in range(300_000))
    rows = [(1, f"top\n{huge}"), (2, f"{huge}\nbottom"), (3, "\n".join([LONG] * 3000)), *((100 + i, f"own {i}\n{LONG}") for i in range(2500))]
    got = {r.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len(got) == len(rows) and got[1] == f"top\n{huge}" and got[2] == "bottom"
    assert got[3] == LONG and all(got[100 + i] == f"own {i}" for i in range(2500))


def test_equal_rows_of_one_id_give_one_copy(spark):
    rows = [(1, f"a\n{LONG}")] * 400 + [(2, f"b\n{LONG}")] * 400
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 800 and {(r.doc_id, r.text) for r in got} == {(1, f"a\n{LONG}"), (2, "b")}


def plain(rows):
    """The lines that line_dedup takes out, by plain loops over the text of rows with distinct ids."""
    chunks = {}
    for i, text in rows:
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        digest = lambda x: hashlib.md5(x.encode()).hexdigest()
        rolled = [digest("".join(map(digest, lines[a : b + 1]))) for a, b in zip(full, full[1:])]
        beside = [[rolled[j] for j in (k - 1, k + 1) if 0 <= j < len(rolled)] for k in range(len(rolled))]
        spans = [(k, k + 1) for k, r in enumerate(rolled) if not beside[k] or r <= max(beside[k])]
        spans += [(k, k) for k, i_line in enumerate(full) if lines[i_line].count(" ") + 1 > L.MIN_WORDS // 2]
        for a, z in spans:
            start, end = full[a], full[z] + 1
            before = "\n".join(lines[full[a - 1] : start]) if a else None
            after = "\n".join(lines[end : full[z + 1] + 1]) if z + 1 < len(full) else None
            chunk = "\n".join(lines[start:end])
            chunks.setdefault((a == z, chunk), []).append((i, start, end, before, after, full[a - 1], full[min(z + 1, len(full) - 1)] + 1))
    gone = {}
    for (single, chunk), places in chunks.items():
        first = min(places, key=lambda p: p[:2])
        for p in places:
            if p[:2] != first[:2]:
                back, on = p[3] is not None and p[3] == first[3], p[4] is not None and p[4] == first[4]
                if not single or back or on or chunk.count(" ") + 1 > L.MIN_WORDS:
                    gone.setdefault(p[0], set()).update(range(p[5] if back else p[1], p[6] if on else p[2]))
    return gone


def test_equals_plain_loops(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None]
    rng = random.Random(3)
    few = [words_of(rng, "l", 1, n)[0] for n in (1, 2, 3, 26, 30, 51, 60)] + ["", " "]
    made = [(k, "\n".join(rng.choice(few) for _ in range(rng.randrange(1, 12)))) for k in range(300)]
    for rows in (table, made):
        gone = plain(rows)
        got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert any(gone.values()) and all(list(r.removed) == sorted(gone.get(r.doc_id, ())) for r in got)
