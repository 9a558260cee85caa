"""Conversation repair against trying every edit, against its SQL, and over conversations that many tasks share."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def every_way(rows):
    """(cost, labels, repaired lines) of every edit of (role, text, fault) rows, with up to two inserts in each place."""
    inserts = [s for k in range(3) for s in itertools.product("ua", repeat=k)]
    names = {"u": "user", "a": "assistant"}
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > 4:
            continue
        for ops in itertools.product(*(["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for *_, f in rows)):
            cost, labels, initials, lines = 0, "", "", []
            for k, gap in enumerate(gaps):
                for c in gap:
                    cost, labels, initials = cost + 2, labels + "I", initials + c
                    lines.append(f"{names[c]}:")
                if k == len(rows):
                    break
                (role, text, fault), op = rows[k], ops[k]
                labels += op[0]
                cost += {"D": 3, "K": 0, "R": 2}[op[0]] + (op != "D" and fault == "truncated")
                if op != "D":
                    role = role if op == "K" else names[op[1]]
                    initials += role[:1] or "."
                    lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials):
                yield cost, labels, lines


def plain(rows):
    """Results by brute force, by conv_id."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in left:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit, lines = min(every_way([(r, t, f) for (_, r, t), f in zip(left, faults)]), key=lambda w: w[:2])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, audit VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    return {r[0]: r[1:] for r in con.execute(R.SQL).fetchall()}


def made(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "tool", None, "", "ua"], ["Hi.", "Yes!\n", "no", "a. b", None, "", " \t", "é?", "x.\x85"]
    for conv in convs:
        for turn in range(rng.randint(0, longest)):
            yield (conv, rng.choice([turn, turn, turn, turn + 5, None]), rng.choice(["user", "assistant"][turn % 2 :][:1] * 3 + roles), rng.choice(texts), "own")


def test_every_edit(spark):
    rows = list(made(random.Random(3), [None, *range(70)], 3))
    assert got(R.repaired(R.damaged(spark.createDataFrame(rows, SCHEMA)))) == plain(rows)


@pytest.mark.parametrize("piece", [3, 4096])
def test_long_conversations_in_pieces(spark, piece):
    rng = random.Random(piece)
    rows = [*made(rng, [None, *range(40)], 12), *made(rng, [900], 300)]
    rows += [(901, k, "user", "Same.", "own") for k in range(150)] + [(902, 7, "user", "Again.", "own")] * 90 + [(903, k * 2**60, "user", "a.", "own") for k in range(-8, 8)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = got(R.repaired(R.damaged(table), piece))
    wide = out.pop(903)
    assert wide[0] == 2**63 - 1  # turns farther apart than a long says
    assert out == by_sql([r for r in rows if r[0] != 903])


def test_transfer_matrices():
    """The transfer matrices give what the rows one by one give."""
    rng = random.Random(9)
    for _ in range(60):
        symbols = "".join(rng.choice(["s", "u", "a", "."]) + rng.choice("xt--") for _ in range(rng.randint(0, 20)))
        at = 2 * rng.randint(0, len(symbols) // 2)
        assert R.before_piece(R.transfer(symbols[:at]), R.before_rows(symbols[at:], R._ENDED))[0] == R.before_rows(symbols, R._ENDED)[0]


def test_dropped_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "Hi.", "own")]
    want = {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(R.repaired(R.damaged(spark.createDataFrame(rows, SCHEMA)))) == want == by_sql(rows)
    assert got(R.repaired(R.damaged(spark.createDataFrame([], SCHEMA)))) == {}
