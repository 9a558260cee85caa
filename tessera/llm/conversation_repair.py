"""Repair of the role structure of conversations by a weighted finite-state composition.

Three machines are composed: the acceptor of a conversation's rows, a transducer of edits (Keep, Rerole to user or assistant,
Delete, Insert an empty turn), and the acceptor of the grammar (s?(ua)+)? over role initials. A state of the composition is
(row, grammar state, inserts made here); its arcs are made when they are asked for. It has no cycles, as a cheapest path
never meets a grammar state twice before the same row, so the best weights follow in reverse topological order. A weight is
(cost, label string): costs add, labels are joined, the smaller pair wins. Weights are put together from the end, since
labels put before two strings keep their order and labels put behind need not (one string may begin the other).

Rows are narrow until the edits are known: they are counted by conversation, turn, role and text digest, so equal rows are
one; a minimum by conversation, role and digest finds the rows seen earlier; a range partition by all four keys deals a
long conversation out to many tasks, and each task turns the sorted rows into pieces of at most PIECE rows. A full piece is
given as its transfer matrix (weight from each grammar state to each other one), so one conversation's rows are worked on
in parallel and its last task joins a matrix per piece. The texts move once, by conversation, after the edits, to be
hashed as a stream: a hash over the whole of a conversation has to read it in order, in one place; of texts and rows
that task holds a batch at a time, and the edit string, which is the result.

Faults: blank (no character other than ASCII white space), duplicate (role and text seen earlier in the conversation),
truncated (last such character is none of . ! ?); the first that holds counts. Blank and duplicate rows have to be
deleted; a truncated row that stays adds 1 to the cost.

Cases: a null role or text is one space, so a null text is blank. Rows are in order of turn, nulls first; rows of one turn
by role and then by the SHA-256 of the text, so that equal rows stand together, and the first of equal rows is the one seen
earlier. Turn differences beyond a long are the largest long. Rows without a conv_id are one conversation. A
conversation without rows (all dropped) has zeros, an empty audit and the hash of the empty string. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batched, pin, read_table

PIECE = 4096
#: Rows whose pieces a task holds before it gives them on.
FLUSH = 32_768
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Acceptor of (s?(ua)+)? by state: start, after s, after u, after a.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]
NEVER: Weight = (1 << 62, "")
END: tuple[Weight, ...] = tuple((0, "") if g in FINAL else NEVER for g in range(len(GRAMMAR)))

#: A row's symbol: its role's initial if it is s, u or a, otherwise a dot; then its fault.
MUST_GO, CUT_OFF, FINE = "x", "t", "-"


def row_arcs(symbol: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, label, next grammar state) of the arcs that take a row in."""
    yield DELETE, "D", state
    if symbol[1] != MUST_GO:
        extra = TRUNCATED if symbol[1] == CUT_OFF else 0
        for output, after in GRAMMAR[state].items():
            if output == symbol[0]:
                yield KEEP + extra, "K", after
            if output in ROLES:
                yield REROLE + extra, "R", after


def insert_arcs(state: int) -> Iterator[tuple[int, str, int]]:
    for output, after in GRAMMAR[state].items():
        if output in ROLES:
            yield INSERT, "I", after


def with_inserts(best: tuple[Weight, ...]) -> tuple[Weight, ...]:
    """Weights before a row from those at it: layers of one insert more each, the last first."""
    layer = best
    for _ in range(len(GRAMMAR) - 1):
        layer = tuple(min([best[g], *((c + layer[to][0], a + layer[to][1]) for c, a, to in insert_arcs(g))]) for g in range(len(GRAMMAR)))
    return layer


_ENDED = with_inserts(END)


def before_row(symbol: str, after: tuple[Weight, ...]) -> tuple[Weight, ...]:
    """Weights before a row, its inserts included, from those after it."""
    return with_inserts(tuple(min((c + after[to][0], a + after[to][1]) for c, a, to in row_arcs(symbol, g)) for g in range(len(GRAMMAR))))


def before_rows(symbols: str, after: tuple[Weight, ...]) -> tuple[Weight, ...]:
    for i in range(len(symbols) - 2, -1, -2):
        after = before_row(symbols[i : i + 2], after)
    return after


def transfer(symbols: str) -> list[tuple[Weight, ...]]:
    """By last grammar state: weights from each first one to it. Two cheapest ways of a piece never begin one another: they
    take in the same rows, so the longer one would have cost more inserts."""
    size = range(len(GRAMMAR))
    return [before_rows(symbols, tuple((0, "") if g == to else NEVER for g in size)) for to in size]


def before_piece(matrix: list[tuple[Weight, ...]], after: tuple[Weight, ...]) -> tuple[Weight, ...]:
    out = []
    for g in range(len(GRAMMAR)):
        least = min(column[g][0] + after[to][0] for to, column in enumerate(matrix))
        out.append((least, min((column[g][1] + after[to][1] for to, column in enumerate(matrix) if column[g][0] + after[to][0] == least), default="")) if least < NEVER[0] else NEVER)
    return tuple(out)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): each row hurt by the checksum of conv_id:turn; a dropped one stays with there false."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = pin(rows, "conv_id", "turn", kind=F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20, own_role=name("role"), own_text=name("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("own_text", ".!?", "")).otherwise(F.col("own_text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("own_role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("kind") != 0)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("there"))


def faults(text: Column) -> Column:
    """Whether a text is blank (x), cut off (t) or neither (-)."""
    solid = r"[^\x20\x09-\x0D]"
    return F.when(~text.rlike(solid), MUST_GO).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(CUT_OFF)


def narrow(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault, n, again): equal rows as one, their number, and whether role and text stood at an earlier turn."""
    keys = ["conv_id", "turn", "role", "digest", "fault"]
    digest = F.when(F.col("there"), F.unhex(F.sha2("text", 256)))
    counted = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.when(F.col("there"), faults(F.col("text"))).alias("fault")).groupBy(keys).agg(F.count("*").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("named"), F.col("turn").alias("turn"))  # nulls first
    seen = counted.where(f"fault <> '{MUST_GO}'").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = counted.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(*keys, "n", (F.col("first").isNotNull() & (at > F.col("first"))).alias("again"))


_PIECES = "conv_id long, at long, symbols string, matrix binary, initials string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"


def illegal_pairs(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted rows of one partition; at gives their order within a conversation."""
    number, done, size = TaskContext.get().partitionId() << 32, [], 0

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "n", "again")), strict=True)

    def piece(conv, taken):
        nonlocal number
        symbols, initials, counts, turns = "".join(s for s, *_ in taken), "".join(i for _, i, *_ in taken), [0, 0, 0], {t for *_, t in taken if t is not None}
        for _, _, fault, _ in taken:
            if fault is not None:
                counts[fault] += 1
        number += 1
        matrix = pickle.dumps(transfer(symbols)) if len(taken) == most else None
        ends = initials if len(initials) < 3 else initials[0] + initials[-1]
        return (conv, number, symbols, matrix, ends, min(turns, default=None), max(turns, default=None), len(turns), *counts, illegal_pairs(initials))

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*done, strict=True), _PIECE_TYPES, strict=True)], schema=_PIECE_TYPES)

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        taken, cut = [], False
        for _, turn, role, fault, n, again in own:
            if fault is None:  # dropped
                continue
            initial = role[:1] if role[:1] in ("s", "u", "a") else "."
            for k in range(n):
                kind = 0 if fault == MUST_GO else 1 if again or k else 2 if fault == CUT_OFF else None
                taken.append((initial + (MUST_GO if kind in (0, 1) else fault), initial, kind, turn))
                if len(taken) == most:
                    done.append(piece(conv, taken))
                    taken, cut, size = [], True, size + most
                    if size >= FLUSH:
                        yield flush()
                        done, size = [], 0
        if taken or not cut:
            done.append(piece(conv, taken))
            size += len(taken) + 1
            if size >= FLUSH:
                yield flush()
                done, size = [], 0
    if done:
        yield flush()


_LONG, _TEXT = pa.int64(), pa.string()
_PIECE_TYPES = pa.schema([("conv_id", _LONG), ("at", _LONG), ("symbols", _TEXT), ("matrix", pa.binary()), ("initials", _TEXT), *((c, _LONG) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal"))])
_EDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_EDIT_TYPES = pa.schema([*((c, _LONG) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", _TEXT)])


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults and cheapest edits of each conversation, from its pieces in descending order."""
    known: dict[str, tuple[Weight, ...]] = {}

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c.name).to_pylist() for c in _PIECE_TYPES), strict=True)

    def one(conv, own):
        best, counts, turns, next_low, next_initial, low, high = _ENDED, [0, 0, 0, 0], 0, None, "", None, None
        for _, _, symbols, matrix, initials, lo, hi, n, *more in own:
            if matrix is not None:
                best = before_piece(pickle.loads(matrix), best)  # noqa: S301  written by pieces()
            elif len(symbols) <= 64 and best == _ENDED:
                if symbols not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[symbols] = before_rows(symbols, best)
                best = known[symbols]
            else:
                best = before_rows(symbols, best)
            counts = [a + b for a, b in zip(counts, more, strict=True)]
            counts[3] += illegal_pairs(initials[-1:] + next_initial)
            next_initial = initials[:1] or next_initial
            if n:
                turns += n - (hi == next_low)
                low, high, next_low = lo, hi if high is None else high, lo
        gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
        return (conv, gaps, *counts, *best[0])

    done: list[tuple] = []
    for conv, own in groupby(rows(), key=lambda r: r[0]):
        done.append(one(conv, own))
        if len(done) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*done, strict=True), _EDIT_TYPES, strict=True)], schema=_EDIT_TYPES)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*done, strict=True), _EDIT_TYPES, strict=True)], schema=_EDIT_TYPES)


def edits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of damaged rows."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = narrow(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.select("conv_id", "turn", "role", "fault", "n", "again").mapInArrow(lambda batches: pieces(batches, piece), _PIECES)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(joined_pieces, _EDITS)


class Repaired:
    """Hash of a conversation's repaired rows, taken as a stream."""

    def __init__(self, audit: str):
        self.labels, self.hash, self.state, self.begun = iter(audit), hashlib.sha256(), 0, False

    def _put(self, role: str, text: str, initial: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.state, self.begun = GRAMMAR[self.state][initial], True

    def _new_role(self) -> tuple[str, str]:
        initial = next(c for c in GRAMMAR[self.state] if c in ROLES)
        return ROLES[initial], initial

    def take(self, role: str, text: str) -> None:
        for label in self.labels:
            if label == "I":
                new, initial = self._new_role()
                self._put(new, "", initial)
                continue
            if label != "D":
                new, initial = (role, role[0]) if label == "K" else self._new_role()
                self._put(new, text, initial)
            return
        raise ValueError("the edits end before the rows")

    def end(self) -> str:
        for label in self.labels:
            if label != "I":
                raise ValueError("the rows end before the edits")
            role, initial = self._new_role()
            self._put(role, "", initial)
        return self.hash.hexdigest()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repaired_sha256 beside the edits; each conversation's edits come before its rows."""
    types = pa.schema([*_EDIT_TYPES, ("repaired_sha256", _TEXT)])
    now, repaired, done = None, None, []
    for batch in batches:
        for audit, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("audit", "edit", "role", "text")), strict=True):
            if audit is not None:
                if now is not None:
                    done.append((*now, repaired.end()))
                now, repaired = (edit["conv_id"], *(edit[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), audit), Repaired(audit)
            else:
                repaired.take(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*done, strict=True), types, strict=True)], schema=types)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*now, repaired.end()), types, strict=True)], schema=types)


def repaired(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """edits() of damaged rows with repaired_sha256, the hash of the repaired `role:text` lines."""
    found = edits(rows, piece)
    packed = F.struct(*[c for c in found.columns if c != "audit"])
    first = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), packed.alias("edit"), "audit")
    texts = rows.where("there").select("conv_id", "turn", "role", "text", F.lit(None).cast(first.schema["edit"].dataType).alias("edit"), F.lit(None).cast("string").alias("audit"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.unhex(F.sha2("text", 256))]
    together = batched(first.unionByName(texts)).repartition("conv_id").sortWithinPartitions(*order)
    return together.select("audit", "edit", "role", "text").mapInArrow(hashed, f"{_EDITS}, repaired_sha256 string")


def op11_conversation_repair(spark, sf_dir):
    return repaired(damaged(read_table(spark, sf_dir, "conversations")))


def _sql_rounds() -> str:
    """SQL: the 256 entries of the checksum's table, eight rounds each."""
    out = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        out = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({out})"  # noqa: S608
    return out


def _sql_least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _sql_way(cost: str, label: str, weights: str, state: int) -> str:
    return f"{{'c': CAST({cost} AS BIGINT) + {weights}[{state + 1}].c, 's': '{label}' || {weights}[{state + 1}].s}}"


def _sql_row_arcs() -> str:
    """SQL: the weights at a row x from those after it, v."""
    out = []
    for state, arcs in enumerate(GRAMMAR):
        ways = [_sql_way(DELETE, "D", "v", state)]
        for output, after in arcs.items():
            ways.append(f"CASE WHEN NOT x.must_go AND x.initial = '{output}' THEN {_sql_way('x.extra', 'K', 'v', after)} END")
            if output in ROLES:
                ways.append(f"CASE WHEN NOT x.must_go THEN {_sql_way(f'{REROLE} + x.extra', 'R', 'v', after)} END")
        out.append(_sql_least(*ways))
    return f"[{', '.join(out)}]"


def _sql_insert_arcs(layer: str) -> str:
    """SQL: the weights with one insert more in front of the row, from the layer behind it and the weights at the row, b."""
    return f"[{', '.join(_sql_least(f'b[{g + 1}]', *(_sql_way(c, a, layer, to) for c, a, to in insert_arcs(g))) for g in range(len(GRAMMAR)))}]"


def _sql_literal(weights: tuple[Weight, ...]) -> str:
    return "[" + ", ".join(f"{{'c': CAST({min(c, 1 << 40)} AS BIGINT), 's': '{s}'}}" for c, s in weights) + "]"


SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM ({_sql_rounds()})),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
summed AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind
    FROM named, tab),
hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, row_number() OVER () AS k
    FROM summed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) copies(copy)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), k) AS r,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM hurt),
beside AS (SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY r) || role[1] AS pair FROM placed),
each AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'role': role, 'text': text, 'initial': role[1], 'must_go': fault IN ('blank', 'duplicate'), 'extra': CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END}} ORDER BY r) AS rows
    FROM beside GROUP BY conv_id),
every AS (SELECT c.conv_id, row_number() OVER () AS n, gaps, blank, duplicate, truncated, illegal, coalesce(rows, []) AS rows FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN each e ON c.conv_id IS NOT DISTINCT FROM e.conv_id),
walk AS (
    SELECT n, rows, len(rows) AS i, {_sql_literal(_ENDED)} AS v FROM every
    UNION ALL
    SELECT n, rows, i, {_sql_insert_arcs('l')} AS v FROM (SELECT *, {_sql_insert_arcs('k')} AS l FROM (SELECT *, {_sql_insert_arcs('b')} AS k FROM (
        SELECT n, rows, i - 1 AS i, {_sql_row_arcs()} AS b FROM (SELECT *, rows[i] AS x FROM walk WHERE i > 0))))),
cheapest AS (SELECT n, v[1].c AS cost, v[1].s AS audit FROM walk WHERE i = 0),
mended AS (
    SELECT n, rows, audit, 0 AS k, 0 AS i, 0 AS state, CAST([] AS VARCHAR[]) AS lines FROM every JOIN cheapest USING (n)
    UNION ALL
    SELECT n, rows, audit, k, i, CASE WHEN role IS NULL THEN state ELSE CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
        CASE WHEN role IS NULL THEN lines ELSE list_append(lines, role || ':' || CASE WHEN edit = 'I' THEN '' ELSE rows[i].text END) END AS lines
    FROM (SELECT n, rows, audit, k + 1 AS k, CASE WHEN edit = 'I' THEN i ELSE i + 1 END AS i, state, lines, edit,
            CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN rows[i + 1].role ELSE CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END END AS role
        FROM (SELECT *, audit[k + 1] AS edit FROM mended WHERE k < length(audit))))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, c.cost, c.audit,
    sha256(array_to_string(m.lines, chr(10))) AS repaired_sha256
FROM every e JOIN cheapest c USING (n) JOIN mended m USING (n) WHERE m.k = length(c.audit)
"""  # noqa: S608
