"""Leases of catalogue rows as a stateful stream: shard claims, items, and timers that emit what has expired.

Accounts and shards belong to a queue (a hash of the account, say), the key of the state, so queues advance in parallel and
one queue's state is the open work of its accounts. A queue deals out numbered shards of ``shard_rows`` rows; row i of
shard s is item s * shard_rows + i.

An account that asks gets a lease of up to ``count`` items of one shard: of its own unfinished shard, else of the first
claimed one that an account without a live lease has held for over ``steal`` ms, else of the next new shard. Items that
came back come before new ones, the smallest first. A live lease is given again as it is. A renewal sets its end anew, a
submission takes its first item off and ends it with the last one, a release gives its items back. A lease whose end has
come loses its items before anything else at that time or later happens, and without any later event of its queue a timer
says so when the watermark has passed its end. Events of a queue are taken in order of time, ties by event id, in each
micro-batch.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

COUNT, SHARD_ROWS, LEASE_MS, STEAL_MS = 16, 40, 1_800_000, 21_600_000

#: Events after which outcomes are handed on.
FRAME_ROWS = 50_000
_KINDS = pd.CategoricalDtype(["ask", "release", "renew", "submit"], ordered=True)

OUTCOMES = "queue long, account long, kind string, at_ms long, shard long, generation long, until long, n_items long, first_item long"


class LeaseProcessor(StatefulProcessor):
    """Rows of (queue, account, kind, at, event_id); kind is ask, renew, submit or release."""

    def __init__(self, count: int = COUNT, shard_rows: int = SHARD_ROWS, lease: int = LEASE_MS, steal: int = STEAL_MS):
        self.count, self.shard_rows, self.length, self.steal = count, shard_rows, lease, steal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claims = handle.getMapState("claims", "shard long", "account long, since long, next long")
        self.leases = handle.getMapState("leases", "account long", "shard long, generation long, until long, live boolean")
        self.items = handle.getListState("items", "account long, item long")
        self.returned = handle.getListState("returned", "item long")

    def _load(self) -> None:
        self.claim_of = {k[0]: list(v) for k, v in self.claims.iterator()}
        self.lease_of = {k[0]: list(v) for k, v in self.leases.iterator()}
        self.held: dict[int, list[int]] = {}
        for account, item in self.items.get():
            self.held.setdefault(account, []).append(item)
        self.back: dict[int, list[int]] = {}  # items that came back, by shard
        for (item,) in sorted(self.returned.get()):
            self.back.setdefault(item // self.shard_rows, []).append(item)
        self.out: list[tuple] = []
        self.touched: tuple[set, set] = (set(), set())
        # heaps whose entries count only if they still hold when they come up
        self.ends = [(lease[2], a) for a, lease in self.lease_of.items() if lease[3]]
        self.aging = [(claim[1], s) for s, claim in self.claim_of.items()]
        self.idle: list[int] = []  # shards that may be taken over
        heapify(self.ends)
        heapify(self.aging)
        self.open_of: dict[int, set[int]] = {}  # unfinished shards by account
        for s in self.claim_of:
            self._place(s)

    def _is_open(self, s: int) -> bool:
        return self.claim_of[s][2] < self.shard_rows or s in self.back

    def _is_live(self, account: int) -> bool:
        return account in self.lease_of and self.lease_of[account][3]

    def _place(self, s: int) -> None:
        """Note whether a shard is unfinished, after a change."""
        own = self.open_of.setdefault(self.claim_of[s][0], set())
        (own.add if self._is_open(s) else own.discard)(s)

    def _store(self) -> None:
        for shard in self.touched[0]:
            self.claims.updateValue((shard,), tuple(self.claim_of[shard]))
        for account in self.touched[1]:
            self.leases.updateValue((account,), tuple(self.lease_of[account]))
        for state, rows in ((self.items, [(a, i) for a in sorted(self.held) for i in self.held[a]]), (self.returned, [(i,) for s in sorted(self.back) for i in self.back[s]])):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def _tell(self, account: int, kind: str, at: int) -> None:
        shard, generation, until, _ = self.lease_of[account]
        own = self.held.get(account, [])
        self.out.append((self.queue, account, kind, at, shard, generation, until, len(own), own[0] if own else None))

    def _end(self, account: int) -> None:
        for item in self.held.pop(account, []):
            s = item // self.shard_rows
            insort(self.back.setdefault(s, []), item)
            self._place(s)
            heappush(self.idle, s)
        self.lease_of[account][3] = False
        self.touched[1].add(account)
        for s in self.open_of.get(account, ()):
            heappush(self.idle, s)

    def _expire(self, now: int) -> None:
        while self.ends and self.ends[0][0] <= now:
            until, account = heappop(self.ends)
            if self._is_live(account) and self.lease_of[account][2] == until:
                self._tell(account, "expired", until)
                self._end(account)

    def _shard_for(self, account: int, now: int) -> int:
        own = self.open_of.get(account)
        if own:
            return min(own)
        while self.aging and self.aging[0][0] < now - self.steal:
            heappush(self.idle, heappop(self.aging)[1])
        while self.idle:
            s = self.idle[0]
            claim = self.claim_of[s]
            if self._is_open(s) and claim[1] < now - self.steal and not self._is_live(claim[0]):
                self.open_of[claim[0]].discard(s)
                claim[:2] = [account, now]
                break
            heappop(self.idle)
        else:
            s = len(self.claim_of)
            self.claim_of[s] = [account, now, 0]
        heappush(self.aging, (now, s))
        self._place(s)
        return s

    def _ask(self, account: int, now: int) -> None:
        lease = self.lease_of.get(account)
        if lease and lease[3]:
            self._tell(account, "resumed", now)
            return
        shard = self._shard_for(account, now)
        back = self.back.pop(shard, [])
        given, rest = back[: self.count], back[self.count :]
        if rest:
            self.back[shard] = rest
        begin = self.claim_of[shard][2]
        end = min(self.shard_rows, begin + self.count - len(given))
        self.held[account] = given + [shard * self.shard_rows + i for i in range(begin, end)]
        self.claim_of[shard][2] = end
        self._place(shard)
        self.lease_of[account] = [shard, (lease[1] if lease else 0) + 1, now + self.length, True]
        heappush(self.ends, (now + self.length, account))
        self.touched[0].add(shard)
        self.touched[1].add(account)
        self._tell(account, "leased", now)

    def _step(self, account: int, kind: str, now: int) -> None:
        self._expire(now)
        if kind == "ask":
            self._ask(account, now)
            return
        lease = self.lease_of.get(account)
        if not (lease and lease[3]):
            return
        self.touched[1].add(account)
        if kind == "renew":
            lease[2] = now + self.length
            heappush(self.ends, (lease[2], account))
            self._tell(account, "renewed", now)
        elif kind == "submit":
            del self.held[account][0]
            self._tell(account, "submitted", now)
            if not self.held[account]:
                self._end(account)
        elif kind == "release":
            self._tell(account, "released", now)
            self._end(account)

    def _set_timers(self) -> None:
        """One timer, at the earliest end of a live lease."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        ends = [lease[2] for lease in self.lease_of.values() if lease[3]]
        if ends:
            self.handle.registerTimer(min(ends))

    def _frame(self) -> pd.DataFrame:
        """The outcomes since the last frame."""
        names = [c.split(" ")[0] for c in OUTCOMES.split(", ")]
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=names).astype({"first_item": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        self.queue = key[0]
        self._load()
        events = pd.concat([f[["at", "event_id", "account", "kind"]].astype({"kind": _KINDS}) for f in rows]).sort_values(["at", "event_id", "account", "kind"], ignore_index=True)
        for i in range(0, len(events), FRAME_ROWS):
            part = events.iloc[i : i + FRAME_ROWS]
            for at, account, kind in zip(part["at"].tolist(), part["account"].tolist(), part["kind"].tolist(), strict=True):
                self._step(account, kind, at)
            yield self._frame()
        self._store()
        self._set_timers()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.queue = key[0]
        self._load()
        self._expire(timerValues.getCurrentWatermarkInMs())
        self._store()
        self._set_timers()
        yield self._frame()

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, delay: str = "0 seconds", **sizes: int) -> DataFrame:
    """Outcomes of a stream of (queue, account, kind, ts, event_id)."""
    rows = events.withWatermark("ts", delay).select("queue", "account", "kind", F.unix_millis("ts").alias("at"), "event_id", "ts")
    return rows.groupBy("queue").transformWithStateInPandas(LeaseProcessor(**sizes), OUTCOMES, "Append", "EventTime")
