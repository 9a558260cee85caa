"""Streams that are stopped and started again, and what they have emitted by then."""

import os
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import streams as P
from tessera.sources import byte_lines as B
from tessera.streaming import imports as I
from tessera.streaming import leases as L
from tessera.streaming import queue as T


def outcomes(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lease_run(spark, where, at):
    return T.drained(L.lease_stream(P.lease_events(T.event_stream(spark, f"{where}/events*.parquet")), **P.SIZES), "t", at=str(at))


def test_leases_go_on_after_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").limit(600).toPandas()
    schema = T.EVENTS
    for k, (lo, hi) in enumerate([(0, 250), (250, 600)]):
        spark.createDataFrame(events[lo:hi], schema).coalesce(1).write.parquet(str(tmp_path / f"piece{k}"))
    (tmp_path / "in").mkdir()
    move = lambda k: next((tmp_path / f"piece{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"events{k}.parquet")
    move(0)
    half = outcomes(lease_run(spark, tmp_path / "in", tmp_path / "run"))
    assert half == outcomes(lease_run(spark, tmp_path / "in", tmp_path / "run"))  # nothing new, nothing twice
    move(1)
    whole = outcomes(lease_run(spark, tmp_path / "in", tmp_path / "run"))
    assert set(half) < set(whole)
    assert whole == outcomes(lease_run(spark, tmp_path / "in", tmp_path / "once"))


def test_expiry_needs_no_later_event_of_its_queue(spark, tmp_path):
    rows = [(1, 1_000, 8, "view"), (2, 1_001, 9, "view"), (3, 500_000, 10, "view")]
    table = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("").alias("props"))
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = lease_run(spark, tmp_path, tmp_path / "run").where("kind = 'expired'").select("queue", "account", "at_ms").collect()
    assert sorted(map(tuple, got)) == [(0, 8, 1_000_000 + P.SIZES["lease"]), (1, 9, 1_001_000 + P.SIZES["lease"])]


def test_byte_ranges_give_each_whole_line_once(spark, tmp_path):
    text = "".join(f"{'x' * (k * 7 % 40)}{k}\n" for k in range(200)) + "\n\nnot ended"
    (tmp_path / "a.tsv").write_text(text)
    want, at = [], 0
    for line in text.split("\n")[:-1]:
        want.append((at, at + len(line) + 1, line.encode()))
        at += len(line) + 1
    for step in (1, 7, 100, 10**6):
        for block in (3, 1 << 20):
            got = [r for i in range(0, len(text), step) for rows in B.lines_between(str(tmp_path / "a.tsv"), i, min(len(text), i + step), block) for r in rows]
            assert got == want
    assert B.last_line_end(str(tmp_path / "a.tsv"), len(text), block=4) == at
    B.register(spark)
    table = spark.read.format("byte_lines").option("path", str(tmp_path)).option("bytesPerPartition", 500).load()
    assert table.rdd.getNumPartitions() > 5 and sorted((r.start, r.stop, r.line.encode()) for r in table.collect()) == want


def test_a_line_in_the_making_waits_for_the_next_start(spark, tmp_path):
    B.register(spark)
    shard = tmp_path / "in" / "s.tsv"
    shard.parent.mkdir()
    stream = spark.readStream.format("byte_lines").option("path", str(shard.parent)).load()
    seen = []
    for more in ("a\nb\nhal", "f", "\n", "", "c\n"):
        with open(shard, "a") as f:
            f.write(more)
        seen.append(sorted((r.start, r.line) for r in T.drained(stream, "t", at=str(tmp_path / "run")).collect()))
    assert seen == [[(0, "a"), (2, "b")], [(0, "a"), (2, "b")], *[[(0, "a"), (2, "b"), (4, "half")]] * 2, [(0, "a"), (2, "b"), (4, "half"), (9, "c")]]


def line(k, asset):
    return f"m\t{k}\t{k}\t{k}\t0\t0\t0\t{asset}\tUSA\n"


def imported(spark, path):
    own = I.Import(spark, path)
    return sorted((r.asset_id, r.lat) for r in own.jobs().collect()), sorted((r.name, r.jobs) for r in own.files().collect())


def test_an_import_that_breaks_anywhere_equals_one_run(spark, tmp_path, monkeypatch):
    folder = tmp_path / "files"
    folder.mkdir()
    contents = [line(1, "a") + line(2, "b"), line(3, "b") + line(4, "c"), line(1, "a") + line(2, "b"), "bad\n" + line(5, "d") + line(6, "d")]
    for k, text in enumerate(contents):
        (folder / f"{k}.tsv").write_text(text)
        os.utime(folder / f"{k}.tsv", (1000 + k, 1000 + k))
    I.Import(spark, str(tmp_path / "once")).run(str(folder), files_per_batch=1)
    want = imported(spark, str(tmp_path / "once"))
    assert want == ([("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", 5.0)], [("0.tsv", 2), ("1.tsv", 1), ("3.tsv", 1)])  # the third file's bytes are known

    path, plain = str(tmp_path / "broken"), I.Import.take
    for bad in (0, 1, 3):

        def breaks(self, listed, number, bad=bad):
            plain(self, listed, number)
            if number == bad:  # the registry of this batch is lost, its rows are not
                shutil.rmtree(f"{path}/files/batch={number}")
                raise OSError("lost")

        monkeypatch.setattr(I.Import, "take", breaks)
        with pytest.raises(Exception, match="lost"):
            I.Import(spark, path).run(str(folder), files_per_batch=1)
        if bad:
            assert set(imported(spark, path)[0]) < set(want[0])
    monkeypatch.setattr(I.Import, "take", plain)
    I.Import(spark, path).run(str(folder), files_per_batch=1)
    assert imported(spark, path) == want
    assert I.Import(spark, path).run(str(folder), files_per_batch=1) == 0


def lines_by_file(folder, n):
    """n files of a line each, in the order of their names; every second one repeats an identity."""
    folder.mkdir()
    for k in range(n):
        (folder / f"{k:02d}.tsv").write_text(line(k, f"a{k // 2}"))
        os.utime(folder / f"{k:02d}.tsv", (1000 + k, 1000 + k))
    return [(f"a{k}", 2.0 * k) for k in range(n // 2)], [(f"{k:02d}.tsv", 1 - k % 2) for k in range(n)]


def test_batches_of_few_files_share_a_micro_batch(spark, tmp_path):
    jobs, files = lines_by_file(tmp_path / "files", 20)
    assert I.Import(spark, str(tmp_path / "to")).run(str(tmp_path / "files"), files_per_batch=1) == 20
    assert imported(spark, str(tmp_path / "to")) == (sorted(jobs), files)
    assert [r.batch for r in I.Import(spark, str(tmp_path / "to")).files().orderBy("name").collect()] == [*range(20)]
    assert len([p for p in (tmp_path / "to/log/commits").iterdir() if p.name.isdigit()]) == 1


def test_a_step_that_broke_goes_on_in_bounded_runs_and_other_batches(spark, tmp_path, monkeypatch):
    jobs, files = lines_by_file(tmp_path / "files", 12)
    plain = I.Import.take

    def breaks(self, listed, number):
        if number == 2:
            raise OSError("lost")
        plain(self, listed, number)

    own = I.Import(spark, str(tmp_path / "to"))
    monkeypatch.setattr(I.Import, "take", breaks)
    with pytest.raises(Exception, match="lost"):
        own.run(str(tmp_path / "files"), files_per_batch=2)
    monkeypatch.setattr(I.Import, "take", plain)
    for done, (size, batches) in zip((5, 7, 10), ((1, 1), (1, 2), (3, 1)), strict=True):
        assert own.run(str(tmp_path / "files"), files_per_batch=size, batches=batches) == batches
        assert imported(spark, str(tmp_path / "to"))[1] == files[:done]
    assert own.run(str(tmp_path / "files"), files_per_batch=5) == 1
    assert imported(spark, str(tmp_path / "to")) == (sorted(jobs), files)


def test_files_are_imported_in_the_order_of_their_numbers(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("c_custkey"), F.lit("FURNITURE").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    first = {}
    for k in range(2000):
        first.setdefault(f"pano-{k * 7 % 900}", k // 150)
    assert {r.asset_id: r.file for r in P.resumed_import(spark, str(tmp_path)).collect()} == first


def test_the_limit_rule(spark):
    names = "asset_id string, capture string, lane string, model string"
    jobs = [(f"a{k % 9}" if k < 12 else f"b{k}", "c", "scene", "m", k) for k in range(27)]
    have = spark.createDataFrame([("a0", "c", "scene", "m")], names)
    table = spark.createDataFrame(jobs, f"{names}, position long").repartition(3)

    def plain(limit, batch):
        known, total, out, pending = {"a0"}, 0, [], []

        def insert(rows):
            fresh = [r for i, r in enumerate(rows) if r[0] not in known and r[0] not in {x[0] for x in rows[:i]}]
            known.update(r[0] for r in fresh)
            out.extend(r[4] for r in fresh)
            return len(fresh)

        for job in jobs:
            pending.append(job)
            if len(pending) == batch:
                total += insert(pending)
                pending = []
                if total >= limit:
                    break
        if pending and total < limit:
            insert(pending[: limit - total])
        return out

    for limit in (0, 1, 5, 14, 19, 100):
        got = sorted(r.position for r in I.limited(table, have, limit, batch=5).collect())
        assert got == plain(limit, 5), limit


class _Handle:
    """States of a queue in plain memory."""

    class Map(dict):
        iterator = dict.items
        updateValue = dict.__setitem__

    class List(list):
        get = list.copy
        put = lambda self, rows: self.__setitem__(slice(None), rows)

    def __init__(self):
        self.timers = set()
        self.getMapState = lambda *_: self.Map()
        self.getListState = lambda *_: self.List()
        self.listTimers, self.registerTimer, self.deleteTimer = (lambda: self.timers), self.timers.add, self.timers.discard


def test_a_step_of_a_queue_does_not_go_through_all_its_accounts():
    processor, n, looked = L.LeaseProcessor(3, 7, 10**9, 2 * 10**9), 4000, [0]
    processor.init(_Handle())

    class Leases(dict):  # counts the leases that are gone through
        def items(self):
            looked[0] += len(self)
            return dict.items(self)

    load = processor._load
    processor._load = lambda: (load(), setattr(processor, "lease_of", Leases(processor.lease_of)))
    frames = [pd.DataFrame({"at": range(n), "event_id": range(n), "account": range(n), "kind": ["ask"] * n}), pd.DataFrame({"at": range(n, 2 * n), "event_id": range(n), "account": range(n), "kind": ["submit"] * n})]
    out = pd.concat(processor.handleInputRows((1,), iter(frames), None))
    assert out["kind"].tolist() == ["leased"] * n + ["submitted"] * n and out["shard"].tolist() == [*range(n)] * 2
    assert looked[0] <= n
