"""Streaming forms of the queue and the ledger: exactly-once credit, lease states per account, windows over events."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.tables import new_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def large_state(spark: SparkSession):
    """Queries that start within keep their state in RocksDB, which named states and timers need; the session's own choice holds again afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def drained(stream: DataFrame, label: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over what there is and read what it wrote.

    Offsets, state and output are in the shared folder: in one of their own, or below at, where a later call goes on.
    """
    spark = stream.sparkSession
    path, log = (f"{at}/out", f"{at}/log") if at else (new_path(spark, label), new_path(spark, f"{label}-log"))
    if mode == "append":
        with large_state(spark):
            query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    else:  # each batch's changed rows; the last batch of a key holds
        def put(df: DataFrame, number: int) -> None:
            df.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def credited_once(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Bookings by reference, each once within the delay; its state is dropped when the watermark passes."""
    money = events.where(F.col("event_type").isin("purchase", "error"))
    sign = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    rows = money.withWatermark("ts", delay).select("ts", F.col("user_id").alias("account_id"), (F.round(F.col("value") * 100, 0).cast("long") * sign).alias("units"), F.col("event_id").alias("reference"))
    return rows.dropDuplicatesWithinWatermark(["reference"])


def lease_states(events: DataFrame, seconds: int = 1800, keep: str = "365 days") -> DataFrame:
    """Per account the state of its lease after its events in order of time: (user_id, state, generation, units, until).

    A view leases, or resumes a live lease; an error releases; a signup renews; a purchase submits once per lease. A lease
    that its time has passed is expired and a renewal revives it. An account's state is dropped when the watermark, which
    trails the newest event by keep, has passed its last event and its lease.
    """
    schema = "user_id long, state string, generation long, units long, until double"

    def advance(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        kind, generation, units, until = state.get if state.exists else ("none", 0, 0, 0.0)
        rows = pd.concat([f for f in frames if len(f)]).sort_values(["ts", "event_id"])
        now = 0.0
        for ts, what in zip(rows["ts"], rows["event_type"], strict=True):
            now = ts.timestamp()
            if kind == "active" and until <= now:
                kind = "expired"
            if what == "view" and kind != "active":
                kind, generation, until = "active", generation + 1, now + seconds
            elif what == "error" and kind == "active":
                kind = "released"
            elif what == "signup" and kind in ("active", "expired"):
                kind, until = "active", now + seconds
            elif what == "purchase" and kind == "active":
                kind, units = "submitted", units + 1
        state.update((kind, int(generation), int(units), float(until)))
        state.setTimeoutTimestamp(max(int(max(now, until) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "state": [kind], "generation": [generation], "units": [units], "until": [until]})

    timed = events.withWatermark("ts", keep)
    return timed.groupBy("user_id").applyInPandasWithState(advance, schema, "state string, generation long, units long, until double", "update", GroupStateTimeout.EventTimeTimeout)


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", "1 day")
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.unix_timestamp("w.start").alias("day"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", delay).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("s.start").alias("start"), "n")
