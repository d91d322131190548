"""Stateful behaviour over streams, and the same as batch queries: keyed cache, key cooldowns, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STRIKES, COOLDOWN_S = 3, 60


def error_runs(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type", failing: str = "error", least: int = STRIKES) -> DataFrame:
    """Z02 in batch: per user the runs of at least three failures in a row, with the time until which the key rests."""
    order = W.partitionBy(user).orderBy(ts, "event_id")
    rows = events.withColumn("__n", F.row_number().over(order)).filter(F.col(kind) == failing)
    island = F.col("__n") - F.row_number().over(order)
    runs = rows.withColumn("__i", island).groupBy(user, "__i").agg(F.count(F.lit(1)).alias("failures"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return runs.filter(F.col("failures") >= least).select(user, "failures", "first", "last", (F.col("last") + F.expr(f"interval {COOLDOWN_S} seconds")).alias("rests_until"))


def cooldowns(stream: DataFrame, user: str = "user_id", kind: str = "event_type", failing: str = "error") -> DataFrame:
    """Z02 on a stream: (user, cooldowns, strikes) after each batch; the state is two counters per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes, rests = state.get if state.exists else (0, 0)
        for pdf in batches:
            for k in pdf.sort_values(["ts", "event_id"])[kind]:
                strikes = strikes + 1 if k == failing else 0
                if strikes == STRIKES:
                    rests, strikes = rests + 1, 0
        state.update((strikes, rests))
        yield pd.DataFrame({user: [key[0]], "cooldowns": [rests], "strikes": [strikes]})

    return stream.groupBy(user).applyInPandasWithState(step, f"{user} long, cooldowns int, strikes int", "strikes int, rests int", "update", GroupStateTimeout.NoTimeout)


RUNS = "user_id long, kind string, failures long, first timestamp, last timestamp, rests_until timestamp"


class KeyRuns(StatefulProcessor):
    """A key's failures in a row.  From the third on each one is a row that supersedes the run's earlier ones; an
    event-time timer at the end of the rest that the latest failure began gives a row that the key is free again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "failures long, first timestamp, last timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.run.get() if self.run.exists() else None
        failures, first, last = held if held else (0, None, None)
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for ts, failed in zip(events["ts"], events["failed"]):
            if not failed:
                failures, first = 0, None
                continue
            failures, first, last = failures + 1, first if failures else ts, ts
            if failures >= STRIKES:
                out.append((key[0], "run", failures, first, last, last + pd.Timedelta(seconds=COOLDOWN_S)))
        if failures:
            self.run.update((failures, first, last))
        else:
            self.run.clear()
        if out:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(out[-1][5].tz_localize("UTC").timestamp() * 1000))
        yield self.rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield self.rows([(key[0], "rested", 0, None, None, at)])

    def close(self) -> None:
        pass

    @staticmethod
    def rows(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["user_id", "kind", "failures", "first", "last", "rests_until"])
        return frame.astype({"user_id": "int64", "failures": "int64", "first": "datetime64[us]", "last": "datetime64[us]", "rests_until": "datetime64[us]"})


def key_runs(stream: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type", failing: str = "error", late: str = "0 seconds") -> DataFrame:
    """Z02 on a stream: rows of kind `run` (user_id, failures, first, last, rests_until), the last of which for each user and
    `first` are those of `error_runs` on the same events in order, and rows of kind `rested` once a rest is over in event time.

    Needs the RocksDB state store.  Events of a key must not be out of order across batches; within one they may be.  Rows
    without a user or a time are left out.  State: one count and two times a key, cleared by a success.
    """
    rows = stream.select(F.col(user).cast("long").alias("user_id"), F.col(ts).cast("timestamp").alias("ts"), "event_id", (F.col(kind) == failing).alias("failed")).dropna(subset=["user_id", "ts"]).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(KeyRuns(), RUNS, "Update", "EventTime")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event counts and values per window and type, with a watermark for late rows."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_to_cache(stream: DataFrame, path: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Appends each batch's first entry per key; a repeated batch writes the same rows under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
