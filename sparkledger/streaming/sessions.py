"""Runs over streams of their events: silence that ends a run without using an attempt (R8, R7), and seconds added up across sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.latest import latest_per_key

STATE = "status string, attempts int, last_ts long, pauses int"
OUTPUT = "exp_id string, status string, attempts int, pauses int, at long"


def step(state: tuple[str, int, int, int], event: str, ts: int, max_attempts: int) -> tuple[str, int, int, int]:
    """The state after an event, as registry.fold has it: status, attempts, the time of the last event in microseconds, pauses."""
    status, attempts, _, pauses = state
    if event == "running":
        return "running", attempts + 1, ts, pauses
    if event == "failed":
        return "permanently_failed" if attempts >= max_attempts else "failed", attempts, ts, pauses
    if event == "not_ready":
        return "pending", max(attempts - 1, 0), ts, pauses
    if event == "reset":
        return "pending", 0, ts, pauses
    return event, attempts, ts, pauses


def silence(state: tuple[str, int, int, int], silent: int) -> tuple[str, int, int, int]:
    """A running state that nothing was heard of for so long: paused, and its attempt is given back."""
    status, attempts, last, pauses = state
    return ("paused", max(attempts - 1, 0), last + silent, pauses + 1) if status == "running" else state


class SilentRuns(StatefulProcessor):
    """The state of each run, with a timer in event time while it runs.

    Events of a micro-batch are taken in order of time and number. A gap that is too long is a pause also where both of its events come in one batch,
    so states don't depend on how events are dealt to batches, as long as they are no later than the watermark."""

    def __init__(self, silent_us: int, max_attempts: int):
        self.silent, self.max_attempts = silent_us, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)

    def _store(self, state: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if state[0] == "running":
            self.handle.registerTimer(-(-(state[2] + self.silent) // 1000))
        self.state.update(state)

    def _row(self, key: tuple, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"exp_id": [key[0]], "status": [state[0]], "attempts": [state[1]], "pauses": [state[3]], "at": [state[2]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "ord"])
        state = tuple(self.state.get()) if self.state.exists() else ("pending", 0, 0, 0)
        for event, ts in zip(batch["event"], batch["ts"].astype("int64")):
            if state[0] == "running" and ts - state[2] > self.silent:
                state = silence(state, self.silent)
            state = step(state, event, int(ts), self.max_attempts)
        self._store(state)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get())
        if state[0] != "running" or expiredTimerInfo.getExpiryTimeInMs() * 1000 < state[2] + self.silent:
            return  # it was heard of meanwhile
        state = silence(state, self.silent)
        self._store(state)
        yield self._row(key, state)

    def close(self) -> None:
        pass


def run_states(events: DataFrame, silent_s: int, max_attempts: int = 2, late: str = "0 seconds") -> DataFrame:
    """exp_id, status, attempts, pauses, at (of the last change, in microseconds), whenever a run's state changes. events: exp_id, time, ord, event; a stream.

    Needs Spark's RocksDB state store."""
    rows = events.withWatermark("time", late).select(F.col("exp_id").cast("string").alias("exp_id"), "time", F.unix_micros("time").alias("ts"), "ord", "event")
    return rows.groupBy("exp_id").transformWithStateInPandas(SilentRuns(silent_s * 1_000_000, max_attempts), OUTPUT, "Update", "EventTime")


def final_states(spark: SparkSession, events: Callable[[], DataFrame], silent_s: int, folder: str, max_attempts: int = 2, late: str = "0 seconds") -> DataFrame:
    """Runs the stream over all there is; the last state of each run. Changes are stored by batch, so a batch that is repeated replaces its own."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        write = lambda df, number: df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/part={number}")
        query = run_states(events(), silent_s, max_attempts, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    changes = spark.read.schema(f"{OUTPUT}, batch long").parquet(f"{folder}/changes")
    return latest_per_key(changes, ["exp_id"], F.col("batch"), F.col("at"))


def add_seconds(totals: DataFrame | None, rows: DataFrame, number: int) -> DataFrame:
    """Totals (key, seconds, batch) with the seconds of a batch added, rounded to tenths after each session, in order of `ord`; no seconds add none.

    A total that already holds the batch stays as it is, so a batch that comes again changes nothing. What a key's batch adds is bounded by its sessions."""
    added = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "seconds"))).alias("_add"))
    if totals is None:
        totals = rows.sparkSession.createDataFrame([], f"key {dict(rows.dtypes)['key']}, seconds double, batch long")
    both = totals.join(added, "key", "full")
    grown = F.aggregate(F.col("_add"), F.coalesce("seconds", F.lit(0.0)), lambda total, x: F.round(total + F.coalesce(x["seconds"], F.lit(0.0)), 1))
    fresh = F.col("_add").isNotNull() & F.coalesce(F.col("batch") < number, F.lit(True))
    return both.select("key", F.when(fresh, grown).otherwise(F.col("seconds")).alias("seconds"), F.when(fresh, F.lit(number)).otherwise(F.col("batch")).cast("long").alias("batch"))


def seconds_sink(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps totals below folder, a snapshot a batch; the newest whole one is the state, also after a restart."""

    def batch(rows: DataFrame, number: int) -> None:
        made = add_seconds(read_totals(spark, folder), rows, number)
        # A repeated batch finds its own snapshot, which stays; two names, as a table can't be replaced by itself.
        made.write.mode("overwrite").parquet(f"{folder}/totals/{number:012d}-{len(_snapshots(spark, folder)):06d}")

    return batch


def _snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Snapshots that were written to their end, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/totals/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().getParent()) for f in found or [])


def read_totals(spark: SparkSession, folder: str) -> DataFrame | None:
    found = _snapshots(spark, folder)
    return spark.read.parquet(found[-1]) if found else None
