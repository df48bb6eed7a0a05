"""Streams of run events (R10): the current state per key, and counts per event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import latest_per_key


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """An append log as a stream; a bounded number of files a batch. A single file is a log of one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder if folder.endswith("/") or "*" in folder else f"{folder}*")


def upsert_latest(key: str, order: list[str], read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key: the batch's latest and the snapshot's rows are reduced together.

    read gives the snapshot (None at first), write stores the next one under the batch's number; a batch that is repeated writes the same."""

    def batch(rows: DataFrame, number: int) -> None:
        fresh = latest_per_key(rows, [key], *map(F.col, order))
        old = read()
        both = fresh if old is None else fresh.unionByName(old)
        write(latest_per_key(both, [key], *map(F.col, order)), number)

    return batch


def latest_snapshot(spark: SparkSession, source: str, schema: str, key: str, order: list[str], folder: str) -> DataFrame:
    """Runs the stream over all there is and returns the final state per key. Snapshots are folders by batch number."""
    kept: list[str] = []

    def read() -> DataFrame | None:
        return spark.read.parquet(kept[-1]) if kept else None

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        kept.append(f"{folder}/batch={number}")

    query = read_events(spark, source, schema).writeStream.foreachBatch(upsert_latest(key, order, read, write)).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(kept[-1])


def tumbling_counts(events: DataFrame, time: str, width: str, *by: str, late: str = "1 hour") -> DataFrame:
    """Events per window of event time; rows later than `late` behind the newest are dropped. Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
