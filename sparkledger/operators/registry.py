"""States of runs, folded from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS, STALE_S, ERROR_CHARS = 2, 21600, 4000
# Events and states.
EVENTS = ["running", "completed", "failed", "not_ready", "reset"]
_STATE = "struct<known:boolean,status:string,attempts:int,last_error:string>"


def fold(events: DataFrame, key: str = "exp_id", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The state of each run after its events (key, ts, ord, event, error): status, attempts, last_error, max_attempts, last_update.

    A run's events are a bounded history (attempts are), gathered and folded inside Catalyst. A reset without a state before does nothing."""
    history = F.array_sort(F.collect_list(F.struct("ts", "ord", "event", "error")))
    start = F.lit(None).cast("string")
    state = F.struct(F.lit(False).alias("known"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), start.alias("last_error")).cast(_STATE)

    def step(s: Column, e: Column) -> Column:
        kind = e["event"]
        tries = F.when(kind == "running", s["attempts"] + 1).when(kind == "not_ready", F.greatest(s["attempts"] - 1, F.lit(0))).when(kind == "reset", F.lit(0)).otherwise(s["attempts"])
        status = F.when(kind == "running", "running").when(kind == "completed", "completed").when(kind == "failed", F.when(s["attempts"] >= max_attempts, "permanently_failed").otherwise("failed")).otherwise("pending")
        error = F.when(kind == "failed", F.substring(F.coalesce(e["error"], F.lit("")), 1, ERROR_CHARS)).when(kind == "not_ready", F.substring(F.concat(F.lit("not ready: "), F.coalesce(e["error"], F.lit(""))), 1, ERROR_CHARS)).when(kind == "running", s["last_error"])
        made = F.struct(F.lit(True).alias("known"), status.alias("status"), tries.cast("int").alias("attempts"), error.alias("last_error"))
        return F.when((kind == "reset") & ~s["known"], s).otherwise(made)

    folded = events.groupBy(key).agg(F.aggregate(history, state, step).alias("s"), F.max("ts").alias("last_update"))
    return folded.where("s.known").select(key, "s.status", "s.attempts", "s.last_error", F.lit(max_attempts).alias("max_attempts"), "last_update")


def should_run(states: DataFrame, now: Column, stale_s: int = STALE_S) -> DataFrame:
    """Adds run and reason; a run without a state is new (a left join gives it a null status)."""
    age = now - F.col("last_update")
    more = F.col("attempts") < F.col("max_attempts")
    stale = age > stale_s
    rules = [
        (F.col("status").isNull(), True, F.lit("new")),
        (F.col("status") == "completed", False, F.lit("already completed")),
        (F.col("status") == "permanently_failed", False, F.concat(F.lit("permanently failed after "), F.col("attempts").cast("string"), F.lit(" attempt(s)"))),
        ((F.col("status") == "running") & stale & more, True, F.lit("stale running, retrying")),
        ((F.col("status") == "running") & stale, False, F.lit("stale running but out of attempts")),
        (F.col("status") == "running", False, F.lit("currently running")),
        ((F.col("status") == "failed") & more, True, F.concat(F.lit("retry "), (F.col("attempts") + 1).cast("string"), F.lit("/"), F.col("max_attempts").cast("string"))),
        (F.col("status") == "failed", False, F.lit("out of retry attempts")),
        (F.col("status") == "pending", True, F.lit("pending")),
    ]
    run, reason = F.lit(True), F.lit("unknown status, running")
    for test, yes, why in reversed(rules):
        run, reason = F.when(test, F.lit(yes)).otherwise(run), F.when(test, why).otherwise(reason)
    return states.withColumns({"run": run, "reason": reason})


def status_counts(states: DataFrame) -> DataFrame:
    """Runs of each status."""
    return states.groupBy("status").agg(F.count("*").alias("n"))


def failed(states: DataFrame) -> DataFrame:
    """P5."""
    return states.where(F.col("status").isin("failed", "permanently_failed"))


def latest_first(states: DataFrame, n: int) -> DataFrame:
    """The n states that changed last, the newest first; ties by run."""
    return states.orderBy(F.desc_nulls_last("last_update"), "exp_id").limit(n)
