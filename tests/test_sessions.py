"""Streams of run events: pauses by timers, however events are dealt to batches; seconds that a repeated batch doesn't add twice; budgets."""

import datetime as dt

from pyspark.sql import functions as F

from sparkledger.operators import planning
from sparkledger.streaming import runs as streams
from sparkledger.streaming import sessions

SCHEMA = "exp_id string, time timestamp, ord long, event string"
START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return START + dt.timedelta(hours=hours)


EVENTS = [
    [("gap", at(0), 1, "running"), ("done", at(0), 2, "running"), ("late", at(1), 3, "running"), ("twice", at(0), 4, "running"), ("twice", at(1), 5, "failed")],
    [("done", at(2), 6, "completed"), ("gap", at(9), 7, "running"), ("twice", at(2), 8, "running"), ("twice", at(3), 9, "failed")],
    [("gap", at(20), 10, "failed"), ("end", at(20), 11, "running")],
]
#: gap: paused between its first two events, and again before the third, whose failure finds no attempt used; late: never heard of again; end: still running.
WANT = {"gap": ("failed", 0, 2), "done": ("completed", 1, 0), "late": ("paused", 0, 1), "twice": ("permanently_failed", 2, 0), "end": ("running", 1, 0)}


def states(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    read = lambda: streams.read_events(spark, f"{tmp_path}/events/", SCHEMA, files_per_trigger=1)
    found = sessions.final_states(spark, read, 5 * 3600, f"file://{tmp_path}/out", late="30 hours" if len(batches) > 1 else "0 seconds")
    return {r.exp_id: (r.status, r.attempts, r.pauses) for r in found.collect()}


def test_pauses_in_one_batch(spark, tmp_path):
    assert states(spark, tmp_path, [sum(EVENTS, [])]) == WANT


def test_pauses_over_batches(spark, tmp_path):
    """A watermark that waits: timers haven't fired when events come, and gaps are found all the same."""
    got = states(spark, tmp_path, [*EVENTS, [("x", at(60), 12, "running")]])
    assert {k: v for k, v in got.items() if k != "x"} == {**WANT, "end": ("paused", 0, 1)}


def test_repeated_batches_add_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "key string, ord long, seconds double")
    folder = f"file://{tmp_path}/s"
    add = sessions.seconds_sink(spark, folder)
    add(rows(("a", 1, 1.04), ("a", 2, 1.04), ("b", 1, 5.0)), 0)
    for _ in range(3):
        add(rows(("a", 3, 2.5)), 1)
    sessions.seconds_sink(spark, folder)(rows(("b", 2, 0.26), ("a", 4, None)), 2)  # another session goes on from what is stored
    got = {r.key: r.seconds for r in sessions.read_totals(spark, folder).collect()}
    assert got == {"a": 4.5, "b": 5.3}
    add(rows(("a", 1, 1.04), ("b", 1, 5.0)), 0)
    assert {r.key: r.seconds for r in sessions.read_totals(spark, folder).collect()} == got


def test_an_unfinished_snapshot_is_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    add = sessions.seconds_sink(spark, folder)
    add(spark.createDataFrame([("a", 1, 2.0)], "key string, ord long, seconds double"), 0)
    (tmp_path / "s/totals/000000000009-000001").mkdir()
    assert sessions.read_totals(spark, folder).first().seconds == 2.0
    assert sessions.read_totals(spark, f"file://{tmp_path}/none") is None


def test_budgets(spark):
    rows = [("s", i, need, 10.0) for i, need in enumerate([4.0, 5.0, 2.0, 1.0])] + [("free", i, 100.0, None) for i in range(3)]
    plan = spark.createDataFrame(rows, "session string, place long, need double, budget double")
    for block in (1, 3, 4096):
        got = {(r.session, r.place): (r.before, r.starts) for r in planning.within_budget(plan, "need", "place", "budget", "session", block=block).collect()}
        assert [got["s", i] for i in range(4)] == [(0, True), (4, True), (9, False), (11, False)] and all(got["free", i][1] for i in range(3))
    assert planning.within_budget(plan.limit(0), "need", "place", "budget", "session").count() == 0
    one = plan.where("session = 's'").drop("session").withColumn("session", F.lit(1))
    assert planning.within_budget(one, "need", "place", "budget", "session").where("starts").count() == 2
