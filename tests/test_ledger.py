"""The log of runs: order by commits and lines, batches that repeat, failures, plain files beside it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkledger.operators import ablation
from sparkledger.sources import ledger, readers, sinks


def runs_of(spark, values, n=None):
    return spark.createDataFrame([(f"r{i % (n or len(values))}", 1.0, v) for i, v in enumerate(values)], "exp_id string, timestamp double, exact_match double")


def current(spark, at):
    return {r.exp_id: r.exact_match for r in ablation.current_runs(readers.load_results(spark, at)).collect()}


@pytest.mark.parametrize("small_first", [True, False])
def test_later_commits_win_whatever_their_size(spark, tmp_path, small_first):
    at = f"file://{tmp_path}/runs"
    large, small = runs_of(spark, [0.1] * 3000, 30).repartition(4), runs_of(spark, [0.9] * 30)
    for batch in (small, large) if small_first else (large, small):
        sinks.append_runs(batch, at, copies=False)
    assert set(current(spark, at).values()) == {0.1 if small_first else 0.9}
    assert readers.load_results(spark, at).count() == 3030


def test_the_last_line_of_a_commit_counts(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    rows = spark.range(4000).select(F.lit("a/b=c").alias("exp_id"), F.lit(1.0).alias("timestamp"), (F.col("id") % 997).cast("double").alias("exact_match"), F.col("id").alias("seed"))
    sinks.append_runs(rows.repartition(6), at, F.desc("exact_match"), F.col("seed"), copies=False)
    assert current(spark, at) == {"a/b=c": 0.0}
    assert ablation.current_runs(readers.load_results(spark, at)).first().seed == 997 * 4


def test_repeated_batches_and_copies(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    sinks.append_runs(runs_of(spark, [0.1, 0.2]), at, batch="session/1")
    sinks.append_runs(runs_of(spark, [0.7, 0.8]), at, batch="session/1")
    sinks.append_runs(runs_of(spark, [0.3]), at, batch="session/2")
    assert current(spark, at) == {"r0": 0.3, "r1": 0.2} and readers.load_results(spark, at).count() == 3
    assert {r.exp_id: r.exact_match for r in readers.load_run_copies(spark, at).collect()} == {"r0": 0.3, "r1": 0.2}


def test_a_failing_task_leaves_the_old_state(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    states = spark.range(40).select(F.concat(F.lit("r"), F.col("id")).alias("exp_id"), F.lit("failed").alias("status"), F.lit(1).alias("attempts"), "id")
    sinks.save_states(states.drop("id"), at)
    sinks.save_states(states.where("id < 5").drop("id").withColumn("status", F.lit("completed")), at)
    broken = states.repartition(4, "id").withColumn("status", F.when(F.col("id") == 33, F.raise_error(F.lit("on purpose"))).otherwise(F.lit("lost"))).drop("id")
    with pytest.raises(Exception, match="on purpose"):
        sinks.save_states(broken, at)
    found = {r.exp_id: r.status for r in readers.load_states(spark, at).collect()}
    assert len(found) == 40 and sorted(set(found.values())) == ["completed", "failed"] and found["r4"] == "completed" and found["r5"] == "failed"
    files = [n for n in os.listdir(f"{tmp_path}/runs/{ledger.COMMITS}") if not n.startswith(".")]
    assert len(files) == 2 and all(n.endswith(".json") for n in files)
    with pytest.raises(Exception, match="only appended"):
        spark.createDataFrame([("a", 0, "{}")], ledger.ROW).write.format("runledger").mode("overwrite").options(path=at, kind="status").save()


def test_plain_logs_keep_the_order_of_their_lines(spark, tmp_path):
    at = tmp_path / "runs"
    at.mkdir()
    lines = [json.dumps({"exp_id": f"r{i % 7}", "timestamp": 1.0, "exact_match": i / 1000}) for i in range(30_000)]
    (at / "results.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        want = {f"r{i % 7}": i / 1000 for i in range(30_000)}
        assert current(spark, f"file://{at}") == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert readers.load_results(spark, f"file://{at}").count() == 30_000


def test_empty(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    assert readers.load_results(spark, at).count() == readers.load_states(spark, at).count() == readers.load_run_copies(spark, at).count() == 0
    assert readers.load_predictions(spark, at).count() == 0
    sinks.append_runs(runs_of(spark, [0.5]).limit(0), at)
    assert readers.load_results(spark, at).count() == 0
