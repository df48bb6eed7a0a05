import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.functions import costs, ids
from sparkledger.operators import ablation, breakdown, latest, planning, rates, registry, roadmap, sandbox, stats
from sparkledger.plans import catalogue


def test_latest_and_ties(spark):
    log = spark.createDataFrame([("a", 1.0, 0, 0.1), ("a", 1.0, 1, 0.2), ("b", None, 2, 0.3), ("b", 5.0, 3, 0.4)], "exp_id string, timestamp double, ord int, v double")
    got = {r.exp_id: r.v for r in ablation.current_runs(log).collect()}
    assert got == {"a": 0.2, "b": 0.4}
    assert ablation.current_runs(log.limit(0)).count() == 0


def test_gap_from_rounded_means(spark):
    rows = [("finqa", "A5", "m", "", s, k, 10, e) for s, k, e in (("standard", 0, 0.51234), ("standard", 1, 0.6), ("clean", 0, 0.4), ("clean", 1, 0.41))]
    runs = spark.createDataFrame(rows, "dataset string, arm string, model string, variant string, split string, ord int, n_examples int, exact_match double")
    r = ablation.ablation(ablation.per_split(runs)).first()
    assert (r.exact_match_standard, r.exact_match_clean, r.contamination_gap, r.n_seeds_clean, r.n_standard) == (0.5562, 0.405, 0.1512, 2, 10)


def test_empty_rates(spark):
    none = spark.createDataFrame([], "p double, g double, c boolean")
    from sparkledger.functions.numbers import number

    p, g = number(F.col("p")), number(F.col("g"))
    r = none.agg(rates.exact_match(p, g).alias("a"), rates.executability_rate(p).alias("b"), rates.program_faithfulness(F.col("c"), p, g).alias("c"), rates.proxy_agreement(p, g).alias("d"), rates.average(F.col("p")).alias("e")).first()
    assert tuple(r) == (0.0, 0.0, None, None, None)


def test_mcnemar_and_holm(spark):
    assert stats.binomial_two_sided(0, 0) == 1 and stats.binomial_two_sided(1, 10) == pytest.approx(22 / 1024)
    tests = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    got = {r.i: r.p_holm for r in stats.holm(tests, "p", order="i").collect()}
    assert got == pytest.approx({0: 0.03, 2: 0.06, 1: 0.06})


def test_latest_with_aggregates_in_one_pass(spark):
    log = spark.createDataFrame([("a", 1.0, 1, 5), ("a", 1.0, 2, 6), ("b", None, 3, 7)], "exp_id string, timestamp double, ord int, v int")
    found = ablation.current_runs(log, F.count("*").alias("lines"), F.min("v").alias("least"))
    assert found.columns == [*log.columns, "lines", "least"] and {tuple(r) for r in found.collect()} == {("a", 1.0, 2, 6, 2, 5), ("b", None, 3, 7, 1, 7)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_log_ties_read_each_log_once(spark):
    plan = catalogue.QUERIES["log_ties"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [exp_id") == 2 and plan.count("max(struct(timestamp") == 2  # one aggregate a log, with a place kept once


def test_item_scores_need_all_runs(spark):
    items = spark.createDataFrame([("g", "r1", "a", True), ("g", "r2", "a", False), ("g", "r1", "b", True)], "g string, exp_id string, uid string, correct boolean")
    assert [(r.uid, r.score) for r in rates.item_scores(items, ["g"]).collect()] == [("a", 0.5)]


def test_state_machine(spark):
    seq = {
        "done": ["running", "completed"], "twice": ["running", "failed", "running", "failed"], "once": ["running", "failed"], "stub": ["running", "not_ready"],
        "reset": ["running", "failed", "running", "failed", "reset"], "nothing": ["reset"],
    }
    rows = [(k, float(i), i, e, "why") for k, es in seq.items() for i, e in enumerate(es)]
    got = {r.exp_id: (r.status, r.attempts) for r in registry.fold(spark.createDataFrame(rows, "exp_id string, ts double, ord int, event string, error string")).collect()}
    assert got == {"done": ("completed", 1), "twice": ("permanently_failed", 2), "once": ("failed", 1), "stub": ("pending", 0), "reset": ("pending", 0)}


def test_should_run(spark):
    rows = [("a", None, None, None, None), ("b", "completed", 1, 2, 0.0), ("c", "running", 1, 2, 0.0), ("d", "running", 2, 2, 0.0), ("e", "running", 1, 2, 99999.0), ("f", "failed", 1, 2, 0.0), ("g", "failed", 2, 2, 0.0), ("h", "pending", 0, 2, 0.0), ("i", "odd", 0, 2, 0.0)]
    states = spark.createDataFrame(rows, "exp_id string, status string, attempts int, max_attempts int, last_update double")
    got = {r.exp_id: r.run for r in registry.should_run(states, F.lit(100000.0)).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": True, "g": False, "h": True, "i": True}


def test_sandbox():
    ok = sandbox.run_program("import math\nanswer = math.sqrt(16)")
    assert ok["ok"] and ok["num"] == 4.0
    assert sandbox.run_program("answer = 'yes'")["text"] == "yes"
    assert not sandbox.run_program("x = 1")["ok"]
    for bad in ("answer = open('/etc/passwd').read()", "import os\nanswer = os.listdir('/')", "import subprocess\nanswer = subprocess.run(['ls'])", "import socket\nanswer = socket.socket()", "answer = 1 / 0", "answer = (", "open('x', 'w')\nanswer = 1"):
        r = sandbox.run_program(bad)
        assert not r["ok"] and r["error"], bad
    slow = sandbox.run_program("while True: pass\nanswer = 1", wall_s=1)
    assert slow["timed_out"] and not slow["ok"]
    assert sandbox.run_program("answer = [1, 2]")["text"] == "[1, 2]"


def test_plan(spark):
    combos = planning.grid(spark, {"arm": ["A5", "A1"], "model": ["s"], "seed": [1, 0]})
    arms = spark.createDataFrame([("A5", "student"), ("A1", "student")], "arm string, role string")
    models = spark.createDataFrame([("s", "student", False)], "model string, tier string, phase2_only boolean")
    found = planning.compatible(combos, arms, models, 1, spark.createDataFrame([("A1", "M")], "arm string, priority string")).withColumn("experiment_id", F.concat("arm", F.col("seed").cast("string")))
    assert [r.experiment_id for r in planning.run_order(found).orderBy("position").collect()] == ["A10", "A50", "A51"]
    assert [r.experiment_id for r in planning.select_plan(found, "MS").collect()] == ["A10"]


def test_ids(evaluate):
    got = evaluate([(2e-4, 0.05, 1e-5, 0.0, 1e16)], "a double, b double, c double, d double, e double", **{k: ids.float_text(F.col(k)) for k in "abcde"})[0]
    assert [got[k] for k in "abcde"] == ["0.0002", "0.05", "1e-05", "0.0", "1e+16"]
    j = evaluate([("x", None)], "s string, n int", j=ids.canonical_json({"b": (F.col("s"), "string"), "a": (F.col("n"), "int")}))[0]["j"]
    assert j == '{"a": null, "b": "x"}'


def test_costs(spark, evaluate):
    got = evaluate([(100, 4), (10, 3), (0, 4), (2, 4)], "t int, c int", s=costs.selection_steps(F.col("t"), F.col("c")))
    assert [r["s"] for r in got] == [[25, 50, 75, 100], [4, 8, 10], [], [1, 2]]
    prices = spark.createDataFrame([("T4", None, 0), ("Tesla", 2.0, 1)], "gpu_key string, usd_per_gpu_hour double, ord int")
    runs = spark.createDataFrame([("Tesla T4",), ("Tesla V100",), (None,)], "gpu string")
    assert [r.usd_per_gpu_hour for r in costs.with_gpu_price(runs, prices).collect()] == [None, 2.0, None]


def test_length_buckets(spark):
    rows = spark.createDataFrame([(i, i) for i in range(1, 9)] + [(9, None)], "uid int, n int")
    got = breakdown.length_buckets(rows, "n").groupBy("bucket").agg(F.sort_array(F.collect_list("uid")).alias("u")).orderBy("bucket").collect()
    assert [r.u for r in got] == [[1, 2, 9], [3, 4], [5, 6], [7, 8]]
    zero = spark.createDataFrame([(1, 0)], "uid int, n int")
    assert breakdown.length_buckets(zero, "n").first().bucket is None


def test_checkpoint_choice(spark):
    rows = [("a", 10, 0.5, None), ("a", 20, 0.5, 0.1), ("a", 30, 0.5, 0.1), ("b", 10, None, None), ("b", 20, None, None)]
    got = {r.e: r.step for r in breakdown.best_checkpoint(spark.createDataFrame(rows, "e string, step int, dev_em double, faithfulness double"), "e").collect()}
    assert got == {"a": 20, "b": 20}


def test_restore(spark):
    a = spark.createDataFrame([("x", "running")], "path string, status string")
    b = spark.createDataFrame([("x", "completed"), ("y", "completed")], "path string, status string")
    assert {tuple(r) for r in latest.restore([a, b], ["path"]).collect()} == {("x", "failed"), ("y", "completed")}


def test_titles(evaluate):
    rows = [("Share adapters.", " Text.", "Share adapters"), ("", " Next thing; more", "Next thing"), ("x" * 95, "", "x" * 87 + "...")]
    got = evaluate([r[:2] for r in rows], "a string, b string", t=roadmap.title(F.col("a"), F.col("b")))
    assert [r["t"] for r in got] == [r[2] for r in rows]


def test_spot_check_and_gate(spark):
    rows = [("a", "answer = 2 * 3", 6.0), ("b", "answer = 1", 2.0), ("c", None, 1.0), ("d", "answer = 1 / 0", 0.0)]
    records = spark.createDataFrame(rows, "uid string, gold_program string, v double").select("uid", "gold_program", F.struct(F.col("v").alias("num"), F.lit(None).cast("string").alias("text")).alias("answer"))
    assert tuple(sandbox.spot_check(records, 10).first()) == (3, 1)
    assert [r.uid for r in sandbox.verify(records).collect()] == ["a"]
