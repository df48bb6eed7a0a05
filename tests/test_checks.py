"""Overlap, grounding and votes against plain Python, and their edges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkledger.operators import agreement, overlap


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
        best, row = max(best, *new), new
    return best


def test_longest_runs(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcd")  # noqa: E731 - so few words that runs repeat in a text
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(i, "\n".join([word() for _ in range(60)] + (items[i % 12][1].split()[3:30]) + [word() for _ in range(30)])) for i in range(30)] + [(99, None), (98, "a")]
    got = {(r.item_id, r.doc_id): (r.words, r.item_words) for r in overlap.longest_common_runs(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), least=5).collect()}
    want = {}
    for i, a in items:
        for d, b in docs:
            n = longest((a or "").split(), (b or "").split())
            if n >= 5:
                want[i, d] = (n, len(a.split()))
    assert len(want) > 100 and got == want


def test_the_filter_holds_all_and_little_else(spark):
    runs = spark.range(20_000).select(F.concat(F.lit("run "), F.col("id")).alias("run"))
    bits = overlap.bloom_filter(runs)
    asked = spark.range(40_000).select("id", F.concat(F.lit("run "), F.col("id")).alias("run")).crossJoin(F.broadcast(bits)).select("id", overlap.might_contain(F.col("bits"), F.col("run")).alias("maybe"))
    r = asked.agg(F.count_if((F.col("id") < 20_000) & F.col("maybe")).alias("held"), F.count_if((F.col("id") >= 20_000) & F.col("maybe")).alias("false")).first()
    assert r.held == 20_000 and r.false < 100
    empty = overlap.bloom_filter(runs.limit(0))
    assert empty.count() == 1 and not spark.range(1).crossJoin(empty).select(overlap.might_contain(F.col("bits"), F.lit("x")).alias("m")).first().m


def test_literals(evaluate):
    rows = [("answer = (5829 - 57.5) / 1e3 + .5 - x2 - step_1",), ("answer = '12' # 13\n",), (None,), ("a.5 + 2.",)]
    got = [r["x"] for r in evaluate(rows, "p string", x=agreement.literals(F.col("p")))]
    assert got == [[5829.0, 57.5, 1000.0, 0.5], [], None, [2.0]]


def test_band_join_is_the_tolerance(spark):
    rng = random.Random(5)
    ys = [0.0, 1.0, -1.0, 0.9995, 1.0005, 1e-9, 1e9] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 7) for _ in range(200)]
    xs = [y + s * 1e-3 * max(abs(y), 1) * f for y in ys for s in (-1, 1) for f in (0.0, 0.5, 0.999999, 1.000001, 2)]
    left, right = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i int, x double"), spark.createDataFrame([("k", j, y) for j, y in enumerate(ys)], "k string, j int, y double")
    met = agreement.band_join(left, right, ["k"], "x", "y")
    assert sorted((r.i, r.j) for r in met.collect()) == sorted((i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if abs(x - y) <= 1e-3 * max(abs(y), 1.0))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grounding(spark):
    programs = spark.createDataFrame([("a", "answer = 5 - 3"), ("b", "answer = 5 / 100"), ("c", None), ("d", "answer = x"), ("e", "answer = 7 + 7")], "uid string, p string")
    cells = spark.createDataFrame([("a", 5.0), ("a", 4.0), ("b", -5.0), ("e", None), ("z", 7.0)], "uid string, y double")
    got = {r.uid: (r.named, r.found, r.grounded) for r in agreement.grounded(programs, cells, "uid", "p", "y").collect()}
    assert got == {"a": (2, 1, False), "b": (1, 1, True), "c": (0, 0, None), "d": (0, 0, True), "e": (1, 0, False)}


def test_votes(spark):
    rows = [("a", 0, 1.0, None), ("a", 1, 2.0, None), ("a", 2, 2.001, None), ("b", 0, 5.0, None), ("b", 1, None, " Yes"), ("b", 2, None, "yes"), ("b", 3, 5.0, None), ("c", 0, None, None), ("d", 3, None, "no"), ("d", 1, 4.0, None)]
    got = {r.q: (r.n, r.groups, r.votes, r.num, r.text) for r in agreement.vote(spark.createDataFrame(rows, "q string, at int, num double, text string"), ["q"], "at", "num", "text").collect()}
    assert got == {"a": (3, 2, 2, 2.0, None), "b": (4, 2, 2, 5.0, None), "c": (0, 0, 0, None, None), "d": (2, 2, 1, 4.0, None)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_faithful_items_are_made_once(spark):
    from sparkledger.plans import catalogue

    found = catalogue.QUERIES["faithful_and_grounded"](spark, "/root/testdata/sf0.001")
    assert found.count() == 3 and not [f for f in found.inputFiles() if "testdata" in f]  # it reads what was stored
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2  # predictions with gold answers, programs with cells
