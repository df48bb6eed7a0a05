"""Resampled intervals against exact distributions: binomial quantiles, enumeration of all resamples, the normal approximation at 10^7 items."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.operators import stats
from sparkledger.plans import catalogue

SF = "/root/testdata/sf0.001"


def binomial_quantile(n, p, q):
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
        if total >= q:
            return k / n
    return 1.0


def test_means_of_binary_items_are_binomial(spark):
    cases = {"a": (40, 10), "b": (400, 200), "c": (25, 24)}
    rows = [(g, float(i < k)) for g, (n, k) in cases.items() for i in range(n)]
    items = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in stats.bootstrap_mean(items, ["g"], "v").collect()}
    for g, (n, k) in cases.items():
        assert (got[g].n, got[g].mean) == (n, k / n)
        assert abs(got[g].lo - binomial_quantile(n, k / n, 0.025)) <= 1.01 / n and abs(got[g].hi - binomial_quantile(n, k / n, 0.975)) <= 1.01 / n
    again = {r.g: r for r in stats.bootstrap_mean(items.repartition(2), ["g"], "v").collect()}
    assert again == got  # draws follow from the seed, not from where rows lie
    assert {r.g: r.lo for r in stats.bootstrap_mean(items, ["g"], "v", seed=1, n=777).collect()} != {g: r.lo for g, r in got.items()}


def test_ten_million_items_of_one_group(spark):
    items = spark.range(10_000_000).select(F.lit("all").alias("g"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    r = stats.bootstrap_mean(items, ["g"], "v").first()
    assert r.n == 10_000_000 and abs((r.hi - r.lo) / 2 - 1.96 * math.sqrt(0.25 * 0.75 / 1e7)) < 1e-5 and r.lo < 0.25 < r.hi


def test_many_different_values_are_cut_into_pieces(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(size=20_000)
    items = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double").repartition(4)
    means = stats.resampled_means(items, ["g"], ["v"], n=600)
    r = means.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev("v").alias("sd")).first()
    assert r.n == 600 and abs(r.m - x.mean()) < 5 * x.std() / math.sqrt(20_000 * 600) and abs(r.sd / (x.std() / math.sqrt(20_000)) - 1) < 0.15


def test_intervals_cover(spark):
    """Of 300 samples of a known rate, the intervals of about 95 in 100 hold it."""
    rng = np.random.default_rng(9)
    rows = [(s, float(v)) for s in range(300) for v in rng.random(120) < 0.4]
    got = stats.bootstrap_mean(spark.createDataFrame(rows, "s int, v double"), ["s"], "v", n=2000).collect()
    assert len(got) == 300 and 0.90 <= np.mean([r.lo <= 0.4 <= r.hi for r in got]) <= 0.99


def test_differences(spark):
    rows = [("x", s, i, v) for i in range(60) for s, v in (("a", float(i % 2)), ("b", float(i % 3 == 0)))] + [("y", "a", 0, 1.0)]
    items = spark.createDataFrame(rows, "g string, side string, uid int, v double")
    free = stats.bootstrap_difference(items, ["g"], "side", ("a", "b"), "v").collect()
    assert [r.g for r in free] == ["x"] and free[0].difference == pytest.approx(30 / 60 - 20 / 60) and free[0].lo < free[0].difference < free[0].hi
    same = spark.createDataFrame([("x", s, i, float(i % 2)) for i in range(60) for s in "ab"], "g string, side string, uid int, v double")
    r = stats.bootstrap_difference(same, ["g"], "side", ("a", "b"), "v", paired_by="uid").first()
    assert r.difference == r.lo == r.hi == 0
    assert stats.bootstrap_difference(same, ["g"], "side", ("a", "b"), "v").first().lo < 0
    with pytest.raises(Exception, match="differ in their items"):
        stats.bootstrap_difference(items, ["g"], "side", ("a", "b"), "v", paired_by="uid").collect()
    assert stats.bootstrap_mean(items.limit(0), ["g"], "v").count() == 0
    assert stats.bootstrap_mean(spark.createDataFrame([("n", None)], "g string, v double"), ["g"], "v").count() == 0


def test_gaps_against_all_resamples(spark):
    """Items of four cells, few enough to list every resample: the resampled measures have that distribution."""
    cells = {("standard", 0): (1, 0), ("standard", 1): (1, 1), ("standard", 2): (0, 1), ("clean", 3): (0, 0), ("clean", 4): (1, 0), ("control", 5): (1, 0)}
    rows = [("g", system, split, uid, float(v[j])) for (split, uid), v in cells.items() for j, system in enumerate("LS")] + [("g", "L", "clean", 99, 1.0)]
    items = spark.createDataFrame(rows, "g string, system string, split string, uid int, v double")
    got = {r.measure: r for r in stats.gap_comparison(items, ["g"], "system", ("L", "S"), "split", "v", "uid").collect()}
    std, clean = ([v for (s, _), v in cells.items() if s == name] for name in ("standard", "clean"))
    mean = lambda rows, j: sum(r[j] for r in rows) / len(rows)
    diff = lambda a, b: (mean(a, 0) - mean(b, 0)) - (mean(a, 1) - mean(b, 1))
    every = sorted(diff(a, b) for a in itertools.product(std, repeat=3) for b in itertools.product(clean, repeat=2))
    r = got["gap_difference"]
    assert r.value == pytest.approx(diff(std, clean)) and len(got) == 7
    lo, hi = (every[max(0, int(q * len(every)) - 1)] for q in (0.025, 0.975))
    assert r.lo == pytest.approx(lo, abs=0.17) and r.hi == pytest.approx(hi, abs=0.17)
    assert got["gap_first"].value == pytest.approx(got["style_first"].value + got["recency_first"].value)
    assert got["style_second"].value == pytest.approx(2 / 3 - 0)


def test_exact_tails():
    assert stats.binomial_two_sided(0, 0) == 1 and stats.binomial_two_sided(1, 10) == pytest.approx(22 / 1024)
    assert stats.binomial_two_sided(5, 10) == 1 and stats.binomial_two_sided(499_000, 1_000_000) == pytest.approx(0.0456, abs=2e-4)


def test_counted_items_are_resampled_as_items(spark):
    items = spark.createDataFrame([(i % 2, "ab"[i % 3 % 2], i % 7 / 4) for i in range(500)] + [(1, "a", None)], "g int, side string, v double")
    counted = items.groupBy("g", "side", "v").agg(F.count("*").alias("w"))
    rows = lambda df: sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(stats.bootstrap_mean(counted, ["g", "side"], "v", n=300, weight="w")) == rows(stats.bootstrap_mean(items, ["g", "side"], "v", n=300))
    found = [stats.bootstrap_difference(x, ["g"], "side", ("a", "b"), "v", n=300, weight=w) for x, w in ((counted, "w"), (items, None))]
    assert rows(found[0]) == rows(found[1]) and len(rows(found[0])) == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_items_of_ablations_are_scored_once(spark):
    made = catalogue.QUERIES["ablation_intervals"](spark, SF)
    assert made.count() == 6 and not [f for f in made.inputFiles() if f.startswith(f"file://{SF}")]  # it reads what was stored
    plan = catalogue.QUERIES["item_scores"](spark, SF)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "Expand" not in plan
