"""Result tables from a log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .latest import latest_per_key
from .rates import average, item_scores, seed_sd
from .stats import bootstrap_difference, bootstrap_mean

KEY = ["dataset", "arm", "model", "variant"]
# The metrics of a run, in the order of the tables.
METRICS = ["exact_match", "exact_match_strict", "execution_accuracy", "faithfulness_primary", "faithfulness_proxy", "executability_rate"]


def current_runs(log: DataFrame, *also: Column) -> DataFrame:
    """W1 on an append log (exp_id, timestamp, ord): the latest row of each run, with further aggregates of its rows."""
    return latest_per_key(log, ["exp_id"], "timestamp", "ord", also=also)


def per_split(runs: DataFrame, metrics: list[str] = ("exact_match",), extra: list[str] = ()) -> DataFrame:
    """A row per key and split: seeds, first n_examples, rounded means of metrics and of extra columns, deviation over seeds."""
    means = [average(F.col(m)).alias(m) for m in [*metrics, *extra]]
    first = [F.min_by(c, "ord").alias(c) for c in ("n_examples", "model_size_b") if c in runs.columns]
    return runs.groupBy(*KEY, "split").agg(F.count("*").alias("n_seeds"), *first, *means, F.round(seed_sd(F.col("exact_match")), 4).alias("exact_match_seed_sd"))


def ablation(cells: DataFrame, splits: list[str] = ("standard", "clean"), metrics: list[str] = ("exact_match",)) -> DataFrame:
    """A row per key, a column per metric and split, and contamination_gap: the difference of the rounded means, rounded again."""
    values = [c for c in [*metrics, "exact_match_seed_sd", "n_examples", "n_seeds", "lo", "hi"] if c in cells.columns]
    names = {"n_examples": "n", "lo": "exact_match_lo", "hi": "exact_match_hi"}
    wide = cells.groupBy(*KEY).agg(*(F.max(F.when(F.col("split") == s, F.col(v))).alias(f"{names.get(v, v)}_{s}") for s in splits for v in values))
    return wide.withColumn("contamination_gap", F.round(F.col("exact_match_standard") - F.col("exact_match_clean"), 4))


def ablation_with_intervals(runs: DataFrame, items: DataFrame, metrics: list[str] = ("exact_match",), present: DataFrame | None = None) -> DataFrame:
    """The ablation table with bootstrap intervals per split and of the gap. items: exp_id, uid, correct; present: exp_id of the same runs, where that is cheaper to have.

    Items are scored once, and counted by score: all intervals are drawn from these counts, which are stored."""
    marked = lambda rows: rows.join(runs.select("exp_id", *KEY, "split"), "exp_id")
    answered = None if present is None else marked(present.select("exp_id").distinct())
    each = item_scores(marked(items), [*KEY, "split"], present=answered)
    scores = stored(each.groupBy(*KEY, "split", "score").agg(F.count("*").alias("items")), "scores")
    intervals = bootstrap_mean(scores, [*KEY, "split"], "score", weight="items").select(*KEY, "split", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))
    gaps = bootstrap_difference(scores, KEY, "split", ("standard", "clean"), "score", weight="items").select(*KEY, F.round("lo", 4).alias("contamination_gap_lo"), F.round("hi", 4).alias("contamination_gap_hi"))
    cells = per_split(runs, metrics).join(intervals, [*KEY, "split"], "left")
    return ablation(cells, metrics=metrics).join(gaps, KEY, "left").orderBy(*KEY)


def frontier(cells: DataFrame) -> DataFrame:
    """Compute, cost and accuracy of each key and split."""
    return cells.select(*KEY, "split", *(c for c in ("model_size_b", "train_flops", "infer_flops", "exact_match", "cost_usd") if c in cells.columns))


def gap_pairs(runs: DataFrame) -> DataFrame:
    """Clean runs with the standard run of the same arm, model and seed; of several standard runs the last (by ord)."""
    standard = latest_per_key(runs.where("split = 'standard'").select("arm", "model", "seed", "ord", F.col("exact_match").alias("standard")), ["arm", "model", "seed"], F.col("ord")).drop("ord")
    return runs.where("split = 'clean'").select("arm", "model", "seed", F.col("exact_match").alias("clean")).join(standard, ["arm", "model", "seed"]).withColumn("gap", F.col("standard") - F.col("clean"))


def focus(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """The latest run that has predictions."""
    return runs.join(predictions.select("exp_id").distinct(), "exp_id", "left_semi").orderBy(F.desc("timestamp"), F.desc("ord")).limit(1)


def with_side_tables(runs: DataFrame, train_stats: DataFrame) -> DataFrame:
    """Runs in order of time with their training statistics: the run's own `train`, else its side file's."""
    side = train_stats.select("exp_id", F.col("train").alias("_side"))
    return runs.join(side, "exp_id", "left").withColumn("train", F.coalesce("train", "_side")).drop("_side").orderBy("timestamp", "ord")


def latest_results(runs: DataFrame, n: int = 10) -> DataFrame:
    """The last n runs of the log, the newest first, with a line for each."""
    said = F.concat_ws("  ", "exp_id", "arm", "model", "split", F.concat(F.lit("EM "), F.coalesce(F.format_number("exact_match", 3), F.lit("-"))))
    return runs.orderBy(F.desc("ord")).limit(n).select("exp_id", "ord", said.alias("line"))
