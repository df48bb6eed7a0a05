"""Frames of the report: breakdowns, histograms and headline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.answers import OUTCOMES, RULES
from ..functions.text import first_line, last_line
from .rates import share


def accuracy_by(items: DataFrame, label: Column, correct: Column | None = None) -> DataFrame:
    """Accuracy and size of each group; rows without a label don't count."""
    correct = F.col("correct") if correct is None else correct
    return items.withColumn("label", label).where("label is not null").groupBy("label").agg(share(correct).alias("accuracy"), F.count("*").alias("n"), F.count_if(correct).alias("hits"))


def accuracy_by_operation(items: DataFrame, ops: str = "ops") -> DataFrame:
    """An item counts once for each of its operations."""
    return accuracy_by(items.select("*", F.explode(ops).alias("_op")), F.col("_op"))


def outcome_counts(items: DataFrame, outcome: Column) -> DataFrame:
    """Items of each outcome that occurs, with the outcome's place in the fixed order."""
    order = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")).cast("int")
    return items.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).withColumn("ord", order)


def rule_ladder(items: DataFrame, rules: str = "rules") -> DataFrame:
    """A row per cumulative rule: items it accepts and their share."""
    sums = items.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"{rules}.{r}")).alias(r) for r in RULES))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r).alias("rule"), F.col(r).alias("hits")) for i, r in enumerate(RULES)))
    return sums.select("n", F.inline(rows)).select("ord", "rule", "hits", "n", F.coalesce(F.try_divide(F.col("hits"), F.col("n")), F.lit(0.0)).alias("share"))


def error_size_histogram(items: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """log10 of relative errors in 28 bins of a quarter from -4 to 3; what lies outside is in the outer bins. Golds of 0 and missing numbers don't count."""
    error = F.log10(F.greatest(F.abs(pred - gold) / F.abs(gold), F.lit(1e-300)))
    kept = items.where(pred.isNotNull() & gold.isNotNull() & (gold != 0)).select(F.greatest(F.least(error, F.lit(3.0)), F.lit(-4.0)).alias("e"))
    return kept.groupBy(F.least(F.floor((F.col("e") + 4) * 4), F.lit(27)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def length_histogram(items: DataFrame, length: str) -> DataFrame:
    """Reply lengths one by one if none is over 40, or else in 30 equal bins; empty for fewer than two replies."""
    kept = items.where(F.col(length).isNotNull()).select(F.col(length).cast("long").alias("v"))
    bounds = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all")).where("all >= 2")
    width = (F.col("hi") - F.col("lo")) / 30
    bin_ = F.when(F.col("hi") <= 40, F.col("v")).when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(29)))
    return kept.crossJoin(F.broadcast(bounds)).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def time_split(runs: DataFrame) -> DataFrame:
    """Seconds of loading, training, answering and the rest of a run; only positive parts. runs: exp_id, wall_s, model_s, train_s, infer_s."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    load = F.greatest(n("model_s") - n("train_s"), F.lit(0.0))
    other = F.greatest(n("wall_s") - load - n("train_s") - n("infer_s"), F.lit(0.0))
    parts = F.array(*(F.struct(F.lit(k).alias("part"), v.alias("seconds")) for k, v in (("load", load), ("train", n("train_s")), ("answer", n("infer_s")), ("other", other))))
    return runs.select("exp_id", F.inline(parts)).where("seconds > 0")


def length_buckets(items: DataFrame, length: str, by: str = "uid") -> DataFrame:
    """Adds bucket (0, 1, ...) by the distinct values at the places n/4, n/2 and 3n/4 of the sorted lengths, upper bounds included.

    Missing lengths are 0; if all are 0 there are no buckets. Ranks come from counts per distinct length, so no task sorts all rows."""
    v = F.coalesce(F.col(length), F.lit(0)).cast("long")
    counts = items.groupBy(v.alias("v")).agg(F.count("*").alias("c"))
    running = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # over distinct lengths: as many as the longest text has tokens
    table = counts.withColumns({"to": F.sum("c").over(running), "n": F.sum("c").over(Window.partitionBy())})
    places = F.array(*(F.least(F.floor(F.col("n") * f), F.col("n") - 1) for f in (0.25, 0.5, 0.75)))
    edges = table.where(F.exists(places, lambda p: (p < F.col("to")) & (p >= F.col("to") - F.col("c")))).agg(F.array_sort(F.collect_set("v")).alias("edges"))
    top = counts.agg(F.max("v").alias("top"))
    bucket = F.when(F.col("top") > 0, F.size(F.filter("edges", lambda e: e < v)))
    return items.crossJoin(F.broadcast(edges.crossJoin(top))).withColumn("bucket", bucket).drop("top")


def best_checkpoint(checks: DataFrame, *group: str) -> DataFrame:
    """The step with the highest dev_em, then faithfulness (missing: 0), then the earliest; without dev results the last step."""
    rank = F.struct(F.coalesce("dev_em", F.lit(float("-inf"))), F.when(F.col("dev_em").isNull(), F.lit(0.0)).otherwise(F.coalesce("faithfulness", F.lit(0.0))), F.when(F.col("dev_em").isNull(), F.col("step")).otherwise(-F.col("step")))
    return checks.groupBy(*group).agg(F.max_by("step", rank).alias("step"))


def scorecard(runs: DataFrame) -> DataFrame:
    """Headline numbers of runs: accuracy, questions, and questions a second of answering."""
    return runs.select("exp_id", "exact_match", "n_examples", F.try_divide(F.col("n_examples").cast("double"), F.col("infer_s")).alias("questions_per_s"))


def summary(items: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Items, hits, and the commonest miss (ties: the first by name)."""
    misses = items.where(F.col(outcome) != OUTCOMES[0]).groupBy(F.col(outcome).alias("o")).agg(F.count("*").alias("c")).agg(F.min_by("o", F.struct(-F.col("c"), F.col("o"))).alias("top_miss"), F.max("c").alias("top_miss_n"))
    return items.agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == OUTCOMES[0]).alias("hits")).crossJoin(F.broadcast(misses))


def enriched(predictions: DataFrame, examples: DataFrame, key: str = "uid") -> DataFrame:
    """Predictions with the features of their questions, where there are any."""
    return predictions.join(examples, key, "left")


def learning_curve(log: DataFrame, fields: list[str]) -> DataFrame:
    """Points of a training log with at least two numeric fields besides the step; the rest is cast or null."""
    cast = log.select(*(F.col(f).try_cast("double").alias(f) for f in fields))
    return cast.where(sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) > 2)


def session_verdict(states: DataFrame, since: Column) -> DataFrame:
    """P10: states touched since a time, with a text for each status and the last line of its error."""
    say = F.when(F.col("status") == "completed", "finished").when(F.col("status") == "pending", "waiting").when(F.col("status") == "running", "interrupted or running").otherwise(F.concat(F.lit("failed: "), last_line(F.col("last_error"))))
    return states.where(F.col("last_update") >= since).select("exp_id", "status", "last_update", say.alias("verdict"))


# What people are shown of a long text.
QUESTION_CHARS, REPLY_CHARS, ITEMS_SHOWN = 140, 60, 80


def shown_results(runs: DataFrame) -> DataFrame:
    """Each run's numbers as people read them; a missing one is a dash."""
    dash = lambda x: F.coalesce(x, F.lit("-"))
    ci = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.concat(N.percent_text(F.col("lo")), F.lit("-"), N.percent_text(F.col("hi"))))
    return runs.select(
        F.col("name").alias("experiment"), N.percent_text(F.col("exact_match")).alias("exact_match"), dash(ci).alias("ci"), N.percent_text(F.col("exact_match_strict")).alias("strict"), F.col("n_examples").cast("string").alias("n"),
        N.percent_text(F.col("execution_accuracy")).alias("exec_acc"), N.percent_text(F.col("faithfulness_primary")).alias("faithfulness"), dash(N.fixed(F.col("train_loss"), 3)).alias("train_loss"),
        dash(F.when(F.col("tokens_per_s") != 0, F.format_number("tokens_per_s", 0))).alias("tok_s"), N.minutes_text(F.col("wall_time_s")).alias("wall"), N.si(F.col("train_flops")).alias("train_flops"), N.si(F.col("infer_flops")).alias("infer_flops"),
        F.coalesce("git_commit", F.lit("")).alias("code"),
    )


def shown_items(items: DataFrame, by: list[str], *order: str, limit: int = ITEMS_SHOWN) -> DataFrame:
    """The first items of each group (a run) as people read them: number, question, gold, human answer, the reply's first line and the outcome."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = items.withColumn("no", place).where(F.col("no") <= limit)
    return first.select(
        *by, "no", F.substring(F.coalesce(F.nullif("question", F.lit("")), "uid", F.lit("")), 1, QUESTION_CHARS).alias("question"), F.coalesce("gold", F.lit("None")).alias("gold"), F.coalesce("answer_text", F.lit("")).alias("human_answer"),
        F.substring(first_line(F.col("reply")), 1, REPLY_CHARS).alias("reply"), "outcome",
    )
