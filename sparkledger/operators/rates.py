"""Rates over scored items, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N


def share(flag: Column) -> Column:
    """Mean of a flag; 0 over no rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def exact_match(pred: N.Answer, gold: N.Answer) -> Column:
    """A1."""
    return share(N.answers_match(pred, gold))


def primary_exact_match(pred: N.Answer, gold: N.Answer, percent_form: Column | None = None) -> Column:
    """A2."""
    return share(N.primary_match(pred, gold, percent_form))


def _has(answer: N.Answer) -> Column:
    return ~answer.missing


def execution_accuracy(value: N.Answer, gold: N.Answer) -> Column:
    """A3: share of items whose executed value matches strictly."""
    return share(_has(value) & N.answers_match(value, gold))


def primary_execution_accuracy(value: N.Answer, gold: N.Answer) -> Column:
    """A4."""
    return share(_has(value) & N.primary_match(value, gold))


def executability_rate(value: N.Answer) -> Column:
    """A5: share of items with an executed value."""
    return share(_has(value))


def faith_items(predictions: DataFrame, golds: DataFrame, grounding: DataFrame | None = None, key: str = "uid") -> DataFrame:
    """Key, correct, pred, exec_value, grounded: what faithfulness is measured on. A prediction is correct by the primary rule; grounded comes from agreement.grounded, null where nothing is known.

    predictions: key, pred, exec_value (structs of num and text), percent_form; golds: key, gold, and further columns, which stay. Predictions without a gold answer are left out."""
    both = predictions.join(golds, key)
    items = both.select(key, *(c for c in golds.columns if c not in (*predictions.columns, "gold")), N.primary_match(N.of("pred"), N.of("gold"), F.coalesce("percent_form", F.lit(False))).alias("correct"), "pred", "exec_value")
    if grounding is None:
        return items.withColumn("grounded", F.lit(None).cast("boolean"))
    return items.join(grounding.select(key, "grounded"), key, "left")


def program_faithfulness(correct: Column, value: N.Answer, pred: N.Answer, grounded: Column | None = None) -> Column:
    """Of the correct items, the share whose program gives the predicted answer and, if grounded is given, isn't known to be ungrounded. Null without correct items."""
    fits = _has(value) & N.answers_match(value, pred)
    if grounded is not None:
        fits = fits & F.coalesce(grounded, F.lit(True))
    return F.avg(F.when(correct, fits.cast("double")))


def proxy_agreement(value: N.Answer, pred: N.Answer) -> Column:
    """Share of items whose induced program agrees with the answer; null over no rows."""
    return F.avg((_has(value) & N.answers_match(value, pred)).cast("double"))


def average(x: Column, digits: int = 4) -> Column:
    """Rounded mean of what isn't null; null if nothing is."""
    return F.round(F.avg(x), digits)


def seed_sd(x: Column) -> Column:
    """Sample deviation over seeds; null for fewer than two."""
    return F.stddev_samp(x)


def scored(predictions: DataFrame, gold: DataFrame, key: str = "uid") -> DataFrame:
    """Predictions joined to their gold answers by id, with correct and correct_strict. pred and gold are answer structs."""
    both = predictions.join(gold, key)
    flag = F.col("percent_form") if "percent_form" in both.columns else None
    return both.withColumns({"correct": N.primary_match(N.of("pred"), N.of("gold"), flag), "correct_strict": N.answers_match(N.of("pred"), N.of("gold"))})


def item_scores(items: DataFrame, group: list[str], run: str = "exp_id", uid: str = "uid", correct: str = "correct", present: DataFrame | None = None) -> DataFrame:
    """Mean correctness of each item over the runs of a group; only items that all of its runs have.

    A run's last answer to an item counts; items must be unique per run before (see latest_per_key), so an item's rows are its runs.
    present: rows (group, run) with the same runs as the items, where they are cheaper to have. Runs are counted to a row per group, which is broadcast."""
    runs = (items if present is None else present).select(*group, run).distinct().groupBy(*group).agg(F.count(run).alias("_runs"))
    per_item = items.groupBy(*group, uid).agg(F.avg(F.col(correct).cast("double")).alias("score"), F.count(run).alias("_n"))
    return per_item.join(F.broadcast(runs), group).where(F.col("_n") == F.col("_runs")).select(*group, uid, "score")


def split_counts(items: DataFrame, *by: str, program: str = "gold_program") -> DataFrame:
    """Items and items with a verified program."""
    return items.groupBy(*by).agg(F.count("*").alias("n"), F.count(program).alias("n_verified"))


def unparsed(answer: N.Answer) -> Column:
    """Answers that weren't found."""
    return F.count_if(~_has(answer))
