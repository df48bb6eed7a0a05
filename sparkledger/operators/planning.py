"""Experiment plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import costs
from .latest import first_per_key, ordered_union

# Arms that train a model, and the run order of priorities.
TRAINED_ARMS = ["A5", "A6", "A7", "A8"]
PRIORITIES = {"M": 0, "S": 1, "C": 2, "": 3}
SIZE_LIMIT_B = 34.0


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values, in nested-loop order (`ord`). The axes come from a plan file: one row, exploded."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("ord"))
    for name, values in axes.items():
        df = df.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("_i", name)).withColumn("ord", F.col("ord") * len(values) + F.col("_i")).drop("_i")
    return df


def grid_of(axes: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """As grid, with axes from tables: name -> (table, column to order by); each axis is the table's distinct values of the column `name`.

    An axis is one row (its values as an array) that the combinations so far are joined with, so the product is written out where it is used, in as many tasks as it has rows for."""
    out = None
    for name, (df, order) in axes.items():
        values = df.groupBy(name).agg(F.min(order).alias("_o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(name).alias("v")))), lambda x: x["v"]).alias("_values"))
        row = values if out is None else out.repartition("ord").crossJoin(F.broadcast(values))
        place = F.lit(0).cast("long") if out is None else F.col("ord") * F.size("_values")
        kept = [] if out is None else [c for c in out.columns if c != "ord"]
        out = row.select(*kept, place.alias("_p"), F.posexplode("_values").alias("_i", name)).withColumn("ord", F.col("_p") + F.col("_i")).drop("_p", "_i")
    return out


def priorities(levels: DataFrame) -> DataFrame:
    """Arm -> priority, from rows of a level and its arms."""
    return levels.select(F.explode("arms").alias("arm"), F.col("level").alias("priority"))


def compatible(combos: DataFrame, arms: DataFrame, models: DataFrame, phase: int = 1, priority: DataFrame | None = None) -> DataFrame:
    """Combinations whose arm fits the model's tier (both default to student), without second-phase models in phase 1 and without further seeds of arms that don't train."""
    out = combos.join(arms, "arm", "left").join(models, "model", "left")  # short tables by nature; Spark broadcasts them if they are
    out = out.where(F.coalesce("role", F.lit("student")) == F.coalesce("tier", F.lit("student")))
    if phase == 1:
        out = out.where(~F.coalesce("phase2_only", F.lit(False)))
    out = out.where(F.col("arm").isin(TRAINED_ARMS) | (F.coalesce("seed", F.lit(0)) == 0))
    if priority is not None:
        out = out.join(F.broadcast(priority), "arm", "left")
    return out.withColumn("priority", F.coalesce("priority", F.lit(""))) if priority is not None else out


def run_order(configs: DataFrame, block: int = 1 << 16) -> DataFrame:
    """One row per experiment_id (the first), with position by priority, seed and first place.

    Rows are numbered inside blocks of a priority, a seed and a range of places, and blocks by their counts, so no task orders a whole plan."""
    once = first_per_key(configs, ["experiment_id"], F.col("ord"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITIES.items() for x in kv)), F.col("priority")), F.lit(3))
    keys = ["_rank", "_seed", "_block"]
    rows = once.withColumns({"_rank": rank, "_seed": F.coalesce(F.col("seed").cast("long"), F.lit(-(1 << 62))), "_block": F.floor(F.col("ord") / block)})
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ahead = counts.select(*keys, (F.sum("_n").over(Window.orderBy(*keys)) - F.col("_n")).alias("_ahead"))  # a row for each block
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1
    return rows.withColumn("_i", inside).join(ahead, keys).withColumn("position", (F.col("_ahead") + F.col("_i")).cast("int")).drop(*keys, "_i", "_ahead")


def union_suites(suites: list[DataFrame]) -> DataFrame:
    """The experiments of several suites, each once, in the suites' order."""
    return ordered_union(suites, "experiment_id", "ord")


def select_plan(configs: DataFrame, priority: str | None = None, **equals: object) -> DataFrame:
    """Equality filters, and those priorities that are part of the given text; no priority never passes."""
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equals.items() if v is not None), configs)
    return out.where((F.col("priority") != "") & F.contains(F.lit(priority), F.col("priority"))) if priority else out


def preflight(configs: DataFrame, available: DataFrame, splits: Column) -> DataFrame:
    """Configs with `missing`: their required splits (an array) that aren't available."""
    needed = configs.select("experiment_id", "dataset", F.explode(splits).alias("split"))
    lacking = needed.join(available.select("dataset", "split"), ["dataset", "split"], "left_anti").groupBy("experiment_id").agg(F.array_sort(F.collect_set("split")).alias("missing"))
    return configs.join(lacking, "experiment_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def allowed_in_phase(phase: Column, size_b: Column, phase2_only: Column) -> Column:
    """In phase 1 neither second-phase models nor models over 34 billion parameters."""
    return ~((phase == 1) & (F.coalesce(phase2_only, F.lit(False)) | (F.coalesce(size_b, F.lit(0.0)) > SIZE_LIMIT_B)))


def plan_text(arm: Column, model: Column, dataset: Column, split: Column) -> Column:
    """A line that says what an experiment does."""
    act = F.when(arm.isin(TRAINED_ARMS), "train an adapter on ").otherwise("prompt without training on ")
    return F.concat(F.lit("["), arm, F.lit("] "), model, F.lit(": "), act, dataset, F.lit(", evaluate on "), split)


def untrained(configs: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """The first experiment of each adapter that has still to be trained."""
    todo = first_per_key(configs.where(F.col("arm").isin(TRAINED_ARMS)), ["training_id"], F.col("ord"))
    return todo.join(trained.select("training_id"), "training_id", "left_anti") if trained is not None else todo


def estimate(configs: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """One row of hours: adapters are trained once, evaluations counted each. Speeds and sizes are columns of configs (see costs)."""
    answers = F.coalesce("answers_per_s", F.lit(costs.ANSWER_SPEED)) * F.when(F.col("inference") == "fewshot", F.lit(costs.FEW_SHOT)).otherwise(F.lit(1.0))
    hours = costs.train_hours(F.col("tokens_per_question"), F.coalesce("train_examples", "train_questions"), F.col("epochs"), F.col("train_tokens_per_s"), F.col("selection_checks"), F.col("dev_examples"), answers)
    train = untrained(configs, trained).agg(F.coalesce(F.sum(hours), F.lit(0.0)).alias("t"), F.count("*").alias("adapters"))
    answer = configs.agg(F.coalesce(F.sum(costs.eval_hours(F.coalesce("eval_examples", "eval_items"), F.col("answers_per_s"), F.col("inference") == "fewshot")), F.lit(0.0)).alias("e"), F.count("*").alias("evaluations"))
    return train.crossJoin(answer).select(F.round(F.col("t") + F.col("e"), 1).alias("total"), F.round("t", 1).alias("train"), F.round("e", 1).alias("eval"), "adapters", "evaluations")


def decide(configs: DataFrame, decisions: DataFrame, ready: DataFrame) -> DataFrame:
    """Configs with run and reason: the registry's decision, unless required splits are missing."""
    both = configs.join(decisions, "experiment_id", "left").join(ready.select("experiment_id", "missing"), "experiment_id", "left")
    lacks = F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0
    run = F.coalesce("run", F.lit(True))
    return both.withColumns({"reason": F.when(run & lacks, F.concat(F.lit("missing data: "), F.array_join("missing", ", "))).otherwise(F.coalesce("reason", F.lit("new"))), "run": run & ~lacks})


def within_budget(plan: DataFrame, need: str, order: str, budget: str, *by: str, block: int = 4096) -> DataFrame:
    """Adds `before` (what the runs ahead of a run need) and `starts`: whether the session's time is enough for it and all runs ahead. What doesn't start waits, without using an attempt.

    need: a run's seconds; order: its place in the plan, from 0 without gaps; budget: the session's seconds (null: no limit); by: the session.
    The running sum is taken in blocks of the plan, then over the blocks' sums, so that no task sorts a whole plan."""
    blocks = plan.withColumn("_block", F.floor(F.col(order) / block))
    sums = blocks.groupBy(*by, "_block").agg(F.sum(need).alias("_sum"))
    ahead = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum(need).over(Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = blocks.join(ahead, [*by, "_block"]).withColumn("before", F.col("_ahead") + inside)
    return found.withColumn("starts", F.col(budget).isNull() | (F.col("before") + F.col(need) <= F.col(budget))).drop("_block", "_ahead")
