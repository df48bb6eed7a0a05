"""Compute, time and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the planning formulas take where a table has no entry.
TOKENS, QUESTIONS, TRAIN_SPEED, ANSWER_SPEED, FEW_SHOT, LOAD_HOURS = 1100.0, 6000.0, 100.0, 0.1, 0.35, 0.03


def training_flops(params: Column, tokens: Column, lora: Column, recompute: Column) -> Column:
    """M1: 6 (or 4 with adapters) operations a parameter and token, a third more with recomputation."""
    return F.when(lora, F.lit(4.0)).otherwise(F.lit(6.0)) * params * tokens * F.when(recompute, F.lit(1.33)).otherwise(F.lit(1.0))


def inference_flops(params: Column, prompt: Column, generated: Column, questions: Column, samples: Column) -> Column:
    """M2: the prompt once for each question, the reply for each of its samples."""
    return F.lit(2.0) * params * prompt * questions + F.lit(2.0) * params * generated * questions * samples


def train_hours(tokens: Column, questions: Column, epochs: Column, speed: Column, checks: Column, dev_items: Column, answers: Column, load: Column | None = None) -> Column:
    """M3: hours of training, of answering the dev slice at each check, and of loading the model; missing entries take their defaults."""
    learn = F.coalesce(tokens, F.lit(TOKENS)) * F.coalesce(questions, F.lit(QUESTIONS)) * epochs / F.coalesce(speed, F.lit(TRAIN_SPEED)) / 3600
    return learn + checks * dev_items / answers / 3600 + (F.lit(LOAD_HOURS) if load is None else load)


def eval_hours(items: Column, speed: Column, few_shot: Column, load: Column | None = None) -> Column:
    """M3: hours of answering, and of loading the model."""
    rate = F.coalesce(speed, F.lit(ANSWER_SPEED)) * F.when(few_shot, F.lit(FEW_SHOT)).otherwise(F.lit(1.0))
    return F.coalesce(items, F.lit(1000)) / rate / 3600 + (F.lit(LOAD_HOURS) if load is None else load)


def answer_speed(by_style: Column, style: Column) -> Column:
    """Questions a second of a model in a style: its own entry, the answer style's, or the default. by_style: map<string, double>."""
    return F.coalesce(F.try_element_at(by_style, style), F.try_element_at(by_style, F.lit("answer")), F.lit(ANSWER_SPEED))


def selection_steps(total: Column, checks: Column) -> Column:
    """Evenly spaced steps, the last one included; empty without steps or checks."""
    some = (total > 0) & (checks > 0)
    gap = F.ceil(total / F.greatest(checks, F.lit(1)))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(checks, F.lit(1)).cast("int")), lambda k: F.least(k * gap, total.cast("long")))
    return F.when(some, F.array_sort(F.array_distinct(steps))).otherwise(F.array().cast("array<bigint>"))


def with_gpu_price(runs: DataFrame, prices: DataFrame, gpu: str = "gpu") -> DataFrame:
    """Adds usd_per_gpu_hour: of the first price (by ord) whose key is part of the GPU's name; null if that one isn't priced.

    prices (gpu_key, usd_per_gpu_hour, ord) is a price list: gathered into one array and broadcast, so runs aren't shuffled."""
    listed = prices.agg(F.array_sort(F.collect_list(F.struct("ord", F.lower("gpu_key").alias("key"), F.col("usd_per_gpu_hour").alias("usd")))).alias("_prices"))
    name = F.lower(F.col(gpu))
    first = F.try_element_at(F.filter("_prices", lambda p: F.contains(name, p["key"])), F.lit(1))
    return runs.crossJoin(F.broadcast(listed)).withColumn("usd_per_gpu_hour", first["usd"]).drop("_prices")


def run_cost(price: Column, gpus: Column, train_s: Column, eval_s: Column) -> Column:
    """Struct of total, train and eval dollars to 4 decimals; null without a price or GPU times. No or zero GPUs count as one."""
    n = F.when(F.coalesce(gpus, F.lit(0)) == 0, F.lit(1)).otherwise(gpus)
    usd = lambda s: F.round(price * n * F.coalesce(s, F.lit(0.0)) / 3600, 4)
    known = price.isNotNull() & (train_s.isNotNull() | eval_s.isNotNull())
    both = F.coalesce(train_s, F.lit(0.0)) + F.coalesce(eval_s, F.lit(0.0))
    return F.when(known, F.struct(usd(both).alias("total_usd"), usd(train_s).alias("train_usd"), usd(eval_s).alias("eval_usd")))
