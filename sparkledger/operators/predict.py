"""Batch prediction with a pluggable model, and what surrounds it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import costs
from ..functions import numbers as N
from .sandbox import execute

#: A model: takes a list of prompts, gives a list of replies. Made once per worker by a factory.
Predictor = Callable[[list[str]], list[str]]


def echo_predictor() -> Predictor:
    """A deterministic stand-in: it answers with the last number of the prompt."""
    import re

    number = re.compile(r"-?\d+(?:\.\d+)?")
    return lambda prompts: [f"Answer: {(number.findall(p) or ['0'])[-1]}" for p in prompts]


def generate(examples: DataFrame, factory: Callable[[], Predictor], prompt: str = "prompt", batch_size: int = 8, samples: int = 1, few_shot: bool = False) -> DataFrame:
    """adds reply. Each Arrow batch is sorted by prompt length and cut into model batches, so that padding is small; row order is kept."""
    if samples > 1 or few_shot:
        raise NotImplementedError("self-consistency and few-shot inference are not defined")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            texts = pdf[prompt].fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
            replies: list[str] = [""] * len(texts)
            for a in range(0, len(order), batch_size):
                part = order[a : a + batch_size]
                for i, r in zip(part, model([texts[i] for i in part])):
                    replies[i] = r
            yield pdf.assign(reply=replies)

    return examples.mapInPandas(predict, f"{fields}, reply string")


def finish(replies: DataFrame, style: str) -> DataFrame:
    """adds pred, percent_form and, for programs, program and executed; an answer's value is its program's in style pot."""
    if style != "pot":
        return replies.withColumns({"pred": A.parse_answer(F.col("reply")), "percent_form": A.answer_is_percent(F.col("reply"))})
    ran = replies.withColumn("program", A.extract_program(F.col("reply"))).withColumn("executed", execute(F.col("program")))
    return ran.withColumns({"pred": F.struct("executed.num", "executed.text"), "percent_form": F.lit(False)})


def length_batches(examples: DataFrame, length: Column, size: int, *order: str) -> DataFrame:
    """Adds batch: consecutive numbers over the rows sorted by length, `size` rows each.

    Ranks come from counts per length and ranks inside a length, so no task sorts all rows."""
    rows = examples.withColumn("_len", length.cast("long"))
    counts = rows.groupBy("_len").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_len").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))  # distinct lengths only
    rank = F.row_number().over(Window.partitionBy("_len").orderBy(*order)) - 1
    return rows.join(before, "_len").withColumn("batch", F.floor((F.col("_before") + rank) / size).cast("long")).drop("_len", "_c", "_before")


def training_records(examples: DataFrame, tokens: Column, limit: int, supervision: str) -> DataFrame:
    """Examples that have a target and fit: with a program if programs are taught, and not over the limit (never cut)."""
    with_target = examples.where(F.col("gold_program").isNotNull()) if supervision == "pot_gold" else examples
    return with_target.where(tokens <= limit)


def training_counts(examples: DataFrame, tokens: Column, limit: int, supervision: str) -> DataFrame:
    """Kept and dropped examples and tokens of those kept."""
    fits = tokens <= limit
    target = F.col("gold_program").isNotNull() if supervision == "pot_gold" else F.lit(True)
    return examples.agg(F.count_if(target & fits).alias("kept"), F.count_if(target & ~fits).alias("too_long"), F.count_if(~target).alias("no_target"), F.coalesce(F.sum(F.when(target & fits, tokens)), F.lit(0)).alias("tokens"))


def run_compute(predictions: DataFrame, params: float) -> DataFrame:
    """Mean prompt and reply tokens and the operations of answering."""
    sizes = predictions.agg(F.avg("prompt_tokens").alias("prompt"), F.avg("gen_tokens").alias("generated"), F.count("*").alias("n"))
    return sizes.withColumn("infer_flops", costs.inference_flops(F.lit(params), F.col("prompt"), F.col("generated"), F.col("n"), F.lit(1)))
