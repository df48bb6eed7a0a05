"""What several answers and a report say of a program: votes of sampled answers, and whether a program's numbers stand in the table (§2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tolerance of the strict rule, relative beyond one and absolute below; and the width of a bin, which holds it.
REL, WIDTH = 1e-3, 1.01e-3
#: Numbers in a program that need no cell.
CONSTANTS = (100.0,)


def literals(program: Column) -> Column:
    """The numbers that a program names: digits with an optional fraction and exponent, not inside a name, a text or a comment."""
    bare = F.regexp_replace(program, r"\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?<![\w.])(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)(?![\w.])"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def _level(x: Column) -> Column:
    """A scale on which the tolerance has about one width everywhere: linear up to one, logarithmic beyond."""
    size = F.abs(x)
    return F.signum(x) * F.when(size <= 1, size).otherwise(1 + F.ln(F.greatest(size, F.lit(1.0))))


def band_join(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pairs of rows with equal `by` whose x lies within the tolerance of y: |x - y| <= 0.001 * max(|y|, 1).

    An equi-join on bins of a scale on which the tolerance has one width; y goes into its bin and the two beside it, so each pair meets once."""
    bin_of = lambda c: F.floor(_level(F.col(c)) / WIDTH)
    near = right.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: bin_of(y) + i)))
    met = left.withColumn("_bin", bin_of(x)).join(near, [*by, "_bin"]).drop("_bin")
    return met.where(F.abs(F.col(x) - F.col(y)) <= REL * F.greatest(F.abs(F.col(y)), F.lit(1.0)))


def grounded(programs: DataFrame, cells: DataFrame, key: str, program: str, number: str, constants: tuple = CONSTANTS) -> DataFrame:
    """key, named (numbers that the program names), found (those that a cell of the same key holds, within the tolerance), grounded (all of them; null without a program).

    Programs name numbers without sign, so cells are compared by magnitude. Constants by rule need no cell; a number that a program names twice counts once."""
    named = programs.select(key, F.explode_outer(F.array_distinct(F.filter(literals(F.col(program)), lambda x: ~x.isin(*constants)))).alias("_x"), F.col(program).isNotNull().alias("_has"))
    values = cells.select(key, F.abs(F.col(number).cast("double")).alias("_y")).dropna().distinct()
    held = band_join(named.where("_x is not null"), values, [key], "_x", "_y").select(key, "_x").distinct().withColumn("_held", F.lit(True))
    both = named.join(held, [key, "_x"], "left").groupBy(key).agg(F.count("_x").alias("named"), F.count("_held").alias("found"), F.max("_has").alias("_has"))
    return both.select(key, "named", "found", F.when(F.col("_has"), F.col("named") == F.col("found")).alias("grounded"))


def vote(answers: DataFrame, by: list[str], sample: str, num: str, text: str) -> DataFrame:
    """Self-consistency: of each question's sampled answers, the group with the most votes. by, n (answers given), votes, groups, num and text of the winner.

    Numbers that follow each other in order within the tolerance are one group; words are grouped as they are, trimmed and without case. Ties go to the group with the
    earliest sample, whose answer stands for it. Answers that are neither don't vote; a question without any has null. Equal answers are counted before they meet."""
    said = answers.select(*by, F.col(sample).alias("_at"), F.col(num).cast("double").alias("_num"), F.when(F.col(num).isNull(), F.lower(F.trim(F.col(text)))).alias("_text"))
    kinds = said.groupBy(*by, "_num", "_text").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.col("_num").asc_nulls_last(), F.col("_text").asc_nulls_last())
    before = F.lag("_num").over(order)
    near = F.col("_num").isNotNull() & before.isNotNull() & (F.col("_num") - before <= REL * F.greatest(F.abs(before), F.lit(1.0)))
    grouped = kinds.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(order))
    valid = F.col("_num").isNotNull() | F.col("_text").isNotNull()
    groups = grouped.groupBy(*by, "_group").agg(
        F.sum(F.when(valid, F.col("_n"))).alias("_votes"), F.min(F.when(valid, F.col("_first"))).alias("_first"), F.min_by(F.struct(F.col("_num").alias("num"), F.col("_text").alias("text")), "_first").alias("_said")
    )
    best = F.max(F.when(F.col("_votes").isNotNull(), F.struct("_votes", (-F.col("_first")).alias("_early"), "_said")))
    return groups.groupBy(*by).agg(F.coalesce(F.sum("_votes"), F.lit(0)).alias("n"), F.count("_votes").alias("groups"), best.alias("_b")).select(*by, "n", "groups", F.coalesce("_b._votes", F.lit(0)).alias("votes"), F.col("_b._said.num").alias("num"), F.col("_b._said.text").alias("text"))
