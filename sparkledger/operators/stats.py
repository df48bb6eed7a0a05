"""Resampling and tests.

A bootstrap draws items with replacement. All that a resample's mean depends on is how often each value was drawn, and these counts are multinomial. So items are
counted by value first (a partial aggregate, whatever the number of items), and resamples are drawn from the counts: the same distribution as drawing
items, with work that follows the number of different values. Values that are resampled together (systems on the same items) count as one value, a tuple.

Different values are cut into pieces of `PIECE`. How many draws fall into each piece is multinomial too, so a group of any number of values is spread over
tasks by piece and by block of resamples, and the sums of the pieces are added by Spark. Draws follow from the seed, the group and the place in it alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, ALPHA = 10_000, 0.05
#: Different values of a piece, and resamples of a block.
PIECE, BLOCK = 4096, 500


def _draws(key: tuple, seed: int, *place: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), *place])


def _count(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count("*")


def _mean(x: Column, weight: str | None) -> Column:
    x = x.cast("double")
    return F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight))) if weight else F.avg(x)


def resampled_means(items: DataFrame, group: list[str], values: list[str], n: int = RESAMPLES, seed: int = 0, weight: str | None = None) -> DataFrame:
    """group, resample, and the mean of each value in it: n rows for each group. Values of one row are resampled together; rows without one of them are left out.
    weight: how many items a row stands for; one without it.

    The groups' columns and resample are the result's key, so statistics of several groups are joins on `resample`."""
    kinds = dict(items.dtypes)
    items = items.select(*group, *(F.col(v).cast("double").alias(v) for v in values), *([weight] if weight else [])).dropna(subset=values)
    counts = items.groupBy(*group, *values).agg(_count(weight).alias("_n"))
    # Pieces by hash: their number follows the number of different values of the largest group.
    most = counts.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    pieces = -(-most // PIECE)
    counts = counts.withColumn("_piece", F.pmod(F.xxhash64(*values), F.lit(max(1, pieces))))
    keys = "".join(f"`{g}` {kinds[g]}, " for g in group)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-n // BLOCK) - 1)))
    schema = f"{keys}_block int, _total long, _sums array<array<double>>"

    def shares(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """How many draws of each resample of a block fall into each piece of a group."""
        pdf = pdf.sort_values("_piece")
        block, total = int(key[-1]), int(pdf["_items"].sum())
        of = _draws(key[:-1], seed, block).multinomial(total, pdf["_items"].to_numpy(float) / total, min(BLOCK, n - block * BLOCK))
        return pd.DataFrame({**dict(zip(group, key)), "_block": block, "_piece": pdf["_piece"].to_numpy(), "_total": total, "_drawn": list(of.T)})

    def sums(key: tuple, pdf: pd.DataFrame, drawn: list[tuple]) -> pd.DataFrame:
        """Sums of the values that a piece's draws have, by resample."""
        pdf = pdf.sort_values(values)
        p, v = pdf["_n"].to_numpy(float), pdf[values].to_numpy(float)
        each = lambda block, of: (_draws((*key, 0), seed, block, 1).multinomial(of, p / p.sum()) @ v).T.tolist()
        return pd.DataFrame([[*key[: len(group)], block, total, each(block, of)] for block, total, of in drawn], columns=[*group, "_block", "_total", "_sums"])

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, total = int(key[-1]), int(pdf["_n"].sum())
        return sums(key[:-1], pdf, [(block, total, np.full(min(BLOCK, n - block * BLOCK), total))])

    def piece(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return sums(key, left, [(int(b), int(t), np.asarray(of, np.int64)) for b, t, of in zip(right["_block"], right["_total"], right["_drawn"])])

    if pieces <= 1:  # no group is cut: its draws all fall into one piece
        each = counts.drop("_piece").select("*", blocks.alias("_block")).groupBy(*group, "_block").applyInPandas(whole, schema)
    else:
        sizes = counts.groupBy(*group, "_piece").agg(F.sum("_n").alias("_items")).select("*", blocks.alias("_block"))
        drawn = sizes.groupBy(*group, "_block").applyInPandas(shares, f"{keys}_block int, _piece long, _total long, _drawn array<long>")
        each = counts.groupBy(*group, "_piece").cogroup(drawn.groupBy(*group, "_piece")).applyInPandas(piece, schema)
    one = each.select(*group, "_block", "_total", F.posexplode(F.arrays_zip(*(F.col("_sums")[i].alias(f"s{i}") for i in range(len(values))))).alias("_at", "_s"))
    place, sums_of = (F.col("_block") * BLOCK + F.col("_at")).alias("resample"), [F.col(f"_s.s{i}") for i in range(len(values))]
    if pieces <= 1:
        return one.select(*group, place, *((x / F.col("_total")).alias(v) for v, x in zip(values, sums_of)))
    return one.groupBy(*group, place).agg(*((F.sum(x) / F.max("_total")).alias(v) for v, x in zip(values, sums_of)))


def interval(means: DataFrame, group: list[str], statistic: Column, alpha: float = ALPHA) -> DataFrame:
    """lo and hi of a statistic of resampled means: its quantiles over the resamples, interpolated."""
    return means.groupBy(*group).agg(F.percentile(statistic, [alpha / 2, 1 - alpha / 2]).alias("_q")).select(*group, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def bootstrap_mean(items: DataFrame, group: list[str], value: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0, weight: str | None = None) -> DataFrame:
    """N, mean, lo and hi of a value in each group. weight: how many items a row stands for."""
    exact = items.dropna(subset=[value]).groupBy(*group).agg(_count(weight).alias("n"), _mean(F.col(value), weight).alias("mean"))
    return _joined(exact, interval(resampled_means(items, group, [value], n, seed, weight), group, F.col(value), alpha), group)


def _joined(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return a.join(b, group) if group else a.crossJoin(b)


def bootstrap_difference(items: DataFrame, group: list[str], side: str, sides: tuple, value: str, paired_by: str | None = None, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0, weight: str | None = None) -> DataFrame:
    """Difference of two sides in each group that has both. paired_by: the same items in both sides are resampled together; an item that one side lacks is an error.
    weight: how many items a row stands for, where items aren't paired."""
    a, b = sides
    if paired_by and weight:
        raise ValueError("paired items have no weights")
    if paired_by:
        pick = lambda s: F.max(F.when(F.col(side) == s, F.col(value).cast("double")))
        both = items.where(F.col(side).isin(a, b)).groupBy(*group, paired_by).agg(pick(a).alias("_a"), pick(b).alias("_b"))
        odd = F.raise_error(F.lit("paired samples differ in their items"))
        both = both.withColumn("_a", F.when(F.col("_a").isNull() | F.col("_b").isNull(), odd).otherwise(F.col("_a")))
        exact = both.groupBy(*group).agg((F.avg("_a") - F.avg("_b")).alias("difference"))
        return _joined(exact, interval(resampled_means(both, group, ["_a", "_b"], n, seed), group, F.col("_a") - F.col("_b"), alpha), group)
    rows = items.where(F.col(side).isin(a, b)).dropna(subset=[value])
    exact = rows.groupBy(*group).agg((_mean(F.when(F.col(side) == a, F.col(value)), weight) - _mean(F.when(F.col(side) == b, F.col(value)), weight)).alias("difference")).where("difference is not null")
    means = resampled_means(rows, [*group, side], [value], n, seed, weight)
    wide = means.groupBy(*group, "resample").agg(*(F.max(F.when(F.col(side) == s, F.col(value))).alias(c) for s, c in ((a, "_a"), (b, "_b")))).where("_a is not null and _b is not null")
    return _joined(exact, interval(wide, group, F.col("_a") - F.col("_b"), alpha), group)


def gap_comparison(items: DataFrame, group: list[str], system: str, systems: tuple, split: str, value: str, item: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """Difference of two systems' gaps (standard less clean), and each system's gap in two parts: style (standard less control) and recency (control less clean).

    Items are resampled within each split, and both systems by the same draws on the same items, so items that only one system has are left out.
    group, measure, value, lo, hi; measures that lack a split are null."""
    a, b = systems
    pick = lambda s: F.max(F.when(F.col(system) == s, F.col(value).cast("double")))
    cells = items.where(F.col(system).isin(a, b)).groupBy(*group, split, item).agg(pick(a).alias("_a"), pick(b).alias("_b")).where("_a is not null and _b is not null")
    splits = ("standard", "control", "clean")

    def wide(rows: DataFrame, by: list[str], mean: Callable) -> DataFrame:
        cell = [mean(F.when(F.col(split) == s, F.col(c))).alias(f"_{s}{c}") for s in splits for c in ("_a", "_b")]
        return rows.groupBy(*by).agg(*cell)

    gap = lambda x, y, c: F.col(f"_{x}{c}") - F.col(f"_{y}{c}")
    measures = {"gap_difference": gap("standard", "clean", "_a") - gap("standard", "clean", "_b")}
    for name, c in (("first", "_a"), ("second", "_b")):
        measures |= {f"gap_{name}": gap("standard", "clean", c), f"style_{name}": gap("standard", "control", c), f"recency_{name}": gap("control", "clean", c)}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()))).alias("m")
    flat = lambda df: df.select(*group, rows).select(*group, "m.*")
    exact = flat(wide(cells, group, F.avg))
    drawn = flat(wide(resampled_means(cells, [*group, split], ["_a", "_b"], n, seed), [*group, "resample"], F.max))
    return exact.join(interval(drawn, [*group, "measure"], F.col("value"), alpha), [*group, "measure"])


def log_choose_sums(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of the probability that n fair coins show at most k heads (k at most n / 2): terms that matter are those next to k, as each is smaller than the next by a factor."""
    out = np.zeros(len(k))
    for i, (a, m) in enumerate(zip(k.tolist(), n.tolist())):
        top = lgamma(m + 1) - lgamma(a + 1) - lgamma(m - a + 1) - m * np.log(2)
        total, term, j = 1.0, 1.0, a
        while j > 0 and term > 1e-18 * total:
            term *= j / (m - j + 1)
            total += term
            j -= 1
        out[i] = top + np.log(total)
    return out


def binomial_two_sided(k: int, n: int) -> float:
    """Probability of a split of n fair coins at least as uneven as k to n - k, both ways."""
    return float(min(1.0, 2 * np.exp(log_choose_sums(np.array([min(k, n - k)]), np.array([n]))[0]))) if n else 1.0


def _p_value(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(min(x, y)), int(x + y)) for x, y in zip(a, b)])


def mcnemar(pairs: DataFrame, a: Column, b: Column, *group: str) -> DataFrame:
    """Items that only one side has right, and the exact two-sided p value. The rows are the pairs: both flags of an item."""
    counts = pairs.groupBy(*group).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))
    return counts.withColumn("p", F.pandas_udf(_p_value, "double")("only_a", "only_b"))


def holm(tests: DataFrame, p: str, *family: str, order: str | None = None) -> DataFrame:
    """Adds p_holm: step-down adjusted p values in each family of tests; ties in input order (`order`)."""
    by = [F.col(p), *([F.col(order)] if order else [])]
    ranked = Window.partitionBy(*family).orderBy(*by)
    step = (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(ranked) + 1) * F.col(p)
    return tests.withColumn("_step", F.least(F.lit(1.0), step)).withColumn("p_holm", F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
