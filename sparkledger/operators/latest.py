"""Versions, merges and set operations over keyed rows.

Rows that compete carry an explicit order: files have none in Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *newest: Column | str, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key, the last by `newest`; a missing timestamp is the oldest. An aggregate, so a key with many versions is combined before the shuffle.

    Whole rows are kept and sorted: columns that nobody needs should go before, and those of `newest` that are named are kept once. also: further aggregates of a key's rows."""
    names = [c for c in newest if isinstance(c, str)]
    order = [F.col(c) if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(newest)]
    rest = [c for c in df.columns if c not in [*keys, *names]]
    ordered = not any(kind in t for c, t in df.dtypes if c in rest for kind in ("map<", "variant"))
    if ordered:  # the rest only decides between rows of one place
        row = F.max(F.struct(*order, *rest))
    else:
        row = F.max_by(F.struct(*names, *rest), F.struct(*order))
    best = df.groupBy(*keys).agg(row.alias("_row"), *also)
    more = best.columns[len(keys) + 1 :]
    return best.select(*keys, *(F.col("_row").getField(c).alias(c) for c in [*names, *rest]), *more).select(*df.columns, *more)


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark limits each group before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def merge_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target, and the source rows whose key it doesn't have; duplicates inside the source stay."""
    return target.unionByName(source.join(target.select(key).distinct(), key, "left_anti").select(target.columns))


def restore(sources: list[DataFrame], keys: list[str], status: str = "status") -> DataFrame:
    """Union of the sources, the first that has a key wins; what was running when its machine ended has failed."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    merged = first_per_key(reduce(DataFrame.unionByName, tagged), keys, F.col("_priority")).drop("_priority")
    return interrupted(merged, status)


def interrupted(df: DataFrame, status: str = "status") -> DataFrame:
    """Running becomes failed."""
    return df.withColumn(status, F.when(F.col(status) == "running", F.lit("failed")).otherwise(F.col(status)))


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all parts, one per key, by part and then by the part's own order; adds `position`."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    once = first_per_key(reduce(DataFrame.unionByName, tagged), [key], F.col("_part"), F.col(order))
    return once.withColumn("position", F.struct("_part", order)).drop("_part")


def in_all(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in every group."""
    groups = df.select(group).distinct().count()
    return df.groupBy(key).agg(F.countDistinct(group).alias("_n")).where(F.col("_n") == groups).select(key)


def union_by_name(parts: list[DataFrame], lead: list[str] = ()) -> DataFrame:
    """Rows of different shapes; columns are `lead`, then the rest by name."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.select(*[c for c in lead if c in both.columns], *sorted(c for c in both.columns if c not in lead))


def overlay(df: DataFrame, over: dict[str, Column]) -> DataFrame:
    """Columns overridden where the overlay has a value."""
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.coalesce(v.cast(kinds[k]), F.col(k)) if k in kinds else v for k, v in over.items()})


def merge_maps(base: Column, over: Column) -> Column:
    """The union of two maps, the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """N rows without replacement: those with the least hashes of key and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows by an explicit order."""
    return df.orderBy(*order).limit(n)
