"""Inputs of the catalogue's queries, derived from the tables, each in Spark and in SQL.

pairs: a gold number and a prediction at a known distance for every line item, with the axes of an experiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative distances of predictions; none lies on a tolerance.
DISTANCES = [0.0, 0.0005, -0.0005, 0.004, 0.008, 0.012, 0.05]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most that a row group of a Parquet file holds, as writers make them: a scan has a task per row group at best.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that may be read by fewer tasks than there are cores, because its row groups are few, dealt out evenly before costly expressions.

    Only tables of fewer bytes than one row group a core; larger ones are read in parallel as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("o_orderstatus") == "F", "clean").otherwise("standard")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), split.alias("split"))
    distance = F.element_at(F.array(*map(F.lit, DISTANCES)), (F.col("l_partkey") % len(DISTANCES) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate", "split",
        F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("model"), (F.col("l_linenumber") % 2).alias("seed"),
        F.col("l_extendedprice").alias("gold"), (F.col("l_extendedprice") * (F.lit(1.0) + distance)).alias("pred"),
    )


PAIRS = (
    "pairs AS (SELECT l.*, CASE WHEN o_orderstatus = 'F' THEN 'clean' ELSE 'standard' END AS split, l_returnflag AS arm, l_linestatus AS model, l_linenumber % 2 AS seed, "
    "l_extendedprice AS gold, l_extendedprice * (1::DOUBLE + ([0, 0.0005, -0.0005, 0.004, 0.008, 0.012, 0.05]::DOUBLE[])[l_partkey % 7 + 1]) AS pred "
    "FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"
)
#: The strict and the primary rule for two numbers, in SQL.
STRICT = "(abs({p} - {g}) <= greatest(1e-4::DOUBLE, 1e-3::DOUBLE * greatest(abs({g}), 1)))"
NEAR = "(abs({p} - {g}) <= greatest(1e-4::DOUBLE, 0.01::DOUBLE * abs({g})))"


def strict(p: str = "pred", g: str = "gold") -> str:
    return STRICT.format(p=p, g=g)


def primary(p: str = "pred", g: str = "gold") -> str:
    return f"({STRICT.format(p=p, g=g)} OR {NEAR.format(p=p, g=g)})"


def long(x):
    return x.cast("long")
