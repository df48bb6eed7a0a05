"""Queries over the smaller helpers: numbers and texts of answers, run tables, plans and resampling of known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import tables
from ..functions.answers import OUTCOMES
from ..functions.text import first_line, last_line
from ..operators import ablation as AB
from ..operators import breakdown as B
from ..operators import latest as L
from ..operators import planning as P
from ..operators import rates as R
from ..operators import stats
from ..sources import sinks
from .base import NEAR, PAIRS, pairs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {PAIRS} SELECT split, count(*) AS n, count(*) FILTER (WHERE {NEAR.format(p='pred', g='gold')}) AS near, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS two_decimals, CAST(0 AS BIGINT) AS missing FROM pairs GROUP BY 1")
def near_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness within 1 %, false for missing numbers; and equality to two decimals, which the strict rule doesn't accept."""
    gold, off = F.col("l_discount"), F.when(F.col("l_linenumber") % 2 == 0, 0.004).otherwise(0.006)
    equal = N.gold_matches(N.number(gold + off), N.number(gold), True) & ~N.gold_matches(N.number(gold + off), N.number(gold))
    return pairs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if(N.within(F.col("pred"), F.col("gold"))).alias("near"), F.count_if(equal).alias("two_decimals"), F.count_if(N.within(F.lit(None).cast("double"), F.col("gold"))).alias("missing"))


@query(
    "SELECT l_partkey % 6 AS form, count(*) AS n, round(sum(CASE l_partkey % 6 WHEN 0 THEN 1000 + q WHEN 1 THEN q / 100 WHEN 2 THEN q WHEN 3 THEN -1 WHEN 4 THEN -q END)::DOUBLE, 2) AS argument, "
    "round(sum(CASE l_partkey % 6 WHEN 0 THEN 1000 + q WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN 1 WHEN 4 THEN -q WHEN 5 THEN q END)::DOUBLE, 2) AS cell FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1"
)
def argument_and_cell_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six written forms, as arguments of programs and as cells of tables."""
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("1,"), F.lpad(q, 3, "0"))).when(k == 1, F.concat(q, F.lit("%"))).when(k == 2, F.concat(F.lit("const_"), q)).when(k == 3, F.lit("const_m1")).when(k == 4, F.concat(F.lit("-"), q)).otherwise(F.concat(F.lit("$ ("), q, F.lit(") x")))
    rows = table(spark, sf_dir, "lineitem").select(k.alias("form"), N.argument_number(text).alias("a"), N.cell_number(text).alias("c"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.round(F.sum("a"), 2).alias("argument"), F.round(F.sum("c"), 2).alias("cell"))


@query(
    "SELECT CASE WHEN q % 2 = 0 THEN '(-' || q || ')' ELSE q::VARCHAR END AS literal, CASE WHEN q % 5 = 0 THEN '-' ELSE q || '.00 M' END AS si, q || '.0%' AS percent, CASE WHEN q < 20 THEN q || ' s' ELSE q || '.0 min' END AS minutes, count(*) AS n "
    "FROM (SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ALL"
)
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals, and numbers as people read them."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        N.literal(F.when(q.cast("long") % 2 == 0, -q).otherwise(q)).alias("literal"), N.si(F.when(q.cast("long") % 5 > 0, q * 1e6)).alias("si"), N.percent_text(q / 100).alias("percent"), N.minutes_text(F.when(q < 20, q).otherwise(q * 60)).alias("minutes")
    )
    return rows.groupBy("literal", "si", "percent", "minutes").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS answer, '```python' || chr(10) || 'answer = ' || o_orderkey || chr(10) || '```' AS program, 'ValueError: ' || o_orderpriority AS last, 'Traceback' AS first, count(*) AS n FROM orders GROUP BY ALL"
)
def targets_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training targets of both kinds; the first and the last line of an error."""
    key = F.col("o_orderkey")
    answer = N.either(F.when(key % 2 == 0, key), F.col("o_orderstatus")).struct()
    error = F.concat(F.lit(" Traceback \n  in line 1\nValueError: "), F.col("o_orderpriority"), F.lit("\n"))
    program = F.concat(F.lit("answer = "), key.cast("string"))
    rows = table(spark, sf_dir, "orders").select(tables.format_target(answer, program, "answer").alias("answer"), tables.format_target(answer, program, "pot_gold").alias("program"), last_line(error).alias("last"), first_line(error).alias("first"))
    return rows.groupBy("answer", "program", "last", "first").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(avg(l_quantity), 4) AS mean, CAST(NULL AS DOUBLE) AS none, count(*) FILTER (WHERE o_orderkey IS NULL) AS without, count(*) FILTER (WHERE l_linenumber = 4) AS unparsed FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) ON l_orderkey = o_orderkey GROUP BY 1")
def enriched_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the features of their questions, where there are any; means of what isn't null; answers that weren't found."""
    features = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("known"))
    items = B.enriched(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "uid"), features)
    found = N.number(F.when(F.col("l_linenumber") != 4, F.col("l_quantity")))
    return items.groupBy("status").agg(F.count("*").alias("n"), R.average(F.col("l_quantity")).alias("mean"), R.average(F.lit(None).cast("double")).alias("none"), F.count_if(F.col("known").isNull()).alias("without"), R.unparsed(found).alias("unparsed"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, the key as time."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("exp_id"), F.col("c_mktsegment").alias("arm"), F.lit("m").alias("model"), F.lit("clean").alias("split"), F.col("c_custkey").cast("double").alias("timestamp"), F.col("c_custkey").alias("ord"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit(0.5)).alias("exact_match"), F.col("c_nationkey").cast("int").alias("n_examples"), (F.col("c_custkey") % 4).cast("double").alias("infer_s"), F.when(F.col("c_custkey") % 3 == 0, F.lit("own")).alias("train"),
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS exp_id, concat_ws('  ', c_custkey, c_mktsegment, 'm', 'clean', CASE WHEN c_custkey % 2 = 0 THEN 'EM 0.500' ELSE 'EM -' END) AS line FROM customer ORDER BY c_custkey DESC LIMIT 10")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten runs of the log, each with a line."""
    return AB.latest_results(_runs(spark, sf_dir), 10).select("exp_id", "line")


@query("SELECT CAST(max(c_custkey) AS VARCHAR) AS exp_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 7 = 0")
def focus_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run that has predictions."""
    predictions = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").cast("string").alias("exp_id"))
    return AB.focus(_runs(spark, sf_dir), predictions).select("exp_id")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 3 = 1 THEN 'side' END AS train, count(*) AS n FROM customer GROUP BY 1")
def runs_with_side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their own training statistics, else those of their side file, else none."""
    side = table(spark, sf_dir, "customer").where("c_custkey % 3 < 2").select(F.col("c_custkey").cast("string").alias("exp_id"), F.lit("side").alias("train"))
    return AB.with_side_tables(_runs(spark, sf_dir), side).groupBy("train").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS exp_id, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE END AS exact_match, CAST(c_nationkey AS INT) AS n_examples, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey / (c_custkey % 4)::DOUBLE END AS questions_per_s FROM customer")
def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline numbers of each run; no rate without seconds."""
    return B.scorecard(_runs(spark, sf_dir))


@query(
    "WITH o AS (SELECT CASE l_linenumber WHEN 1 THEN 'Correct' WHEN 2 THEN 'Wrong number' ELSE 'No answer found' END AS o FROM lineitem) "
    "SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM o WHERE o = 'Correct') AS hits, o AS top_miss, count(*) AS top_miss_n FROM o WHERE o <> 'Correct' GROUP BY o ORDER BY count(*) DESC, o LIMIT 1"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, hits and the commonest miss."""
    k = F.col("l_linenumber")
    return B.summary(table(spark, sf_dir, "lineitem").select(F.when(k == 1, OUTCOMES[0]).when(k == 2, OUTCOMES[7]).otherwise(OUTCOMES[9]).alias("outcome")))


@query("SELECT CAST(l_orderkey AS DOUBLE) AS step, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS loss, l_discount AS rate, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS norm FROM lineitem WHERE (l_linenumber % 2 = 0)::INT + 1 + (l_linenumber % 3 = 0)::INT >= 2")
def learning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a log of texts with two numbers at least besides the step."""
    n = F.col("l_linenumber")
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("step"), F.when(n % 2 == 0, F.col("l_tax").cast("string")).otherwise("nan?").alias("loss"), F.col("l_discount").cast("string").alias("rate"), F.when(n % 3 == 0, F.col("l_quantity").cast("string")).alias("norm"))
    return B.learning_curve(log, ["step", "loss", "rate", "norm"])


@query(
    "SELECT n_nationkey AS size_b, NOT (n_nationkey % 2 = 0 AND (n_nationkey % 3 = 0 OR n_nationkey * 2 > 34)) AS allowed, "
    "'[' || CASE WHEN n_regionkey = 0 THEN 'A1' ELSE 'A5' END || '] ' || n_name || ': ' || CASE WHEN n_regionkey = 0 THEN 'prompt without training on ' ELSE 'train an adapter on ' END || 'finqa, evaluate on clean' AS line FROM nation"
)
def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each experiment does, and whether its phase allows it."""
    k = F.col("n_nationkey")
    phase = F.when(k % 2 == 0, 1).otherwise(2)
    arm = F.when(F.col("n_regionkey") == 0, "A1").otherwise("A5")
    return table(spark, sf_dir, "nation").select(k.alias("size_b"), P.allowed_in_phase(phase, (k * 2).cast("double"), k % 3 == 0).alias("allowed"), P.plan_text(arm, F.col("n_name"), F.lit("finqa"), F.lit("clean")).alias("line"))


@query("SELECT o_orderkey AS uid, o_orderstatus AS status FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 150")
def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of a split by its order."""
    return L.head(table(spark, sf_dir, "orders"), 150, "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"))


@query("SELECT n, least(n, 100) AS drawn, least(n, 100) AS distinct_drawn FROM (SELECT count(*) AS n FROM customer)")
def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample without replacement has the rows asked for, each once; it is the same on each call."""
    c = table(spark, sf_dir, "customer")
    one, two = (L.seeded_sample(c, 100, "c_custkey", 5).select("c_custkey") for _ in range(2))
    drawn = one.join(two, "c_custkey").agg(F.count("*").alias("drawn"), F.countDistinct("c_custkey").alias("distinct_drawn"))
    return c.agg(F.count("*").alias("n")).crossJoin(drawn)


@query(
    "SELECT o_orderstatus AS run, no::INT AS no, question, gold, human_answer, reply, outcome FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS no, repeat(o_orderpriority || ' ', 20)[1:140] AS question, "
    "round(o_totalprice, 2)::VARCHAR AS gold, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS human_answer, ('line ' || o_custkey || repeat('x', 70))[1:60] AS reply, CASE WHEN o_orderkey % 3 = 0 THEN 'Correct' ELSE 'Wrong number' END AS outcome FROM orders) WHERE no <= 80"
)
def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of each run, as people are shown them."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("run"), "o_orderdate", "o_orderkey", F.expr("repeat(o_orderpriority || ' ', 20)").alias("question"), k.cast("string").alias("uid"), F.round("o_totalprice", 2).cast("string").alias("gold"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).alias("answer_text"), F.concat(F.lit(" \nline "), F.col("o_custkey").cast("string"), F.expr("repeat('x', 70)"), F.lit("\nmore")).alias("reply"), F.when(k % 3 == 0, OUTCOMES[0]).otherwise(OUTCOMES[7]).alias("outcome"),
    )
    return B.shown_items(rows, ["run"], "o_orderdate", "o_orderkey")


@query(
    "SELECT c_name AS experiment, '50.0%' AS exact_match, CASE WHEN c_custkey % 2 = 0 THEN '40.0%-60.0%' ELSE '-' END AS ci, '-' AS strict, c_nationkey::VARCHAR AS n, '-' AS exec_acc, '25.0%' AS faithfulness, CASE WHEN c_custkey % 3 = 0 THEN '0.125' ELSE '-' END AS train_loss, "
    "CASE WHEN c_nationkey > 0 THEN format('{:,}', c_nationkey * 1000) ELSE '-' END AS tok_s, CASE WHEN c_custkey % 4 = 0 THEN '30 s' ELSE '2.5 min' END AS wall, '3.00 T' AS train_flops, '-' AS infer_flops, c_mktsegment AS code FROM customer"
)
def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's numbers, as people are shown them."""
    k, none = F.col("c_custkey"), F.lit(None).cast("double")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.lit(0.5).alias("exact_match"), F.when(k % 2 == 0, 0.4).alias("lo"), F.lit(0.6).alias("hi"), none.alias("exact_match_strict"), F.col("c_nationkey").alias("n_examples"), none.alias("execution_accuracy"), F.lit(0.25).alias("faithfulness_primary"),
        F.when(k % 3 == 0, 0.125).alias("train_loss"), (F.col("c_nationkey") * 1000.0).alias("tokens_per_s"), F.when(k % 4 == 0, 30.0).otherwise(150.0).alias("wall_time_s"), F.lit(3e12).alias("train_flops"), none.alias("infer_flops"), F.col("c_mktsegment").alias("git_commit"),
    )
    return B.shown_results(rows)
