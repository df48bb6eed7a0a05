"""Queries over answers, programs, tables and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import dsl, tables
from ..functions import numbers as N
from ..operators import ablation as AB
from ..operators import breakdown as B
from ..operators import rates as R
from ..operators import sandbox, stats
from ..session import stored
from .base import PAIRS, long, pairs, primary, spread, strict, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _n(x: str | Column) -> N.Answer:
    return N.number(F.col(x) if isinstance(x, str) else x)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs: each cell and seed has an old line with accuracy 0 and a newer one with its own."""
    items = pairs(spark, sf_dir).withColumn("hit", N.primary_match(_n("pred"), _n("gold")))
    cells = items.groupBy("arm", "model", "split", "seed").agg(R.share(F.col("hit")).alias("em"), F.count("*").cast("int").alias("n_examples"))
    log = cells.select("*", F.explode(F.array(F.struct(F.lit(1.0).alias("timestamp"), F.lit(0.0).alias("by")), F.struct(F.lit(2.0).alias("timestamp"), F.lit(1.0).alias("by")))).alias("v"))
    return log.select(
        F.concat_ws("|", "arm", "model", "split", "seed").alias("exp_id"), F.lit("finqa").alias("dataset"), "arm", "model", F.lit("").alias("variant"), "split", "seed", "n_examples",
        F.col("v.timestamp").alias("timestamp"), F.col("seed").cast("long").alias("ord"), (F.col("em") * F.col("v.by")).alias("exact_match"),
    )


_CELLS = (
    f"{PAIRS}, runs AS (SELECT arm, model, split, seed, count(*) AS n, count(*) FILTER (WHERE {primary()}) / count(*)::DOUBLE AS em FROM pairs GROUP BY ALL), "
    "cells AS (SELECT arm, model, split, count(*) AS n_seeds, round(avg(em), 4) AS em, arg_min(n, seed) AS n, round(stddev_samp(em), 4) AS sd FROM runs GROUP BY ALL)"
)


@query(
    f"WITH {_CELLS} SELECT 'finqa' AS dataset, arm, model, max(em) FILTER (WHERE split = 'standard') AS exact_match_standard, max(em) FILTER (WHERE split = 'clean') AS exact_match_clean, "
    "CAST(max(n) FILTER (WHERE split = 'standard') AS BIGINT) AS n_standard, CAST(max(n_seeds) FILTER (WHERE split = 'clean') AS BIGINT) AS n_seeds_clean, max(sd) FILTER (WHERE split = 'clean') AS sd_clean, "
    "round(max(em) FILTER (WHERE split = 'standard') - max(em) FILTER (WHERE split = 'clean'), 4) AS contamination_gap FROM cells GROUP BY arm, model ORDER BY arm, model"
)
def ablation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: log of runs to ablation table."""
    table_ = AB.ablation(AB.per_split(AB.current_runs(_runs(spark, sf_dir))))
    return table_.select("dataset", "arm", "model", "exact_match_standard", "exact_match_clean", long(F.col("n_standard")).alias("n_standard"), "n_seeds_clean", F.col("exact_match_seed_sd_clean").alias("sd_clean"), "contamination_gap").orderBy("arm", "model")


@query(f"WITH {_CELLS} SELECT arm, model, split, em AS exact_match, n_seeds FROM cells")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    cells = AB.per_split(AB.current_runs(_runs(spark, sf_dir)))
    return AB.frontier(cells).join(cells.select(*AB.KEY, "split", "n_seeds"), [*AB.KEY, "split"]).select("arm", "model", "split", "exact_match", "n_seeds")


@query(f"WITH {_CELLS} SELECT c.arm, c.model, c.seed, round(c.em, 6) AS clean, round(s.em, 6) AS standard, round(s.em - c.em, 6) AS gap FROM runs c JOIN runs s USING (arm, model, seed) WHERE c.split = 'clean' AND s.split = 'standard'")
def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    found = AB.gap_pairs(AB.current_runs(_runs(spark, sf_dir)))
    return found.select("arm", "model", "seed", *(F.round(c, 6).alias(c) for c in ("clean", "standard", "gap")))


_FORMS = [
    ("concat('$', {q})", "{q}"), ("concat('(', {q}, ')')", "-{q}"), ("concat({q}, ' million')", "{q} * 1000000"), ("concat({q}, '%')", "{q}"), ("concat('1,', lpad({q}, 3, '0'))", "1000 + {q}"),
    ("concat('fy ', 2000 + {q}, ' rev 10')", "2000 + {q}"), ("concat({q}, 'k')", "{q}"), ("concat('about ', {q}, '.5 bn')", "({q} + 0.5) * 1000000000"), ("concat('−', {q})", "-{q}"), ("'n/a'", "NULL"),
]


@query(
    "SELECT CAST(l_partkey % 10 AS INT) AS form, count(*) AS n, count(v) AS parsed, round(sum(v), 2) AS total FROM (SELECT l_partkey, CAST(CASE l_partkey % 10 "
    + " ".join(f"WHEN {i} THEN " + v.format(q="CAST(l_quantity AS BIGINT)") for i, (_, v) in enumerate(_FORMS))
    + " END AS DOUBLE) AS v FROM lineitem) GROUP BY 1"
)
def normalize_number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten written forms of a number; the SQL has the values they stand for."""
    q = "cast(cast(l_quantity as bigint) as string)"
    text = F.expr("case l_partkey % 10 " + " ".join(f"when {i} then " + t.format(q=q) for i, (t, _) in enumerate(_FORMS)) + " end")
    rows = spread(table(spark, sf_dir, "lineitem")).select((F.col("l_partkey") % 10).cast("int").alias("form"), N.normalize_number(text).alias("v"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count("v").alias("parsed"), F.round(F.sum("v"), 2).alias("total"))


@query(f"WITH {PAIRS} SELECT split, count(*) AS n, count(*) FILTER (WHERE {strict()}) AS hits, round(count(*) FILTER (WHERE {strict()}) / count(*)::DOUBLE, 6) AS rate FROM pairs GROUP BY split")
def strict_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, A1."""
    p, g = _n("pred"), _n("gold")
    return pairs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if(N.answers_match(p, g)).alias("hits"), F.round(R.exact_match(p, g), 6).alias("rate"))


@query(f"WITH {PAIRS} SELECT split, count(*) AS n, count(*) FILTER (WHERE {primary()}) AS hits, round(count(*) FILTER (WHERE {primary()}) / count(*)::DOUBLE, 6) AS rate FROM pairs GROUP BY split")
def primary_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4, A2."""
    p, g = _n("pred"), _n("gold")
    return pairs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if(N.primary_match(p, g)).alias("hits"), F.round(R.primary_exact_match(p, g), 6).alias("rate"))


@query(
    f"WITH {PAIRS} SELECT l_linenumber % 2 = 0 AS flagged, count(*) AS n, count(*) FILTER (WHERE {primary('pred * 100')} OR l_linenumber % 2 = 0 AND {primary('pred * 100 / 100')}) AS hits FROM pairs GROUP BY 1"
)
def percent_form_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as percentages, half of them with the sign."""
    flag = F.col("l_linenumber") % 2 == 0
    return pairs(spark, sf_dir).groupBy(flag.alias("flagged")).agg(F.count("*").alias("n"), F.count_if(N.primary_match(_n(F.col("pred") * 100), _n("gold"), flag)).alias("hits"))


@query("SELECT p_partkey % 4 AS form, count(*) AS n, count(*) FILTER (WHERE p_partkey % 4 < 3) AS hits FROM part GROUP BY 1")
def string_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in other case, spacing and punctuation, and one kind that differs."""
    form = F.col("p_partkey") % 4
    said = F.when(form == 0, F.upper("p_name")).when(form == 1, F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" \n ")), F.lit(" ."))).when(form == 2, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" x")))
    return table(spark, sf_dir, "part").groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.count_if(N.answers_match(N.text(said), N.text(F.col("p_name")))).alias("hits"))


@query(
    "SELECT CAST(l_partkey % 6 AS INT) AS form, count(*) AS n, count(*) FILTER (WHERE l_partkey % 6 IN (0, 1, 4)) AS numbers, count(*) FILTER (WHERE l_partkey % 6 IN (2, 3)) AS texts, "
    "count(*) FILTER (WHERE l_partkey % 6 = 1) AS percents, CAST(sum(CASE WHEN l_partkey % 6 IN (0, 1, 4) THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS total FROM lineitem GROUP BY 1"
)
def parse_answer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a marker, a percent sign, yes or no, a span, several lines, and none."""
    q = F.col("l_quantity").cast("long").cast("string")
    form = (F.col("l_partkey") % 6).cast("int")
    reply = (
        F.when(form == 0, F.concat(F.lit("I think 7.\nThe final answer is: "), q)).when(form == 1, F.concat(F.lit("Answer: "), q, F.lit("%")))
        .when(form == 2, F.lit("**No**, it fell. 5")).when(form == 3, F.lit("net income")).when(form == 4, F.concat(q, F.lit("\n99"))).otherwise(F.lit("  \n"))
    )
    rows = spread(table(spark, sf_dir, "lineitem")).select(form.alias("form"), A.parse_answer(reply).alias("a"), A.answer_is_percent(reply).alias("pct"))
    return rows.groupBy("form").agg(
        F.count("*").alias("n"), F.count("a.num").alias("numbers"), F.count("a.text").alias("texts"), F.count_if("pct").alias("percents"), long(F.coalesce(F.sum("a.num"), F.lit(0.0))).alias("total")
    )


@query("SELECT CAST(l_partkey % 4 AS INT) AS form, count(*) AS n, count(*) FILTER (WHERE l_partkey % 4 < 3) AS plain, CAST(sum(CASE WHEN l_partkey % 4 < 3 THEN length('answer = ' || CAST(l_quantity AS BIGINT)) ELSE length('answer = ' || CAST(l_quantity AS BIGINT)) + 4 END) AS BIGINT) AS chars FROM lineitem GROUP BY 1")
def extract_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs in closed and open fences, in none, and after prose without one."""
    code = F.concat(F.lit("answer = "), F.col("l_quantity").cast("long").cast("string"))
    form = (F.col("l_partkey") % 4).cast("int")
    reply = F.when(form == 0, F.concat(F.lit("Sure:\n```python\n"), code, F.lit("\n```\nDone."))).when(form == 1, F.concat(F.lit("```py\n"), code)).when(form == 2, F.concat(code, F.lit("\n"))).otherwise(F.concat(F.lit("so: "), code))
    rows = spread(table(spark, sf_dir, "lineitem")).select(form.alias("form"), code.alias("code"), A.extract_program(reply).alias("got"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("code") == F.col("got")).alias("plain"), long(F.sum(F.length("got"))).alias("chars"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) AS same, CAST(sum(length(CAST(o_orderkey * 1234567 AS VARCHAR))) AS BIGINT) AS chars FROM orders GROUP BY 1")
def strip_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers formatted with separators, against the same unformatted."""
    v = F.col("o_orderkey") * 1234567
    shown = tables.normalize_numbers(F.format_number(v, 0))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(shown == v.cast("string")).alias("same"), long(F.sum(F.length(shown))).alias("chars"))


@query("SELECT CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.25' END AS shown, count(*) AS n FROM lineitem GROUP BY 1")
def format_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers and numbers with decimals as answers are written."""
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + 0.25)
    return table(spark, sf_dir, "lineitem").groupBy(N.format_answer(_n(v)).alias("shown")).agg(F.count("*").alias("n"))


@query("SELECT l_linenumber % 3 AS form, count(*) AS n, count(*) FILTER (WHERE abs(l_discount + 0.004 * (l_linenumber % 3) - round(l_discount, 2)) <= 0.005 + 1e-12) AS hits FROM lineitem GROUP BY 1")
def human_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares near to percentages that a person has written."""
    written = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    value = F.col("l_discount") + F.lit(0.004) * (F.col("l_linenumber") % 3)
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("form")).agg(F.count("*").alias("n"), F.count_if(N.human_match(value, written)).alias("hits"))


@query("SELECT CAST(l_linenumber AS INT) AS line, count(*) AS n, count(*) FILTER (WHERE l_linenumber IN (2, 3, 5)) AS off FROM lineitem GROUP BY 1")
def power_of_ten_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values off by powers of ten, by other factors, and not at all."""
    factor = F.element_at(F.array(*map(F.lit, [1.0, 10.0, 0.001, 3.0, 1e6, 1.005, 1.0])), F.col("l_linenumber").cast("int"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(F.count("*").alias("n"), F.count_if(N.power_of_ten_off(F.col("l_extendedprice") * factor, F.col("l_extendedprice"))).alias("off"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of ten kinds by l_partkey % 10, whose outcome is known by construction. gold is the quantity and 5, as the kinds overlap for numbers below 6."""
    q = F.col("l_quantity") + 5
    k = F.col("l_partkey") % 10
    s = lambda c: c.cast("long").cast("string")
    gold = N.either(F.when(~k.isin(6, 8), q), F.when(k == 6, "yes").otherwise("capital lease")).struct()
    reply = (
        F.when(k == 0, s(q)).when(k == 1, F.concat(s(q * 100), F.lit("%"))).when(k == 2, F.concat(s(q * 2), F.lit(" / 2"))).when(k == 3, F.concat(s(q), F.lit(".0"), F.lit("05")))
        .when(k == 4, F.concat(F.lit("-"), s(q))).when(k == 5, s(q * 1000)).when(k == 6, F.lit("no")).when(k == 7, s(q * 3 + 1)).when(k == 8, F.lit("operating lease")).otherwise(F.lit(""))
    )
    rows = spread(table(spark, sf_dir, "lineitem")).select("l_partkey", "l_quantity", gold.alias("gold"), reply.alias("reply"), A.parse_answer(reply).alias("pred"))
    # '2q / 2' reads as its first number, 2q
    return A.with_readings(rows, "pred", "gold", "reply").withColumn("correct", N.primary_match(N.of("pred"), N.of("gold")))


@query(
    "SELECT outcome, n, CAST(ord AS INT) AS ord FROM (SELECT l_partkey % 10 AS k, count(*) AS n FROM lineitem WHERE l_partkey % 10 <> 3 GROUP BY 1 UNION ALL "
    "SELECT 0 AS k, 0 AS n WHERE false) c JOIN (VALUES (1, 'Right value, written as a %', 2), (2, 'Right arithmetic, not evaluated', 3), (4, 'Sign flipped', 5), (5, 'Off by a power of 10', 6), "
    "(6, 'Wrong yes/no', 7), (7, 'Wrong number', 8), (8, 'Not a number', 9), (9, 'No answer found', 10)) o(k, outcome, ord) ON c.k = o.k "
    "UNION ALL SELECT 'Correct', count(*), 1 FROM lineitem WHERE l_partkey % 10 IN (0, 3)"
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each answer."""
    rows = _labelled(spark, sf_dir)
    return B.outcome_counts(rows, A.outcome(F.col("correct")))


@query(
    "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE k IN (0, 3) AND (k = 0 OR 0.005 <= 1e-3 * q)) AS h0, count(*) FILTER (WHERE k = 1) AS h1, count(*) FILTER (WHERE k = 2) AS h2, "
    "count(*) FILTER (WHERE k = 3 AND 0.005 > 1e-3 * q) AS h3 FROM (SELECT l_partkey % 10 AS k, l_quantity + 5 AS q FROM lineitem)) "
    "SELECT CAST(ord AS INT) AS ord, rule, hits, n FROM c, LATERAL (VALUES (0, 'strict', h0), (1, 'percent', h0 + h1), (2, 'arithmetic', h0 + h1 + h2), (3, 'within_1pct', h0 + h1 + h2 + h3), (4, 'human_rounding', h0 + h1 + h2 + h3)) v(ord, rule, hits)"
)
def rule_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that each cumulative rule accepts."""
    rows = _labelled(spark, sf_dir)
    rules = rows.withColumn("rules", A.match_rules())
    return B.rule_ladder(rules).select("ord", "rule", "hits", "n")


@query(
    f"WITH {PAIRS} SELECT CAST(least(floor((greatest(least(log10(greatest(abs(pred - gold) / abs(gold), 1e-300)), 3), -4) + 4) * 4), 27) AS INT) AS bin, count(*) AS n FROM pairs WHERE gold <> 0 GROUP BY 1"
)
def error_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return B.error_size_histogram(pairs(spark, sf_dir), F.col("pred"), F.col("gold"))


@query("SELECT l_linestatus AS model, count(*) AS n, count(*) FILTER (WHERE l_quantity <> 13) AS with_value, round(sum(CASE WHEN l_quantity <> 13 THEN (l_extendedprice - l_quantity) / (l_quantity - 13) END), 2) AS total FROM lineitem GROUP BY 1")
def dsl_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-step programs with references; a division by zero has no value."""
    q = F.col("l_quantity").cast("long").cast("string")
    cents = F.concat(F.floor("l_extendedprice").cast("long").cast("string"), F.lit("."), F.lpad((F.round(F.col("l_extendedprice") * 100).cast("long") % 100).cast("string"), 2, "0"))
    program = F.concat(F.lit("subtract("), cents, F.lit(", "), q, F.lit("), subtract("), q, F.lit(", 13), divide(#0, #1)"))
    rows = dsl.evaluate(spread(table(spark, sf_dir, "lineitem")), program).select("l_linestatus", F.col("value.num").alias("v"))
    return rows.groupBy(F.col("l_linestatus").alias("model")).agg(F.count("*").alias("n"), F.count("v").alias("with_value"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(hi - lo), 2) AS spread, CAST(sum(total) AS BIGINT) AS total FROM (SELECT o_orderkey, o_orderpriority, max(l_quantity) AS hi, min(l_quantity) AS lo, sum(l_quantity) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1")
def dsl_table_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table operations over a row of quantities; an earlier row of the same name doesn't count."""
    grid = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("$ "), F.col("l_quantity").cast("long").cast("string"), F.lit(" (x)")))).alias("cells"))
    rows = grid.join(table(spark, sf_dir, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = F.array(F.array(F.lit("item"), F.lit("a")), F.array(F.lit("qty"), F.lit("999")), F.concat(F.array(F.lit(" qty ")), F.col("cells")))
    rows = dsl.evaluate(rows, F.lit("table_max(qty, none), table_min(qty, none), subtract(#0, #1)"), t, "spread")
    rows = dsl.evaluate(rows, F.lit("table_sum(qty, none)"), t, "total")
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("spread.num"), 2).alias("spread"), long(F.sum("total.num")).alias("total"))


@query("SELECT CAST(o_orderkey % 7 AS INT) AS form, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 IN (0, 6)) AS valid FROM orders GROUP BY 1")
def dsl_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed programs are told from valid ones."""
    forms = ["add(1, 2)", "", "add(1, 2", "modulo(1, 2)", "add(#1, 2)", "table_max(no row, none)", "1,234"]
    form = (F.col("o_orderkey") % 7).cast("int")
    got = dsl.evaluate(table(spark, sf_dir, "orders"), F.element_at(F.array(*map(F.lit, forms)), form + 1), F.array(F.array(F.lit("qty"), F.lit("1"))))
    return got.groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.count_if(F.col("value.error").isNull()).alias("valid"))


@query("SELECT l_returnflag AS arm, count(*) AS n, count(*) AS verified FROM lineitem GROUP BY 1")
def program_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs whose value is the gold answer, as text and as value."""
    q = F.col("l_quantity").cast("long").cast("string")
    program = F.concat(F.lit("multiply("), q, F.lit(", const_100), divide(#0, 4)"))
    rows = dsl.to_python(dsl.evaluate(spread(table(spark, sf_dir, "lineitem")), program), program, value="value")
    ok = dsl.verified(F.col("value"), _n(F.col("l_quantity") * 25)) & (F.col("python") == F.concat(F.lit("step_0 = "), q, F.lit(" * 100\nstep_1 = step_0 / 4\nanswer = step_1")))
    return rows.groupBy(F.col("l_returnflag").alias("arm")).agg(F.count("*").alias("n"), F.count_if(ok).alias("verified"))


@query("SELECT r_name AS region, '| nation | key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def linearize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    grid = F.concat(F.array(F.array(F.lit(" nation"), F.lit("key"))), F.transform("x", lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string"))))
    return cells.select(F.col("r_name").alias("region"), tables.linearize_table(grid).alias("markdown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Before 1234 it.' || chr(10) || chr(10) END || '| a | 1000 |' || chr(10) || '|---|---|' || chr(10) || chr(10) || c_name AS context FROM customer")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T4."""
    pre = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Before 1,234"), F.lit("it.")))
    return table(spark, sf_dir, "customer").select("c_custkey", tables.build_context(pre, F.array(F.array(F.lit("a"), F.lit("1,000"))), F.array(F.col("c_name"))).alias("context"))


@query("SELECT conv_id, turn, 'Report:' || chr(10) || 'R' || chr(10) || chr(10) || CASE WHEN turn % 2 = 1 THEN 'Conversation so far:' || chr(10) || 'Q: first' || chr(10) || 'A: ' || turn || chr(10) || chr(10) ELSE '' END || 'Question: ' || role AS block FROM conversations")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: task blocks with and without earlier turns."""
    history = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.lit("first").alias("question"), _n("turn").struct().alias("answer")))).otherwise(F.array().cast("array<struct<question:string,answer:struct<num:double,text:string>>>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tables.task_block(F.lit("R"), F.col("role"), history).alias("block"))


@query("SELECT o_orderkey, CAST(count(*) FILTER (WHERE l_quantity = mx) AS BIGINT) AS cells FROM (SELECT l_orderkey AS o_orderkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS mx FROM lineitem) GROUP BY 1")
def grounding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold a program's operand."""
    grid = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat(F.lit("$ "), F.col("l_quantity").cast("long").cast("string"))).alias("cells"), F.max("l_quantity").cast("long").cast("string").alias("top"))
    found = dsl.grounding_cells(F.array(F.concat(F.array(F.lit("99")), F.col("cells"))), F.concat(F.lit("subtract("), F.col("top"), F.lit(", const_1)")))
    return grid.select("o_orderkey", long(F.size(found)).alias("cells"))


@query("SELECT conv_id, turn, count(*) OVER w AS earlier, coalesce(string_agg(role, '>') OVER w, '') AS roles FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def conv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with all earlier ones."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(before).alias("earlier"), F.array_join(F.collect_list("role").over(before), ">").alias("roles"))


@query(
    f"WITH {PAIRS} SELECT arm, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 3) AS executable, count(*) FILTER (WHERE {primary()}) AS correct, "
    f"round(count(*) FILTER (WHERE {primary()} AND l_linenumber NOT IN (3, 5)) / (count(*) FILTER (WHERE {primary()}))::DOUBLE, 6) AS faithful, "
    f"round(count(*) FILTER (WHERE l_linenumber <> 3 AND {primary('pred')}) / count(*)::DOUBLE, 6) AS execution FROM pairs GROUP BY arm"
)
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 3 has no executed value, line 5 is not grounded."""
    rows = pairs(spark, sf_dir).withColumns({"value": F.when(F.col("l_linenumber") != 3, F.col("pred")), "correct": N.primary_match(_n("pred"), _n("gold"))})
    grounded = F.when(F.col("l_linenumber") == 5, F.lit(False)).when(F.col("l_linenumber") == 6, F.lit(True))
    return rows.groupBy("arm").agg(
        F.count("*").alias("n"), long(F.round(R.executability_rate(_n("value")) * F.count("*"))).alias("executable"), F.count_if("correct").alias("correct"),
        F.round(R.program_faithfulness(F.col("correct"), _n("value"), _n("pred"), grounded), 6).alias("faithful"), F.round(R.primary_execution_accuracy(_n("value"), _n("gold")), 6).alias("execution"),
    )


@query(
    f"WITH {PAIRS}, r AS (SELECT DISTINCT ON (arm, l_linenumber, l_partkey) arm, l_linenumber AS run, l_partkey AS uid, {primary()} AS correct FROM pairs), "
    "n AS (SELECT arm, count(DISTINCT run) AS runs FROM r GROUP BY 1), s AS (SELECT arm, uid, avg(correct::INT) AS score, count(DISTINCT run) AS c FROM r GROUP BY ALL) "
    "SELECT arm, count(*) AS items, round(avg(score), 6) AS score FROM s JOIN n USING (arm) WHERE c = runs GROUP BY 1"
)
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that all runs have, and their mean correctness. An item's correctness follows from its part."""
    rows = pairs(spark, sf_dir).select("arm", F.col("l_linenumber").alias("exp_id"), F.col("l_partkey").alias("uid"), N.primary_match(_n("pred"), _n("gold")).alias("correct"))
    once = rows.groupBy("arm", "exp_id", "uid").agg(F.max("correct").alias("correct"))  # of one part all are equal
    return R.item_scores(once, ["arm"], present=rows).groupBy("arm").agg(F.count("*").alias("items"), F.round(F.avg("score"), 6).alias("score"))


@query(f"WITH {_CELLS} SELECT arm, model, split, count(em) AS n, round(stddev_samp(em), 6) AS sd FROM runs GROUP BY ALL")
def seed_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    runs = AB.current_runs(_runs(spark, sf_dir))
    return runs.groupBy("arm", "model", "split").agg(F.count("exact_match").alias("n"), F.round(R.seed_sd(F.col("exact_match")), 6).alias("sd"))


@query(
    "WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS a, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1) "
    "SELECT lang, a AS only_a, b AS only_b, round(CASE WHEN a + b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2::DOUBLE))))) END, 6) AS p FROM c"
)
def mcnemar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired outcomes of the same documents."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return stats.mcnemar(both, F.col("quality") == 1, F.col("toxic") == 1, "lang").select("lang", "only_a", "only_b", F.round("p", 6).alias("p"))


@query(
    "WITH t AS (SELECT n_regionkey AS family, n_nationkey AS test, (n_nationkey * 7 % 25 + 1) / 250::DOUBLE AS p FROM nation), "
    "s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS step FROM t) "
    "SELECT family, test, round(max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s"
)
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, W4."""
    tests = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), ((F.col("n_nationkey") * 7 % 25 + 1) / F.lit(250.0)).alias("p"))
    return stats.holm(tests, "p", "family", order="test").select("family", "test", F.round("p_holm", 9).alias("p_holm"))


def _sample_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary outcomes of labelled documents, as two sides of one group per language."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return both.select("lang", "doc_id", F.inline(F.array(F.struct(F.lit("standard").alias("split"), F.col("quality").cast("double").alias("score")), F.struct(F.lit("clean").alias("split"), F.col("toxic").cast("double").alias("score")))))


def _near(lo: str, hi: str, centre: str, se: F.Column, step: F.Column) -> F.Column:
    """Whether an interval is the normal one, but for resampling and for the steps that means of few items take."""
    slack = 0.006 + 0.1 * se + step
    return (F.abs(F.col(centre) - 1.959964 * se - F.col(lo)) <= slack) & (F.abs(F.col(centre) + 1.959964 * se - F.col(hi)) <= slack)


@query("SELECT lang, split, count(*) AS n, round(avg(v), 6) AS mean, true AS normal FROM (SELECT lang, unnest(['standard', 'clean']) AS split, unnest([quality, toxic]) AS v FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled intervals, held against the normal ones."""
    found = stats.bootstrap_mean(_sample_items(spark, sf_dir), ["lang", "split"], "score")
    se = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    return found.select("lang", "split", "n", F.round("mean", 6).alias("mean"), _near("lo", "hi", "mean", se, 1 / F.col("n")).alias("normal"))


@query("SELECT lang, round(avg(quality) - avg(toxic), 6) AS difference, true AS normal, true AS paired_normal FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def bootstrap_gap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled intervals of differences, unpaired and paired, held against the normal ones."""
    items = _sample_items(spark, sf_dir)
    score = lambda s: F.max(F.when(F.col("split") == s, F.col("score")))
    both = items.groupBy("lang", "doc_id").agg(score("standard").alias("a"), score("clean").alias("b"))
    spreads = both.groupBy("lang").agg(F.count("*").alias("n"), (F.var_pop("a") + F.var_pop("b")).alias("free"), F.var_pop(F.col("a") - F.col("b")).alias("tied"))
    sides = ("standard", "clean")
    free = stats.bootstrap_difference(items, ["lang"], "split", sides, "score")
    tied = stats.bootstrap_difference(items, ["lang"], "split", sides, "score", paired_by="doc_id").select("lang", F.col("lo").alias("tied_lo"), F.col("hi").alias("tied_hi"))
    found, step = free.join(tied, "lang").join(spreads, "lang"), 1 / F.col("n")
    normal = _near("lo", "hi", "difference", F.sqrt(F.col("free") / F.col("n")), step)
    paired = _near("tied_lo", "tied_hi", "difference", F.sqrt(F.col("tied") / F.col("n")), step)
    return found.select("lang", F.round("difference", 6).alias("difference"), normal.alias("normal"), paired.alias("paired_normal"))


@query(
    "WITH c AS (SELECT lang, avg(quality) FILTER (WHERE doc_id % 3 = 0) AS sa, avg(quality) FILTER (WHERE doc_id % 3 = 1) AS ca, avg(quality) FILTER (WHERE doc_id % 3 = 2) AS ka, "
    "avg(toxic) FILTER (WHERE doc_id % 3 = 0) AS sb, avg(toxic) FILTER (WHERE doc_id % 3 = 1) AS cb, avg(toxic) FILTER (WHERE doc_id % 3 = 2) AS kb FROM labels JOIN documents USING (doc_id) GROUP BY 1), "
    "m AS (SELECT lang, unnest(['gap_difference', 'gap_first', 'style_first', 'recency_first', 'gap_second', 'style_second', 'recency_second']) AS measure, "
    "unnest([sa - ka - (sb - kb), sa - ka, sa - ca, ca - ka, sb - kb, sb - cb, cb - kb]) AS value FROM c) SELECT lang, measure, round(value, 6) AS value, value IS NOT NULL AS covered FROM m"
)
def gap_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' gaps, their parts and their difference, with intervals that hold the value: both systems resampled by the same draws within each split."""
    split = F.element_at(F.array(*map(F.lit, ["standard", "control", "clean"])), (F.col("doc_id") % 3 + 1).cast("int"))
    items = _sample_items(spark, sf_dir).withColumnRenamed("split", "system").withColumn("split", split)
    found = stats.gap_comparison(items, ["lang"], "system", ("standard", "clean"), "split", "score", "doc_id")
    covered = F.coalesce((F.col("lo") <= F.col("value") + 1e-12) & (F.col("value") <= F.col("hi") + 1e-12), F.lit(False))
    return found.select("lang", "measure", F.round("value", 6).alias("value"), covered.alias("covered"))


@query()
def ablation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation table with intervals, on cells of the pairs (a run's items are a benchmark's test set)."""
    rows = pairs(spark, sf_dir)
    items = rows.select(F.concat_ws("|", "arm", "model", "split", "seed").alias("exp_id"), F.col("l_partkey").alias("uid"), N.primary_match(_n("pred"), _n("gold")).alias("correct"))
    once = items.groupBy("exp_id", "uid").agg(F.max("correct").alias("correct"))  # of one part all are equal
    return AB.ablation_with_intervals(stored(AB.current_runs(_runs(spark, sf_dir)), "runs"), once, present=items)


@query("SELECT op AS label, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS hits FROM (SELECT l_linenumber, unnest(CASE WHEN l_partkey % 2 = 0 THEN ['add', 'divide'] ELSE ['subtract'] END) AS op FROM lineitem) GROUP BY 1")
def accuracy_by_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item counts once for each distinct operation of its program."""
    program = F.when(F.col("l_partkey") % 2 == 0, "divide(1, 2), add(#0, 3), add(#1, 4)").otherwise("subtract(5, 1)")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2 == 0).alias("correct"), A.question_features(program, F.array().cast("array<string>"), F.lit(None).cast("string"))["ops"].alias("ops"))
    return B.accuracy_by_operation(rows).select("label", "n", "hits")


@query("SELECT CASE l_linenumber % 4 WHEN 0 THEN 'table only' WHEN 1 THEN 'text only' WHEN 2 THEN 'table + text' ELSE 'unknown' END AS label, count(*) AS n, count(*) FILTER (WHERE l_partkey % 3 = 0) AS hits FROM lineitem GROUP BY 1")
def accuracy_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, A18."""
    k = F.col("l_linenumber") % 4
    inds = F.when(k == 0, F.array(F.lit("table_1"))).when(k == 1, F.array(F.lit("text_0"), F.lit("text_4"))).otherwise(F.array().cast("array<string>"))
    source = F.when(k == 2, F.lit("table-text"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3 == 0).alias("correct"), A.question_features(F.lit(""), inds, source)["evidence"].alias("evidence"))
    return B.accuracy_by(rows, F.col("evidence")).select("label", "n", "hits")


@query("SELECT 1 + CAST(l_linenumber % 3 AS INT) AS label, count(*) AS n, count(*) FILTER (WHERE l_partkey % 3 = 0) AS hits FROM lineitem WHERE l_linenumber % 4 > 0 GROUP BY 1")
def accuracy_by_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By reasoning steps; questions without a program don't count."""
    program = F.when(F.col("l_linenumber") % 4 > 0, F.array_join(F.array_repeat(F.lit("add(1, 2)"), (F.col("l_linenumber") % 3 + 1).cast("int")), ", "))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3 == 0).alias("correct"), A.question_features(program, F.array().cast("array<string>"), F.lit(None).cast("string"))["n_steps"].alias("n_steps"))
    return B.accuracy_by(rows, F.col("n_steps")).select("label", "n", "hits")


@query(
    "WITH d AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents), e AS (SELECT DISTINCT v FROM d WHERE i IN (least(n - 1, floor(n * 0.25)), least(n - 1, floor(n * 0.5)), least(n - 1, floor(n * 0.75)))) "
    "SELECT CAST((SELECT count(*) FROM e WHERE e.v < d.v) AS INT) AS bucket, count(*) AS n, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1"
)
def accuracy_by_length_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, A19."""
    return B.length_buckets(table(spark, sf_dir, "documents"), "n_chars").groupBy("bucket").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 30::DOUBLE)), 29) AS BIGINT) AS bin, count(*) AS n FROM documents, b GROUP BY 1")
def reply_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return B.length_histogram(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT CAST(l_quantity AS BIGINT) - 10 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def short_reply_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bin per length where none is over 40."""
    return B.length_histogram(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 10).alias("length")), "length")


@query(
    "SELECT part, count(*) AS n, CAST(sum(seconds) AS BIGINT) AS seconds FROM (SELECT unnest([{'part': 'load', 'seconds': greatest(m - t, 0)}, {'part': 'train', 'seconds': t}, {'part': 'answer', 'seconds': i}, "
    "{'part': 'other', 'seconds': greatest(w - greatest(m - t, 0) - t - i, 0)}], recursive := true) FROM (SELECT o_orderkey % 50 + 20 AS m, o_orderkey % 40 AS t, o_orderkey % 7 AS i, o_orderkey % 90 AS w FROM orders)) WHERE seconds > 0 GROUP BY 1"
)
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("exp_id"), (k % 50 + 20).cast("double").alias("model_s"), (k % 40).cast("double").alias("train_s"), (k % 7).cast("double").alias("infer_s"), (k % 90).cast("double").alias("wall_s"))
    return B.time_split(runs).groupBy("part").agg(F.count("*").alias("n"), long(F.sum("seconds")).alias("seconds"))


@query("SELECT o_custkey AS exp_id, CAST(arg_max(o_orderkey, (round(o_totalprice / 100000), o_orderkey % 3, -o_orderkey)) AS BIGINT) AS step FROM orders GROUP BY 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32, O3."""
    checks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("exp_id"), F.col("o_orderkey").alias("step"), F.round(F.col("o_totalprice") / 100000).alias("dev_em"), (F.col("o_orderkey") % 3).cast("double").alias("faithfulness"))
    return B.best_checkpoint(checks, "exp_id")


@query("SELECT CAST(l_linenumber AS INT) AS line, count(*) AS n, count(*) FILTER (WHERE l_linenumber IN (1, 4)) AS numbers, count(*) FILTER (WHERE l_linenumber = 2) AS words, round(sum(CASE l_linenumber WHEN 1 THEN l_quantity / 4 WHEN 4 THEN -(l_quantity + 1) * 2 END), 4) AS total FROM lineitem GROUP BY 1")
def eval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions, a comparison, a division by zero, a plain number and text."""
    q = F.col("l_quantity").cast("long").cast("string")
    k = F.col("l_linenumber")
    text = F.when(k == 1, F.concat(F.lit("$"), q, F.lit(" ÷ 4"))).when(k == 2, F.concat(q, F.lit(" > 10"))).when(k == 3, F.concat(q, F.lit(" / 0"))).when(k == 4, F.concat(F.lit("-("), q, F.lit(" + 1) × 2\nso"))).when(k == 5, q).otherwise(F.lit("a + b"))
    rows = spread(table(spark, sf_dir, "lineitem")).select(k.cast("int").alias("line"), A.eval_arithmetic(text).alias("v"))
    return rows.groupBy("line").agg(F.count("*").alias("n"), F.count("v.num").alias("numbers"), F.count("v.text").alias("words"), F.round(F.sum("v.num"), 4).alias("total"))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each supplier, of five forms: with a number, with a word, without an answer, with an error, and one that opens a file."""
    v = F.col("s_nationkey").cast("string")
    form = (F.col("s_suppkey") % 5).cast("int")
    code = F.when(form == 0, F.concat(F.lit("x = "), v, F.lit("\nanswer = x * 2"))).when(form == 1, F.concat(F.lit("answer = 'yes' if "), v, F.lit(" > 3 else 'no'"))).when(form == 2, F.lit("x = 1  # answer")).when(form == 3, F.lit("answer = 1 / 0")).otherwise(F.lit("answer = open('/etc/hostname').read()"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", form.alias("form"), code.alias("code"))


@query("SELECT CAST(s_suppkey % 5 AS INT) AS form, count(*) AS n, count(*) FILTER (WHERE s_suppkey % 5 < 2) AS ok, CAST(coalesce(sum(CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey * 2 END), 0) AS BIGINT) AS total FROM supplier GROUP BY 1")
def sandbox_exec_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the programs of all suppliers, run in the sandbox."""
    rows = _programs(spark, sf_dir).select("form", sandbox.execute(F.col("code")).alias("r"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count_if("r.ok").alias("ok"), long(F.coalesce(F.sum("r.num"), F.lit(0.0))).alias("total"))


@query("SELECT least(count(*), 50) AS checked, least(count(*), 50) AS agreed FROM supplier WHERE s_suppkey % 5 = 0")
def sandbox_spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 sampled records out of all that have a program; each program gives its answer."""
    program = F.when(F.col("form") == 0, F.col("code"))
    records = _programs(spark, sf_dir).select(F.col("s_suppkey").alias("uid"), program.alias("gold_program"), N.number(F.col("s_nationkey") * 2).struct().alias("answer"))
    return sandbox.spot_check(records, 50)
