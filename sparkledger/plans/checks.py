"""Queries of the checks that go beyond scores: verbatim overlap, grounding of programs, votes of sampled answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import agreement, overlap
from ..operators import rates as R
from ..session import stored
from ..sources import raw
from .base import NEAR, STRICT, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
_RUNS = "array_to_string(w[pos:pos + 7], ' ') AS run"


@query(
    f"WITH i AS (SELECT *, {_RUNS} FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS pos FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))), "
    f"d AS (SELECT *, {_RUNS} FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS pos FROM (SELECT doc_id, {_WORDS} AS w FROM documents))), "
    "m AS (SELECT item_id, len(i.w) AS item_words, doc_id, d.pos - i.pos AS diagonal, d.pos - row_number() OVER (PARTITION BY item_id, doc_id, d.pos - i.pos ORDER BY d.pos) AS chain FROM i JOIN d USING (run)), "
    "c AS (SELECT item_id, item_words, doc_id, count(*) + 7 AS words FROM m GROUP BY item_id, item_words, doc_id, diagonal, chain) "
    "SELECT item_id, doc_id, max(words) AS words, max(item_words) AS item_words FROM c GROUP BY ALL"
)
def verbatim_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.13: the longest run of words that each benchmark item shares with each document, eight words or more."""
    return overlap.longest_common_runs(table(spark, sf_dir, "benchmark"), spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(
    "WITH o AS (SELECT l_orderkey, round(max(l_extendedprice) * 1.0004::DOUBLE, 2) AS a, count(*) + 20 AS b FROM lineitem GROUP BY 1), "
    "n AS (SELECT l_orderkey, a::DOUBLE AS x FROM o UNION SELECT l_orderkey, b::DOUBLE FROM o), c AS (SELECT l_orderkey, l_extendedprice AS y FROM lineitem UNION ALL SELECT l_orderkey, -l_quantity FROM lineitem), "
    "f AS (SELECT n.l_orderkey, x, EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = n.l_orderkey AND abs(x - abs(y)) <= 1e-3::DOUBLE * greatest(abs(y), 1)) AS held FROM n WHERE x <> 100) "
    "SELECT l_orderkey, count(*) AS named, count(*) FILTER (WHERE held) AS found, bool_and(held) AS grounded FROM f GROUP BY 1"
)
def program_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.13: whether the numbers that a program of each order names stand in the order's lines, within the tolerance."""
    lines = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("step_1 = ("), F.round(F.max("l_extendedprice") * 1.0004, 2).cast("string"), F.lit(" - "), (F.count("*") + 20).cast("string"), F.lit(") / 100  # of 7\nanswer = step_1"))
    programs = lines.groupBy("l_orderkey").agg(text.alias("program"))
    cells = lines.select("l_orderkey", F.explode(F.array("l_extendedprice", -F.col("l_quantity"))).alias("y"))
    return agreement.grounded(programs, cells, "l_orderkey", "program", "y")


@query(
    "WITH s AS (SELECT l_suppkey, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 64 + l_quantity::BIGINT AS pos, CASE WHEN l_linenumber < 6 THEN floor(l_quantity / 10) + 0.0004::DOUBLE * (l_linenumber % 3) END AS num, CASE l_linenumber WHEN 6 THEN 'yes' END AS text FROM lineitem), "
    "k AS (SELECT *, CASE WHEN num - lag(num) OVER w <= 1e-3::DOUBLE * greatest(abs(lag(num) OVER w), 1) OR num IS NULL AND text = lag(text) OVER w THEN 0 ELSE 1 END AS fresh FROM s WHERE num IS NOT NULL OR text IS NOT NULL "
    "WINDOW w AS (PARTITION BY l_suppkey ORDER BY num NULLS LAST, text NULLS LAST, pos)), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY num NULLS LAST, text NULLS LAST, pos ROWS UNBOUNDED PRECEDING) AS grp FROM k), "
    "v AS (SELECT l_suppkey, grp, count(*) AS votes, min(pos) AS first, arg_min(struct_pack(num := num, text := text), pos) AS said FROM g GROUP BY ALL) "
    "SELECT l_suppkey, sum(votes)::BIGINT AS n, count(*) AS groups, max(votes) AS votes, (arg_max(said, (votes, -first))).num AS num, (arg_max(said, (votes, -first))).text AS text FROM v GROUP BY 1"
)
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.13: the answer that most samples of a question agree on within the tolerance; numbers, words and missing answers."""
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (((F.col("l_orderkey") * 8 + k) * 100_000 + F.col("l_partkey")) * 64 + F.col("l_quantity").cast("long")).alias("at"), F.when(k < 6, F.floor(F.col("l_quantity") / 10) + F.lit(0.0004) * (k % 3)).alias("num"), F.when(k == 6, " Yes").alias("text"))
    return agreement.vote(rows, ["l_suppkey"], "at", "num", "text")


_MATCH = f"({STRICT.format(p='pred', g='gold')} OR {NEAR.format(p='pred', g='gold')})"


@query(
    "WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_returnflag AS arm, l_orderkey AS k, l_linenumber AS i, l_quantity AS gold, l_quantity * CASE l_linenumber % 3 WHEN 0 THEN 1.004::DOUBLE WHEN 1 THEN 1 ELSE 1.5::DOUBLE END AS pred FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag), "
    "v AS (SELECT *, CASE WHEN i = 3 THEN NULL WHEN i % 2 = 0 THEN pred * 1.0005::DOUBLE ELSE pred * 1.2::DOUBLE END AS x, gold <= 20 AS grounded FROM l), "
    f"f AS (SELECT *, {_MATCH} AS correct, x IS NOT NULL AND {STRICT.format(p='x', g='pred')} AS fits FROM v) "
    "SELECT arm, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, round(avg(fits::INT) FILTER (WHERE correct), 6) AS faithful, round(avg((fits AND grounded)::INT) FILTER (WHERE correct), 6) AS grounded FROM f GROUP BY 1"
)
def faithful_and_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, A6, §2.13: items from predictions, gold answers and the grounding of their programs; faithfulness with and without it. Cells up to 20 are in the table."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("r"))
    q, i = F.col("r.l_quantity"), F.col("l_linenumber")
    pred = q * F.when(i % 3 == 0, 1.004).when(i % 3 == 1, 1.0).otherwise(1.5)
    value = F.when(i != 3, F.when(i % 2 == 0, pred * 1.0005).otherwise(pred * 1.2))
    uid = F.concat_ws("/", F.col("l_orderkey").cast("string"), i.cast("string")).alias("uid")
    # Five tables are made of these rows, so they are worked out once.
    base = stored(rows.select(uid, F.col("r.l_returnflag").alias("arm"), q.alias("q"), pred.alias("p"), value.alias("x")), "answers")
    predictions = base.select("uid", N.number(F.col("p")).struct().alias("pred"), N.number(F.col("x")).struct().alias("exec_value"), F.lit(False).alias("percent_form"))
    program = F.concat(F.lit("answer = "), F.col("q").cast("string"), F.lit(" * 100 / 100"))
    grounding = agreement.grounded(base.select("uid", program.alias("program")), base.select("uid", F.when(F.col("q") <= 20, F.col("q")).alias("cell")), "uid", "program", "cell")
    items = R.faith_items(predictions, base.select("uid", "arm", N.number(F.col("q")).struct().alias("gold")), grounding)
    known = lambda g: F.round(R.program_faithfulness(F.col("correct"), N.of("exec_value"), N.of("pred"), g), 6)
    return items.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), known(None).alias("faithful"), known(F.col("grounded")).alias("grounded"))


@query(
    "SELECT l_suppkey::VARCHAR AS doc, count(*) AS questions, sum(l_linenumber)::DOUBLE AS total, count(DISTINCT l_orderkey * 8 + l_linenumber)::BIGINT AS ids, string_agg(l_linenumber::VARCHAR, '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS in_order FROM lineitem GROUP BY 1"
)
def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with many questions become a record a question, each with its place in the document."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("place"))
    uid = F.concat_ws("/", F.col("place").cast("string"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"))
    q = F.struct(
        uid.alias("uid"), F.col("place").alias("order"), F.lit("?").alias("question"), F.parse_json(F.concat(F.lit('"'), F.col("l_linenumber").cast("string"), F.lit('"'))).alias("answer"), F.lit("").alias("derivation"), F.lit("count").alias("answer_type"), F.lit("text").alias("answer_from"),
        F.lit("").alias("scale"), F.lit(False).alias("req_comparison"),
    )
    documents = lines.groupBy("l_suppkey").agg(F.shuffle(F.collect_list(q)).alias("questions")).select(
        F.struct(F.col("l_suppkey").cast("string").alias("uid"), F.array(F.array(F.lit("a"), F.lit("1"))).alias("table")).alias("table"), F.array(F.struct(F.lit("p").alias("uid"), F.lit(1).alias("order"), F.lit("t").alias("text"))).alias("paragraphs"), "questions"
    )
    made = raw.tatqa(documents)
    part = F.split("uid", "/")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part[0].cast("int").alias("i"), F.col("answer.num").cast("int").alias("x")))), lambda r: r["x"].cast("string")), "")
    return made.groupBy(F.col("extra.table_uid").alias("doc")).agg(F.count("*").alias("questions"), F.sum("answer.num").alias("total"), F.countDistinct(part[1]).alias("ids"), said.alias("in_order"))
