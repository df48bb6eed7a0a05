"""Builders from raw benchmark files to examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import dsl
from ..functions import numbers as N
from ..functions import tables as T
from ..functions.text import strip
from .readers import answer

_REPORT = "filename string, pre_text array<string>, post_text array<string>, table array<array<string>>"
FINQA = f"id string, {_REPORT}, qa struct<question:string,program:string,exe_ans:variant,answer:string,gold_inds:map<string,string>>"
CONVFINQA = f"id string, {_REPORT}, annotation struct<cur_dial:array<string>,exe_ans_list:array<variant>,cur_program:string,exe_ans:variant,cur_type:string,qa_split:boolean>"
TATQA = (
    "table struct<uid:string,table:array<array<string>>>, paragraphs array<struct<uid:string,order:int,text:string>>,"
    " questions array<struct<uid:string,order:int,question:string,answer:variant,derivation:string,answer_type:string,answer_from:string,scale:string,req_comparison:boolean>>"
)


def _verified(rows: DataFrame) -> DataFrame:
    """Records from question, program, gold and the report; the program is kept if its value is the gold answer."""
    rows = dsl.to_python(dsl.evaluate(rows, F.col("program"), F.col("table")), F.col("program"), F.col("table"), value="value")
    rows = rows.withColumn("program_verified", dsl.verified(F.col("value"), N.of("gold")))
    return rows.select(
        "uid", "question", T.build_context(F.col("pre_text"), F.col("table"), F.col("post_text")).alias("context"), F.col("gold").alias("answer"),
        F.when(F.col("program_verified"), F.col("python")).alias("gold_program"),
        dsl.grounding_cells(F.col("table"), F.col("program")).alias("table_cells"), F.col("program").alias("program_dsl"), "program_verified", "filename", T.normalize_table(F.col("table")).alias("table"), "extra",
    )


def finqa(raw: DataFrame) -> DataFrame:
    """From records of the schema FINQA."""
    extra = F.struct(F.col("qa.answer").alias("answer_text"), F.array_sort(F.map_keys("qa.gold_inds")).alias("gold_inds"))
    return _verified(raw.select("filename", "pre_text", "post_text", "table", F.col("id").alias("uid"), F.col("qa.question").alias("question"), F.col("qa.program").alias("program"), answer(F.col("qa.exe_ans")).alias("gold"), extra.alias("extra")))


def convfinqa(raw: DataFrame) -> DataFrame:
    """A record per turn, with the earlier questions and their gold answers."""
    a = F.col("annotation")
    turn = F.size(a["cur_dial"]) - 1
    history = F.slice(F.transform(F.arrays_zip(a["cur_dial"].alias("q"), a["exe_ans_list"].alias("a")), lambda z: F.struct(z["q"].alias("question"), answer(z["a"]).alias("answer"))), F.lit(1), F.greatest(turn, F.lit(0)))
    extra = F.struct(F.regexp_extract("id", r"^(.*)_[^_]*$", 1).alias("conversation_id"), turn.alias("turn_index"), history.alias("history"), a["cur_type"].alias("turn_type"), a["qa_split"].alias("qa_split"))
    return _verified(raw.select("filename", "pre_text", "post_text", "table", F.col("id").alias("uid"), F.get(a["cur_dial"], turn).alias("question"), a["cur_program"].alias("program"), answer(a["exe_ans"]).alias("gold"), extra.alias("extra")))


def tatqa_answer(v: Column, kind: Column) -> Column:
    """A number for arithmetic and counts, one span as it is, several joined by '; '."""
    spans = F.try_variant_get(v, "$", "array<string>")
    is_list = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    one = answer(v)
    number = F.when(kind.isin("arithmetic", "count"), F.coalesce(one["num"], N.plain_float(one["text"])))
    return N.either(F.when(is_list, F.lit(None).cast("double")).otherwise(F.coalesce(number, one["num"])), F.when(is_list, F.array_join(spans, "; ")).otherwise(one["text"])).struct()


def tatqa(raw: DataFrame) -> DataFrame:
    """A record per question, in the documents' order; paragraphs in theirs. Derivations that evaluate to the gold answer become programs."""
    ordered = lambda c: F.array_sort(c, lambda x, y: x["order"] - y["order"])
    paragraphs = F.array_join(F.transform(ordered(F.col("paragraphs")), lambda p: strip(T.normalize_numbers(p["text"]))), "\n")
    grid = F.col("table.table")
    rows = raw.select(F.col("table.uid").alias("table_uid"), grid.alias("grid"), T.paragraphs(T.linearize_table(T.normalize_table(grid)), paragraphs).alias("context"), F.explode(ordered(F.col("questions"))).alias("q"))
    rows = rows.withColumns({"gold": tatqa_answer(F.col("q.answer"), F.col("q.answer_type")), "expression": F.when(F.col("q.answer_type") == "arithmetic", dsl.derivation_expression(F.col("q.derivation")))})
    # a bare number is an expression too; eval_arithmetic only takes those with an operator
    value = lambda e: F.coalesce(A.eval_arithmetic(e)["num"], N.plain_float(e))
    rows = rows.withColumn("value", value(F.col("expression")))
    ratio = N.gold_matches(N.number(F.col("value")), N.of("gold"), True) & F.col("value").isNotNull()
    percent = (F.col("q.scale") == "percent") & F.col("value").isNotNull() & N.gold_matches(N.number(F.col("value") * 100), N.of("gold"), True)
    program = F.when(ratio, F.concat(F.lit("answer = "), F.col("expression"))).when(percent, F.concat(F.lit("answer = ("), F.col("expression"), F.lit(") * 100")))
    cells = F.when(program.isNotNull(), dsl.derivation_cells(F.col("grid"), F.col("expression"))).otherwise(F.array().cast("array<struct<row:int,col:int,text:string>>"))
    return rows.select(F.col("q.uid").alias("uid"), F.col("q.question").alias("question"), "context", F.col("gold").alias("answer"), program.alias("gold_program"), cells.alias("table_cells"), program.isNotNull().alias("program_verified"), T.normalize_table(F.col("grid")).alias("table"), F.struct("q.answer_type", "q.answer_from", "q.scale", "q.derivation", "q.req_comparison", "table_uid").alias("extra"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


#: Builders and the schemas of what they read.
BUILDERS = {"finqa": (finqa, FINQA), "convfinqa": (convfinqa, CONVFINQA), "tatqa": (tatqa, TATQA)}
