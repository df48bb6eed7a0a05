"""Queries that write tables as the files that users have, read them back and count what is there; files lie in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import ablation as AB
from ..operators import rates as R
from ..session import new_folder
from ..sources import archives, raw, readers, sinks
from .base import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "files")


_PATHS = ["result.json", "w.safetensors", "checkpoint-5/x.json", "old.zip", "last.ckpt", "checkpoints/step-1/a.json", "notes.ckpt.md", "my-checkpoints/a.json", "a/checkpoints", "w.bin/readme"]
_PACKED = "(o_orderkey % 10 IN (0, 6, 7, 9))"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per order, of ten kinds."""
    ends = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % len(_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), ends).alias("path"))


_EXAMPLES = "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS numbers, round(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END), 2) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS words FROM orders GROUP BY 1"


@query(_EXAMPLES)
def items_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as JSON lines where a split lies, and read back as that split; answers are numbers or words."""
    root = _folder(spark)
    answer = F.when(F.col("o_orderkey") % 3 > 0, F.parse_json(F.col("o_totalprice").cast("string"))).otherwise(F.parse_json(F.lit('"yes"')))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("context"), answer.alias("answer"), F.lit(1).alias("later_field"))
    sinks.write_lines(rows, readers.split_path(root, "finqa", "standard"))
    found = readers.load_dataset(spark, root, "finqa", "standard")
    return found.groupBy(F.col("context").alias("status")).agg(
        F.count("*").alias("n"), F.count("answer.num").alias("numbers"), F.round(F.sum("answer.num"), 2).alias("total"), F.count_if(F.col("answer.text") == "yes").alias("words")
    )


@query("SELECT * FROM (VALUES ('convfinqa', 'standard', false, 0), ('finqa', 'clean', true, 25), ('finqa', 'standard', false, 0), ('other', 'dev', false, 0), ('other', 'standard', false, 0), ('tatqa', 'control', false, 0)) v(dataset, split, available, n)")
def split_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which splits are there, when only the clean one is; a split that can't be read has no examples."""
    root = _folder(spark)
    sinks.write_lines(table(spark, sf_dir, "nation").select(F.col("n_name").alias("uid")), readers.split_path(root, "finqa", "clean"))
    asked = [("convfinqa", "standard"), ("finqa", "clean"), ("finqa", "standard"), ("other", "dev"), ("other", "standard"), ("tatqa", "control")]
    rows = [(d, s, readers.split_available(spark, root, d, s)[0], readers.examples_by_uid(spark, root, d, s).count()) for d, s in asked]
    return spark.createDataFrame(rows, "dataset string, split string, available boolean, n int")


@query(
    "SELECT c_mktsegment || '-' || c_nationkey AS exp_id, CAST(2 AS INT) AS lines, round(max(c_acctbal), 2) AS exact_match, CAST(CASE WHEN c_nationkey % 2 = 0 THEN 4 ELSE 1 END AS INT) AS n_gpus, "
    "CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey * 10.0 ELSE 0 END::DOUBLE AS train_s FROM customer GROUP BY c_mktsegment, c_nationkey"
)
def results_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of result lines appended to the log; the newest line of each run, with values from inside its `extra`."""
    runs = _folder(spark)
    cells = table(spark, sf_dir, "customer").groupBy(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("exp_id"), F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("best"))
    some = F.concat(F.lit('{"gpu": {"n_gpus": 4, "train_seconds": '), (F.col("k") * 10).cast("string"), F.lit("}}"))
    extra = F.parse_json(F.when(F.col("k") % 2 == 0, some).otherwise(F.lit('{"gpu": "none"}')))
    for stamp, em in ((1.0, F.lit(0.0)), (2.0, F.col("best"))):
        sinks.append_runs(cells.select("exp_id", em.alias("exact_match"), F.lit(stamp).alias("timestamp"), extra.alias("extra")), runs)
    log = readers.load_results(spark, runs)
    lines = log.groupBy("exp_id").agg(F.count("*").cast("int").alias("lines"))
    now = AB.current_runs(log).select("exp_id", F.round("exact_match", 2).alias("exact_match"), readers.nested(F.col("extra"), "gpu.n_gpus", "int", 1).alias("n_gpus"), readers.nested(F.col("extra"), "gpu.train_seconds", "double", 0.0).alias("train_s"))
    return lines.join(now, "exp_id")


@query(
    "WITH e AS (SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS v, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS small FROM orders), "
    "l AS (SELECT 'small first' AS log, *, small AS batch FROM e UNION ALL SELECT 'large first', *, 1 - small FROM e) "
    "SELECT log, o_custkey::VARCHAR AS exp_id, count(*) AS lines, arg_max(v, (batch, o_orderkey)) AS exact_match, max(batch + 1)::BIGINT AS commit FROM l GROUP BY ALL"
)
def log_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small and a large batch appended in either order, all lines with one timestamp: the later line of a run wins, by commit and by line."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("exp_id"), "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("exact_match"), F.lit(1.0).alias("timestamp"))
    found = []
    for name, small in (("small first", True), ("large first", False)):
        runs = _folder(spark)
        for few in (small, not small):
            batch = rows.where((F.col("o_orderstatus") == "P") == few)
            sinks.append_runs(batch.drop("o_orderstatus"), runs, "o_orderkey", copies=False)
        log = readers.load_results(spark, runs).select("exp_id", "timestamp", "ord", "exact_match")
        now = AB.current_runs(log, F.count("*").alias("lines"), F.max("ord.commit").alias("commit"))
        found.append(now.select(F.lit(name).alias("log"), "exp_id", "lines", "exact_match", "commit"))
    return found[0].unionByName(found[1])


@query("SELECT s_nationkey::VARCHAR AS exp_id, count(*) AS n, round(arg_max(s_acctbal, s_suppkey), 2) AS exact_match FROM supplier GROUP BY 1")
def run_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: each run's own copy of its last result; a batch that is appended again under its name changes neither the log nor the copies."""
    runs = _folder(spark)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("exp_id"), "s_suppkey", F.round("s_acctbal", 2).alias("exact_match"))
    sinks.append_runs(rows, runs, "s_suppkey", batch="0")
    sinks.append_runs(rows.withColumn("exact_match", F.lit(-1.0)), runs, "s_suppkey", batch="0")
    counts = readers.load_results(spark, runs).groupBy("exp_id").agg(F.count("*").alias("n"))
    return counts.join(readers.load_run_copies(spark, runs).select("exp_id", "exact_match"), "exp_id")


@query(
    "WITH last AS (SELECT l_returnflag || l_linestatus AS exp_id, l_orderkey, arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_quantity)) AS q FROM lineitem GROUP BY ALL) "
    "SELECT exp_id, count(*) AS n, count(*) FILTER (WHERE q > 25) AS correct FROM last GROUP BY 1"
)
def predictions_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of predictions per run, read back with the run from the folder; the last answer to a question counts, by the lines that were stored."""
    runs = _folder(spark)
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("exp_id"), F.col("l_orderkey").cast("string").alias("uid"), (F.col("l_quantity") > 25).alias("correct"), "l_shipdate", "l_linenumber", "l_partkey", "l_quantity")
    sinks.write_predictions(rows, runs, "l_shipdate", "l_linenumber", "l_partkey", "l_quantity")
    return readers.item_correctness(readers.load_predictions(spark, runs)).groupBy("exp_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query("SELECT c_custkey::VARCHAR AS exp_id, CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CAST(c_custkey % 2 AS INT) AS attempts FROM customer")
def states_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of states, half of them replaced by an upsert into a new one."""
    old, new = _folder(spark), _folder(spark)
    c = table(spark, sf_dir, "customer")
    state = lambda rows, status, attempts: rows.select(F.col("c_custkey").cast("string").alias("exp_id"), F.lit(status).alias("status"), attempts.cast("int").alias("attempts"))
    sinks.write_lines(state(c, "pending", F.lit(1)), old)
    sinks.upsert_states(readers.read_lines(spark, old, "exp_id string, status string, attempts int"), state(c.where("c_custkey % 2 = 0"), "completed", F.lit(0)), new)
    return readers.read_lines(spark, new, "exp_id string, status string, attempts int")


@query("SELECT s_suppkey::VARCHAR AS exp_id, CASE WHEN s_suppkey % 3 = 0 THEN 'completed' ELSE 'failed' END AS status, CAST(s_suppkey % 7 AS INT) AS attempts FROM supplier")
def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status file per run, saved in commits: a third of the runs twice; the last save of a run counts."""
    runs = _folder(spark)
    k = F.col("s_suppkey")
    state = lambda rows, status, tries: rows.select(k.cast("string").alias("exp_id"), status.alias("status"), tries.cast("int").alias("attempts"))
    all_runs = table(spark, sf_dir, "supplier")
    sinks.save_states(state(all_runs, F.lit("failed"), k % 7), runs)
    sinks.save_states(state(all_runs.where(k % 3 == 0), F.lit("completed"), k % 7), runs)
    return readers.load_states(spark, runs).select("exp_id", "status", "attempts")


@query("SELECT o_orderstatus AS arm, CAST(count(*) AS VARCHAR) AS n, o_orderpriority AS note FROM orders GROUP BY 1, 3")
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a result table as one CSV file with leading columns first, read back as text."""
    at = _folder(spark)
    sinks.write_csv(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("arm")).agg(F.count("*").alias("n")), at)
    found = spark.read.option("header", True).csv(at)
    if found.columns != ["arm", "n", "note"]:
        raise ValueError(found.columns)
    return found


_TOP = "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)"


@query(
    "SELECT c_nationkey::BIGINT AS nation, 'markdown' AS kind, '| name | n | em |' || chr(10) || '|---|---|---|' || coalesce(string_agg(chr(10) || '| ' || replace(c_name, '#', '/') || ' | ' || c_custkey || ' | 0.500 [0.250, 0.750] |', '' ORDER BY i) FILTER (WHERE i <= 5), '') AS text "
    f"FROM {_TOP} GROUP BY 1 UNION ALL SELECT c_nationkey::BIGINT, 'html', '<table><tr><th>seg</th><th>k</th></tr>' || string_agg('<tr><td>&lt;' || c_mktsegment || '&gt; &amp; &quot;&#x27;</td><td>' || c_custkey || '</td></tr>', '' ORDER BY i) FILTER (WHERE i <= 5) || '</table>' FROM {_TOP} GROUP BY 1"
)
def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for people of each nation's first customers, as Markdown with intervals, written and read back, and as escaped HTML."""
    c = table(spark, sf_dir, "customer")
    order = ["n"]
    rows = c.select(F.col("c_nationkey").alias("nation"), F.replace(F.col("c_name"), F.lit("#"), F.lit("|")).alias("name"), F.col("c_custkey").alias("n"), F.lit(0.5).alias("em"), F.lit(0.25).alias("em_lo"), F.lit(0.75).alias("em_hi"))
    at = _folder(spark)
    sinks.write_md(sinks.markdown_tables(rows, ["nation"], order, 5), at, "nation")
    found = spark.read.text(at, wholetext=True).select(F.col("nation").cast("long").alias("nation"), F.lit("markdown").alias("kind"), F.rtrim("value", F.lit("\n")).alias("text"))
    page = c.select(F.col("c_nationkey").cast("long").alias("nation"), F.concat(F.lit("<"), "c_mktsegment", F.lit("> & \"'")).alias("seg"), F.col("c_custkey").alias("k"))
    return found.unionByName(sinks.html_tables(page, ["nation"], ["k"], 5).select("nation", F.lit("html").alias("kind"), "text"))


@query(
    "SELECT o_orderstatus AS dataset, CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_verified FROM orders GROUP BY 1, 2 "
    "UNION ALL SELECT o_orderpriority, 'old', count(*), 0 FROM orders GROUP BY 1"
)
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of what was built now, over an earlier one, of which the data sets that weren't built stay."""
    orders = table(spark, sf_dir, "orders")
    program = lambda every: F.when(F.col("o_orderkey") % every == 0, "p").alias("gold_program")
    built = orders.select(F.col("o_orderstatus").alias("dataset"), F.when(F.col("o_orderkey") % 2 == 0, "dev").otherwise("test").alias("split"), program(3))
    before = orders.select(F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("dataset"), F.lit("old").alias("split"), F.lit(None).cast("string").alias("gold_program"))
    return readers.manifest_update(sinks.manifest_rows(before), sinks.manifest_rows(built))


@query("SELECT 'processed/finqa/dev.jsonl' AS file, sha256(string_agg('{\"uid\":\"' || r_name || '\"}' || chr(10), '' ORDER BY r_name)) AS sha256, '7' AS preprocess_version, 'abc' AS code_commit, CAST(1 AS BIGINT) AS files FROM region")
def data_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a split's file and the versions of its manifest, and the files of a name below a folder."""
    root = _folder(spark)
    sinks.write_lines(table(spark, sf_dir, "region").select(F.col("r_name").alias("uid")).coalesce(1).sortWithinPartitions("uid"), f"{root}/processed/finqa/dev.jsonl")
    spark.createDataFrame([('{"preprocess_version": "7", "code_commit": "abc"}',)], "value string").coalesce(1).write.text(f"{root}/data_manifest.json")
    parts = readers.find_files(spark, root, "part-*.json").where(F.contains("path", F.lit("/dev.jsonl/"))).agg(F.count("*").alias("files"))
    return readers.fingerprint(spark, root, "finqa", "dev").select(F.regexp_extract("file", r"^(.*\.jsonl)", 1).alias("file"), "sha256", "preprocess_version", "code_commit").crossJoin(parts)


def _finqa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order: the difference of price and key, of which every other one has another answer."""
    price, key = F.col("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")
    gold = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") - F.col("o_orderkey")).otherwise(F.col("o_totalprice"))
    grid = F.array(F.array(F.lit(""), F.lit("now")), F.array(F.lit("total"), price))
    report = [F.lit("f").alias("filename"), F.array(F.lit("One .")).alias("pre_text"), F.array(F.lit("Two")).alias("post_text"), grid.alias("table")]
    return table(spark, sf_dir, "orders").select("o_orderstatus", *report, F.concat(F.lit("o_"), key).alias("id"), F.concat(F.lit("subtract("), price, F.lit(", "), key, F.lit(")")).alias("program"), F.parse_json(gold.cast("string")).alias("gold"))


_VERIFIED = "(o_orderkey % 2 = 0 OR o_orderkey <= greatest(1e-4, 1e-3 * greatest(abs(o_totalprice), 1)))"


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_VERIFIED}) AS verified, count(*) FILTER (WHERE {_VERIFIED}) AS programs, count(*) AS cells, count(*) AS evidence FROM orders")
def raw_finqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records built from raw ones; the program stays where its value is the gold answer, and the cells that it reads are found."""
    qa = F.struct(F.lit("q").alias("question"), "program", F.col("gold").alias("exe_ans"), F.lit("a").alias("answer"), F.create_map(F.lit("table_1"), F.lit("t")).alias("gold_inds"))
    made = raw.finqa(_finqa_rows(spark, sf_dir).withColumn("qa", qa))
    return made.agg(F.count("*").alias("n"), F.count_if("program_verified").alias("verified"), F.count("gold_program").alias("programs"), F.sum(F.size("table_cells")).alias("cells"), F.count_if(F.col("extra.gold_inds")[0] == "table_1").alias("evidence"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_VERIFIED}) AS verified, count(*) AS asked, count(*) AS earlier, count(DISTINCT o_orderkey) AS conversations FROM orders")
def raw_convfinqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per turn, with the question of the turn and what came before."""
    annotation = F.struct(
        F.array(F.lit("q0"), F.lit("q1")).alias("cur_dial"), F.array(F.parse_json(F.lit("5.0")), F.col("gold")).alias("exe_ans_list"), F.col("program").alias("cur_program"), F.col("gold").alias("exe_ans"), F.lit("program").alias("cur_type"), F.lit(False).alias("qa_split")
    )
    made = raw.convfinqa(_finqa_rows(spark, sf_dir).withColumn("id", F.concat("id", F.lit("_1"))).withColumn("annotation", annotation))
    earlier = (F.size("extra.history") == 1) & (F.col("extra.history")[0]["question"] == "q0") & (F.col("extra.history")[0]["answer"]["num"] == 5.0)
    return made.agg(F.count("*").alias("n"), F.count_if("program_verified").alias("verified"), F.count_if((F.col("question") == "q1") & (F.col("extra.turn_index") == 1)).alias("asked"), F.count_if(earlier).alias("earlier"), F.countDistinct("extra.conversation_id").alias("conversations"))


@query(
    "SELECT p_partkey % 3 AS kind, count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS verified, sum(CASE p_partkey % 3 WHEN 0 THEN p_partkey + p_size WHEN 2 THEN 7 END)::DOUBLE AS total, "
    "count(*) FILTER (WHERE p_partkey % 3 = 1) AS spans, sum(CASE WHEN p_partkey % 3 = 0 THEN (p_partkey <> 100)::INT + (p_size <> 100)::INT ELSE 0 END)::BIGINT AS cells, count(*) AS ordered FROM part GROUP BY 1"
)
def raw_tatqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from documents with questions of three kinds; derivations become programs, paragraphs keep their order."""
    s = lambda c: F.col(c).cast("string")
    k = F.col("p_partkey") % 3
    grid = F.array(F.array(F.lit(""), F.lit("fy")), F.array(F.lit("a"), s("p_partkey")), F.array(F.lit("b"), s("p_size")))
    answer = F.when(k == 0, F.parse_json((F.col("p_partkey") + F.col("p_size")).cast("string"))).when(k == 1, F.parse_json(F.lit('["x", "y"]'))).otherwise(F.parse_json(F.lit('"7"')))
    kind = F.when(k == 0, "arithmetic").when(k == 1, "multi-span").otherwise("count")
    q = F.struct(s("p_partkey").alias("uid"), F.lit(1).alias("order"), F.lit("?").alias("question"), answer.alias("answer"), F.concat(F.lit("["), s("p_partkey"), F.lit(" + $"), s("p_size"), F.lit("]")).alias("derivation"), kind.alias("answer_type"), F.lit("table").alias("answer_from"), F.lit("").alias("scale"), F.lit(False).alias("req_comparison"))
    paragraph = lambda n, t: F.struct(F.lit(t).alias("uid"), F.lit(n).alias("order"), F.lit(t).alias("text"))
    made = raw.tatqa(table(spark, sf_dir, "part").select(F.struct(F.lit("t").alias("uid"), grid.alias("table")).alias("table"), F.array(paragraph(2, "two"), paragraph(1, "one")).alias("paragraphs"), F.array(q).alias("questions")))
    return made.groupBy((F.col("uid").cast("long") % 3).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if("program_verified").alias("verified"), F.sum("answer.num").alias("total"), F.count_if(F.col("answer.text") == "x; y").alias("spans"),
        F.sum(F.size("table_cells")).alias("cells"), F.count_if(F.endswith("context", F.lit("one\ntwo"))).alias("ordered"),
    )


@query("SELECT c_custkey::VARCHAR AS uid, c_mktsegment AS question, round(c_acctbal, 2) AS num FROM customer")
def raw_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of one JSON array each, written into zip archives and read back as the examples of the builder that is registered for them."""
    at = _folder(spark)
    report = [F.lit("f").alias("filename"), F.array(F.lit("")).alias("pre_text"), F.array(F.lit("")).alias("post_text"), F.array(F.array(F.lit("x"))).alias("table")]
    qa = F.struct(F.col("c_mktsegment").alias("question"), F.lit("").alias("program"), F.round("c_acctbal", 2).alias("exe_ans"), F.lit("").alias("answer"))
    record = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), *report, qa.alias("qa")))
    # Each file holds the customers of one nation; a block of keys bounds what one file gathers.
    files = table(spark, sf_dir, "customer").select("c_nationkey", F.floor(F.col("c_custkey") / 10_000).alias("block"), record.alias("r")).groupBy("c_nationkey", "block")
    content = F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]"))
    archives.write_members(files.agg(content.alias("content")).select(F.concat_ws("/", "c_nationkey", F.concat("block", F.lit(".json"))).alias("path"), "content"), at)
    return archives.build(spark, "finqa", at, zipped=True).select("uid", "question", F.col("answer.num").alias("num"))


@query(f"SELECT o_orderpriority AS kind, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE {_PACKED} GROUP BY 1")
def packed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packable files of a listing in archives, read back member by member."""
    at = _folder(spark)
    files = _listing(spark, sf_dir).select("path", F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("content"))
    archives.pack_outputs(files, at, 4)
    said = F.split(F.col("content").cast("string"), r"\|")
    found = archives.read_members(spark, at).select(said[0].alias("kind"), said[1].cast("long").alias("key"), F.split("member", "/")[0].cast("long").alias("folder"))
    return found.where("key = folder").groupBy("kind").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1 END::INT AS epochs, CASE WHEN p_partkey % 2 = 0 THEN (p_retailprice::VARCHAR || 'e-4')::DOUBLE ELSE 0.1::DOUBLE END AS rate, p_partkey % 5 > 0 AS flag, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS teacher FROM part"
)
def config_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs over their defaults; number texts take the default's type, unknown fields drop."""
    k, s = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    given = F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ["epochs", "rate", "flag", "teacher", "odd"])),
            F.array(F.when(k % 3 == 0, F.concat(s("p_size"), F.lit(".0"))), F.when(k % 2 == 0, F.concat((F.col("p_retailprice")).cast("string"), F.lit("e-4"))), F.when(k % 5 == 0, F.lit("false")), F.when(k % 7 == 0, F.col("p_brand")), F.lit("x")),
        ),
        lambda _, v: v.isNotNull(),
    )
    found = table(spark, sf_dir, "part").select("p_partkey", *readers.config_fields(given, {"epochs": 1, "rate": 0.1, "flag": True, "teacher": None}))
    return found


@query(
    "SELECT s_name AS model, s_suppkey % 3 = 0 AS large, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 4) / 4::DOUBLE END AS usd, CASE WHEN s_suppkey % 5 > 0 THEN (s_suppkey % 5) / 8::DOUBLE ELSE 0.1 END AS answers_per_s, count(*) AS parts FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL"
)
def setting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, speed and model tables as settings files, loaded and joined to runs; a run whose model isn't in the table would be an error."""
    at, k = _folder(spark), F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    one = lambda head, entry: suppliers.agg(F.concat(F.lit(f"# a comment: not: a key\n{head}:   # below\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n"), F.lit("\n")).alias("value"))
    name = F.col("s_name")
    price = F.when(k % 4 > 0, (k % 4 / 4).cast("string")).otherwise("null")
    one("gpus", F.concat(F.lit("  "), name, F.lit(":\n    usd_per_gpu_hour: "), price, F.lit('\n    source: ""  # none'))).write.text(f"{at}/pricing")
    one("answers_per_s", F.concat(F.lit("  "), name, F.lit(": "), F.when(k % 5 > 0, F.concat(F.lit("{answer: "), (k % 5 / 8).cast("string"), F.lit(",  cot: 9}"))).otherwise("{}"))).write.text(f"{at}/speeds")
    one("models", F.concat(F.lit("  "), name, F.lit(':\n    tier: "'), F.when(k % 3 == 0, "large").otherwise("student"), F.lit("\"\n    size_b: 3.0"))).write.text(f"{at}/models")
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("parts")).join(suppliers.select("s_suppkey", name.alias("model")), "s_suppkey")
    found = readers.with_model(runs, readers.load_models(spark, f"{at}/models"))
    prices = readers.load_prices(spark, f"{at}/pricing").select(F.col("gpu_key").alias("model"), F.col("usd_per_gpu_hour").alias("usd"))
    rate = costs.answer_speed(F.coalesce("speeds", F.create_map().cast("map<string,double>")), F.lit("pot"))
    both = found.join(prices, "model", "left").join(readers.load_speeds(spark, f"{at}/speeds"), "model", "left")
    return both.select("model", (F.col("fields")["tier"] == "large").alias("large"), "usd", rate.alias("answers_per_s"), "parts")


@query(
    "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE abs(l_quantity - o_custkey % 50) <= greatest(1e-4, 1e-3 * greatest(abs(o_custkey % 50), 1)) OR abs(l_quantity - o_custkey % 50) <= greatest(1e-4, 0.01 * abs(o_custkey % 50))) AS correct, "
    "count(*) FILTER (WHERE abs(l_quantity - o_custkey % 50) <= greatest(1e-4, 1e-3 * greatest(abs(o_custkey % 50), 1))) AS strict FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 > 0 GROUP BY 1"
)
def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, several of a question among them, joined to gold answers, of which a third are missing."""
    number = lambda c: F.struct(c.cast("double").alias("num"), F.lit(None).cast("string").alias("text"))
    predictions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), number(F.col("l_quantity")).alias("pred"))
    gold = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("uid"), "o_orderstatus", number(F.col("o_custkey") % 50).alias("gold"))
    return R.scored(predictions, gold).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if("correct_strict").alias("strict"))
