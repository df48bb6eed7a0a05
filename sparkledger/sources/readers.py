"""Readers of stored items, runs and states (S1-S8, S15-S23, S26-S28). Paths are anything that Spark reads.

Files are read with fixed schemas, so unknown fields drop and missing ones are null; the modes say what a damaged line does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ledger

EXAMPLE = (
    "uid string, question string, context string, answer variant, gold_program string, table_cells array<struct<row:int,col:int,text:string>>,"
    " meta struct<dataset:string,source_split:string,answer_text:string,gold_inds:array<string>,program_dsl:string,program_verified:boolean,filename:string,table:array<array<string>>,"
    "conversation_id:string,turn_index:int,history:array<struct<question:string,answer:variant>>,turn_type:string,qa_split:string,answer_type:string,answer_from:string,scale:string,derivation:string>"
)
RUN = (
    "exp_id string, name string, arm string, model string, split string, dataset string, seed int, exact_match double, exact_match_strict double, execution_accuracy double, executability_rate double,"
    " faithfulness_primary double, faithfulness_proxy double, train_flops double, infer_flops double, wall_time_s double, timestamp double, n_examples int, model_size_b double, gpu string, git_commit string,"
    " cost_usd double, config variant, extra variant"
)
PREDICTION = "uid string, gold variant, pred variant, correct boolean, correct_strict boolean, percent_form boolean, text string, program string, exec_value variant, prompt_tokens bigint, gen_tokens bigint"
STATE = "exp_id string, name string, status string, last_error string, host string, metrics_path string, attempts int, max_attempts int, pid int, first_seen double, last_update double"
# The file that each data set's `standard` split is.
STANDARD = {"finqa": "test", "convfinqa": "dev", "tatqa": "test"}

#: The most models that an error names.
NAMED = 1000


def split_path(root: str, dataset: str, split: str) -> str:
    """Where a split is stored; `clean` and `control` belong to no data set."""
    if split in ("clean", "control"):
        return f"{root}/clean_set/{split}.jsonl"
    if split == "standard":
        if dataset not in STANDARD:
            raise ValueError(f"unknown data set {dataset!r}")
        split = STANDARD[dataset]
    if split not in ("train", "dev", "test"):
        raise ValueError(f"unknown split {split!r}")
    return f"{root}/processed/{dataset}/{split}.jsonl"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) not in (None, []) and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def split_available(spark: SparkSession, root: str, dataset: str, split: str) -> tuple[bool, str]:
    """S3: whether a split is there, and if not why; never raises."""
    try:
        path = split_path(root, dataset, split)
    except ValueError as e:
        return False, str(e)
    return (True, "") if exists(spark, path) else (False, f"{path} doesn't exist")


def answer(v: Column) -> Column:
    """A variant answer as struct<num, text>: numbers as doubles, all else as text."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.when(~kind.isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(v, "$", "double"))
    shown = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    return F.struct(number.alias("num"), F.when(number.isNull(), shown).alias("text"))


def nested(v: Column, path: str, kind: str, default: object = None) -> Column:
    """L1: a value inside a variant by its dotted path, as a Spark type; the default where it is missing or of another type."""
    found = F.try_variant_get(v, "$." + path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def read_lines(spark: SparkSession, path: str, schema: str, damaged: str = "FAILFAST") -> DataFrame:
    """JSON lines. damaged: FAILFAST, or DROPMALFORMED to leave such lines out. A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", damaged).json(path)


def load_dataset(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """The examples of a split; FileNotFoundError if it isn't there."""
    ok, why = split_available(spark, root, dataset, split)
    if not ok:
        raise FileNotFoundError(f"{dataset}/{split}: {why}; prepare the data first")
    return spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(split_path(root, dataset, split)).withColumn("answer", answer(F.col("answer")))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON document; no row if it is missing or damaged."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _damaged string").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(path).where("_damaged is null").drop("_damaged")


def _run_of(path: Column) -> Column:
    """The run's folder: above the predictions, one file or a folder of parts, or the partition's value."""
    return F.regexp_extract(path, r"/(?:exp_id=)?([^/]+)(?:/predictions\.jsonl)?/[^/]+$", 1)


def _counted(spark: SparkSession, runs: str, rows: DataFrame) -> DataFrame:
    """Rows of files that the ledger committed, and of files that it didn't write; `ord` is a row's place (see ledger.place)."""
    part = F.regexp_extract(F.col("_metadata.file_name"), ledger.PART, 1)
    commits = ledger.parts(spark, runs, exists(spark, f"{runs}/{ledger.COMMITS}/*.json"))
    # The place is taken before the join: a row's number in its block is only known where the block is read.
    placed = rows.select("*", part.alias("part"), ledger.place(F.col("line")).alias("_place"))
    joined = placed.join(commits, "part", "left").where("part = '' or commit is not null")
    return joined.withColumn("ord", F.col("_place").withField("commit", F.coalesce("commit", F.lit(0).cast("long")))).drop("part", "_place", "commit", "line")


def load_results(spark: SparkSession, runs: str) -> DataFrame:
    """The log of runs, appended by the ledger or a plain file; `ord` is a line's place in it, whatever the sizes of its files."""
    if not exists(spark, f"{runs}/results.jsonl"):
        return spark.createDataFrame([], f"{RUN}, ord {ledger.PLACE}")
    return _counted(spark, runs, spark.read.schema(f"{RUN}, line bigint").option("mode", "FAILFAST").json(f"{runs}/results.jsonl"))


def load_run_copies(spark: SparkSession, runs: str) -> DataFrame:
    """K1: each run's own copy of its result, the last one committed."""
    if not exists(spark, f"{runs}/*/result/*.json"):
        return spark.createDataFrame([], RUN)
    found = _counted(spark, runs, spark.read.schema(f"{RUN}, line bigint").json(f"{runs}/*/result/*.json"))
    return _newest(found)


def _newest(found: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c != "ord"]
    return found.groupBy("exp_id").agg(F.max_by(F.struct(*rest), "ord").alias("_row")).select("_row.*")


def load_states(spark: SparkSession, runs: str) -> DataFrame:
    """The state of every run, by run: the last one that the ledger committed, or else a plain status file; damaged ones are left out."""
    damaged = "_damaged string"
    read = lambda path, more: spark.read.schema(f"{STATE}, {more}{damaged}").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(path)
    found = []
    if exists(spark, f"{runs}/*/status/*.json"):
        found.append(_counted(spark, runs, read(f"{runs}/*/status/*.json", "line bigint, ")))
    if exists(spark, f"{runs}/*/status.json"):
        found.append(_counted(spark, runs, read(f"{runs}/*/status.json", "").withColumn("line", F.lit(None).cast("long"))))
    if not found:
        return spark.createDataFrame([], STATE)
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return _newest(both.where("_damaged is null").drop("_damaged")).orderBy("exp_id")


def load_predictions(spark: SparkSession, runs: str) -> DataFrame:
    """The predictions of all runs, with exp_id from the folder (as write_predictions names it, or the run's own); damaged lines are left out.

    `ord` is a line's place: the line that write_predictions stored, or else the file's path, the block and the row in it."""
    paths = [p for p in (f"{runs}/*/predictions.jsonl", f"{runs}/exp_id=*") if exists(spark, p)]
    kinds = {c: answer(F.col(c)) for c in ("gold", "pred", "exec_value")}
    if not paths:
        return spark.createDataFrame([], f"{PREDICTION}, exp_id string, ord struct<line:bigint,path:string,block:bigint,row:bigint>").withColumns(kinds)
    rows = spark.read.schema(f"{PREDICTION}, line bigint").option("mode", "DROPMALFORMED").json(paths)
    own = lambda c: F.when(F.col("line").isNull(), c)
    at = F.struct("line", own(F.col("_metadata.file_path")).alias("path"), own(F.col("_metadata.file_block_start")).alias("block"), own(F.monotonically_increasing_id()).alias("row"))
    return rows.select("*", _run_of(F.col("_metadata.file_path")).alias("exp_id"), at.alias("ord")).drop("line").withColumns(kinds)


def item_correctness(predictions: DataFrame) -> DataFrame:
    """exp_id, uid, correct; of repeated ids the last line counts."""
    return predictions.groupBy("exp_id", "uid").agg(F.max_by("correct", "ord").alias("correct"))


def examples_by_uid(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """The examples of a split, or none if it can't be read."""
    ok, _ = split_available(spark, root, dataset, split)
    return load_dataset(spark, root, dataset, split) if ok else spark.createDataFrame([], EXAMPLE).withColumn("answer", answer(F.col("answer")))


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """Path, bytes and SHA-256 of files."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"), "modificationTime")


def fingerprint(spark: SparkSession, root: str, dataset: str, split: str, manifest: str = "data_manifest.json") -> DataFrame:
    """File, sha256 and the versions of the manifest (null without one)."""
    versions = read_document(spark, f"{root}/{manifest}", "preprocess_version string, code_commit string")
    own = file_hashes(spark, split_path(root, dataset, split)).select(F.regexp_extract("path", r"((?:processed|clean_set)/.*)$", 1).alias("file"), "sha256")
    return own.join(F.broadcast(versions.limit(1)), F.lit(True), "left")


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Files of a name anywhere below root, the newest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return found.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def config_row(defaults: dict, given: dict) -> dict:
    """A config from defaults and what is given: unknown fields are dropped, number texts take the default's type; null and yes/no defaults don't."""
    out = dict(defaults)
    for k in defaults.keys() & given.keys():
        v, d = given[k], defaults[k]
        out[k] = type(d)(float(v)) if isinstance(v, str) and type(d) is int else float(v) if isinstance(v, str) and type(d) is float else v
    return out


def config_fields(given: Column, defaults: dict) -> list[Column]:
    """As config_row, for a column of given fields (map<string,string>): a column for each default, of its type; text where the default is null."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "string"}

    def field(name: str, d: object) -> Column:
        v = F.try_element_at(given, F.lit(name))
        typed = v.cast("double").cast("int") if type(d) is int else v.cast(kinds[type(d)])
        return F.coalesce(typed, F.lit(d).cast(kinds[type(d)])).alias(name)

    return [field(k, d) for k, d in defaults.items()]


def settings(spark: SparkSession, path: str) -> DataFrame:
    """The entries of settings files (indented `key: value` lines, as price, speed and model tables are written): path, n (the line), k1, k2, k3 and value.

    An inline map gives an entry for each of its keys. Comments, quotes and empty values are taken off; a key without a value heads those below it."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    bare = F.regexp_extract("line", r"""^((?:[^"'#]|"[^"]*"|'[^']*'|(?<=\S)#)*)""", 1)
    found = lines.select("path", "n", F.length(F.regexp_extract(bare, r"^( *)", 1)).alias("depth"), F.regexp_extract(bare, r"^ *([^\s:#][^:]*):(?:\s|$)", 1).alias("key"), F.trim(F.regexp_extract(bare, r"^ *[^\s:#][^:]*:(?:\s+(.*))?$", 1)).alias("v")).where("key <> ''")
    level = F.when(F.col("depth") == 0, 1).when(F.col("depth") <= 2, 2).otherwise(3)
    above = Window.partitionBy("path").orderBy("n")
    heads = found.withColumn("level", level)
    k1 = F.last(F.when(F.col("level") == 1, F.col("key")), True).over(above)
    k2 = F.last(F.when(F.col("level") == 2, F.col("key")), True).over(above)
    named = heads.select("path", "n", "level", "key", "v", k1.alias("k1"), F.when(F.col("level") >= 2, k2).alias("k2"))
    inline = F.regexp_extract("v", r"^\{(.*)\}$", 1)
    pairs = F.transform(F.split(inline, ","), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring_index(x, ":", -1)).alias("v")))
    own = F.array(F.struct(F.when(F.col("level") == 3, F.col("key")).alias("k"), F.col("v").alias("v")))
    flat = named.select("path", "n", "k1", "k2", F.explode(F.when(inline != "", pairs).otherwise(own)).alias("e"))
    value = F.regexp_replace("e.v", "^[\"'](.*)[\"']$", "$1")
    return flat.select("path", "n", "k1", "k2", F.col("e.k").alias("k3"), F.when(~value.isin("", "null", "~", "{}"), value).alias("value"))


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """gpu_key, usd_per_gpu_hour (null: not priced) and ord of a price list; none if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "gpu_key string, usd_per_gpu_hour double, ord int")
    rows = settings(spark, path).where("k1 = 'gpus' and k2 is not null")
    return rows.groupBy(F.col("k2").alias("gpu_key")).agg(F.max(F.when(F.col("k3") == "usd_per_gpu_hour", F.col("value").cast("double"))).alias("usd_per_gpu_hour"), F.min("n").alias("ord"))


def load_speeds(spark: SparkSession, path: str, table: str = "answers_per_s") -> DataFrame:
    """Model and its speeds by style (map<string,double>; the key is '' where there is one speed) of a table of speeds."""
    rows = settings(spark, path).where((F.col("k1") == table) & F.col("k2").isNotNull() & F.col("value").isNotNull())
    return rows.groupBy(F.col("k2").alias("model")).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("k3", F.lit("")), F.col("value").cast("double")))).alias("speeds"))


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Model and its fields (map<string,string>) of a model table."""
    rows = settings(spark, path).where("k1 = 'models' and k3 is not null")
    return rows.groupBy(F.col("k2").alias("model")).agg(F.map_from_entries(F.collect_list(F.struct("k3", "value"))).alias("fields"))


def with_model(rows: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """Rows with the fields of their model; a model that isn't in the table is an error that names those that are (of a longer table the first `NAMED`).

    An equi-join: a row costs one lookup however many models there are, and Spark sends a short table to all tasks."""
    first = models.select("model").orderBy("model").limit(NAMED + 1).agg(F.array_sort(F.collect_list("model")).alias("_names"))
    names = F.concat(F.array_join(F.slice("_names", 1, NAMED), ", "), F.when(F.size("_names") > NAMED, F.lit(", ...")).otherwise(F.lit("")))
    missing = F.raise_error(F.concat(F.lit("unknown model '"), F.coalesce(F.col(model), F.lit("")), F.lit("'; known: "), names))
    twice = F.raise_error(F.concat(F.lit("model '"), F.col("model"), F.lit("' is there twice")))
    once = models.groupBy("model").agg(F.first("fields").alias("_fields"), F.count("*").alias("_n"))
    known = once.select(F.col("model").alias("_model"), F.when(F.col("_n") > 1, twice).otherwise(F.col("_fields")).alias("_fields"))
    found = rows.join(known, F.col(model) == F.col("_model"), "left").crossJoin(F.broadcast(first))
    return found.withColumn("fields", F.when(F.col("_fields").isNull(), missing).otherwise(F.col("_fields"))).drop("_model", "_fields", "_names")


def manifest_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """The previous manifest's rows (dataset, split, ...), replaced for the data sets that were built now."""
    return old.join(new.select("dataset").distinct(), "dataset", "left_anti").unionByName(new)
