"""Queries over plans, runs, states, costs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs, ids
from ..functions import numbers as N
from ..operators import breakdown as B
from ..operators import latest as L
from ..operators import planning as P
from ..operators import predict, registry, roadmap
from ..session import new_folder
from ..streaming import runs as streams
from ..streaming import sessions
from .base import long, table

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


@query("SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_shipdate DESC, l_partkey DESC, l_suppkey DESC")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of the rows of a key, with a total order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    best = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("r"))
    return best.select("l_orderkey", "l_linenumber", F.date_format("r.l_shipdate", "yyyy-MM-dd").alias("shipped"), "r.l_partkey", "r.l_suppkey")


@query("SELECT DISTINCT ON (l_suppkey) l_suppkey, l_orderkey, l_partkey, l_linenumber FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber")
    return L.first_per_key(rows, ["l_suppkey"], F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8."""
    return L.top_per_key(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey"))


_LINES = "SELECT c_mktsegment || '/' || c_nationkey AS line FROM customer WHERE c_custkey % 2 = {k}"


@query(f"WITH t AS ({_LINES.format(k=0)}), s AS ({_LINES.format(k=1)}) SELECT line, count(*) AS n FROM (SELECT line FROM t UNION ALL SELECT line FROM s WHERE line NOT IN (SELECT line FROM t)) GROUP BY 1")
def merge_new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a source that the target doesn't have; duplicates inside the source stay."""
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("line"))
    target, source = (lines.where(F.col("c_custkey") % 2 == k).select("line") for k in (0, 1))
    return L.merge_new(target, source, "line").groupBy("line").agg(F.count("*").alias("n"))


@query(
    "SELECT DISTINCT ON (path) path, src, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM (SELECT s_nationkey AS path, s_suppkey % 3 AS src, CASE s_suppkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, s_suppkey FROM supplier) ORDER BY path, src, s_suppkey"
)
def restore_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by priority; the first that has a path wins, and what was running has failed."""
    k = F.col("s_suppkey")
    status = F.when(k % 4 == 0, "running").when(k % 4 == 1, "completed").otherwise("failed")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path"), (k % 3).alias("src"), status.alias("status"), "s_suppkey")
    own = [L.first_per_key(rows.where(F.col("src") == i), ["path"], F.col("s_suppkey")) for i in range(3)]
    return L.restore(own, ["path"]).select("path", "src", "status")


@query("SELECT DISTINCT ON (k) k, part FROM (SELECT o_custkey AS k, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT c_custkey, 2 FROM customer) ORDER BY k, part")
def suite_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of three lists, each key once, from the first list that has it."""
    orders = table(spark, sf_dir, "orders")
    parts = [orders.where(side).select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderkey").alias("ord")) for side in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    parts.append(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment_id"), F.col("c_custkey").alias("ord")))
    return P.union_suites(parts).select(F.col("experiment_id").alias("k"), F.col("position._part").alias("part"))


@query("SELECT o_custkey AS uid FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def uid_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2."""
    return L.in_all(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), "o_orderstatus"), "uid", "o_orderstatus")


@query("SELECT k, s, a, b FROM (SELECT n_nationkey AS k, 'n' AS s, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, 'r', NULL, r_name FROM region)")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different shapes under one header."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit("n").alias("s"), F.col("n_name").alias("a"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.lit("r").alias("s"), F.col("r_name").alias("b"))
    return L.union_by_name([n, r], ["k", "s"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE p_size END AS p_size FROM part")
def overlay_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields overridden where the overlay has a value."""
    k = F.col("p_partkey")
    return L.overlay(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), {"p_brand": F.when(k % 3 == 0, "X"), "p_size": F.when(k % 5 == 0, F.lit(7))})


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ring", None, 0), ("RED", 2.0, 1), ("widget", 3.0, 2), ("e", 4.0, 3)], "gpu_key string, usd_per_gpu_hour double, ord int")


_PRICE = "CASE WHEN contains(lower(p_name), 'ring') THEN NULL WHEN contains(lower(p_name), 'red') THEN 2 WHEN contains(lower(p_name), 'widget') THEN 3 WHEN contains(lower(p_name), 'e') THEN 4 END::DOUBLE"


@query(f"SELECT p_partkey, {_PRICE} AS usd FROM part")
def gpu_price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key that is part of a name gives the price, even if it has none."""
    return costs.with_gpu_price(table(spark, sf_dir, "part"), _prices(spark), "p_name").select("p_partkey", F.col("usd_per_gpu_hour").alias("usd"))


@query(f"SELECT p_type AS type, count(*) AS n, count(c) AS priced, round(sum(c), 2) AS usd FROM (SELECT p_type, round({_PRICE} * CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size % 3 END * (p_retailprice + p_size) / 3600, 4) AS c FROM part) GROUP BY 1")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of runs; no GPUs count as one, no price is no cost."""
    rows = costs.with_gpu_price(table(spark, sf_dir, "part"), _prices(spark), "p_name")
    cost = costs.run_cost(F.col("usd_per_gpu_hour"), F.col("p_size") % 3, F.col("p_retailprice"), F.col("p_size").cast("double"))
    return rows.select("p_type", cost["total_usd"].alias("c")).groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"), F.count("c").alias("priced"), F.round(F.sum("c"), 2).alias("usd"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice WHEN p_partkey % 3 = 0 THEN 5.0::DOUBLE ELSE 0.1::DOUBLE END AS rate FROM part")
def price_lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style's own entry, the answer style's, or the default."""
    k = F.col("p_partkey")
    entries = F.when(k % 2 == 0, F.create_map(F.lit("pot"), F.col("p_retailprice"), F.lit("answer"), F.lit(5.0))).when(k % 3 == 0, F.create_map(F.lit("answer"), F.lit(5.0)))
    return table(spark, sf_dir, "part").select("p_partkey", costs.answer_speed(F.coalesce(entries, F.create_map().cast("map<string,double>")), F.lit("pot")).alias("rate"))


#: Arms that take part, with their priority; the rest have none.
_LEVELS = [("M", ["A5", "A6"]), ("S", ["A1", "A3"])]


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan from the tables: arms from customers, models from suppliers, seeds from line numbers, splits from order statuses."""
    arm = F.concat(F.lit("A"), (F.col("c_nationkey") % 8 + 1).cast("string")).alias("arm")
    k = F.col("s_suppkey")
    tier = F.when(k % 3 == 0, "large").when(k % 3 == 1, "student")
    arms = table(spark, sf_dir, "customer").select(arm, "c_nationkey")
    models = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), tier.alias("tier"), (k % 10 == 9).alias("phase2_only"), (k % 40).cast("double").alias("size_b"), (F.lit(100.0) + k % 50).alias("train_tokens_per_s"), "s_suppkey")
    seeds = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("seed"))
    splits = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "clean").when(F.col("o_orderstatus") == "O", "standard").otherwise("dev").alias("split"))
    axes = {"arm": (arms, "arm"), "model": (models, "s_suppkey"), "seed": (seeds, "seed"), "split": (splits, "split")}
    role = F.when(F.col("arm").isin("A3", "A4"), "large").otherwise("student")
    roles = arms.select("arm").distinct().withColumns({"role": role, "inference": F.when(F.col("arm").isin("A2", "A4"), "fewshot").otherwise("greedy")})
    priority = P.priorities(spark.createDataFrame(_LEVELS, "level string, arms array<string>"))
    found = P.compatible(P.grid_of(axes), roles, models.drop("s_suppkey"), 1, priority)
    return found.withColumns({"experiment_id": F.concat_ws("-", "arm", "model", "seed", "split"), "training_id": F.concat_ws("-", "arm", "model", "seed")})


_GRID = (
    "a AS (SELECT arm, row_number() OVER (ORDER BY arm) - 1 AS i FROM (SELECT DISTINCT 'A' || (c_nationkey % 8 + 1) AS arm FROM customer)), "
    "m AS (SELECT s_name AS model, s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), "
    "s AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS i FROM (SELECT DISTINCT l_linenumber - 1 AS seed FROM lineitem)), "
    "p AS (SELECT split, row_number() OVER (ORDER BY split) - 1 AS i FROM (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'clean' WHEN 'O' THEN 'standard' ELSE 'dev' END AS split FROM orders)), "
    "g AS (SELECT ((a.i * (SELECT count(*) FROM m) + m.i) * (SELECT count(*) FROM s) + s.i) * (SELECT count(*) FROM p) + p.i AS ord, arm, model, k, seed, split, arm || '-' || model || '-' || seed || '-' || split AS experiment_id, "
    "CASE WHEN arm IN ('A5', 'A6') THEN 'M' WHEN arm IN ('A1', 'A3') THEN 'S' ELSE '' END AS priority FROM a, m, s, p "
    "WHERE (arm IN ('A3', 'A4')) = (k % 3 = 0) AND k % 10 <> 9 AND (arm IN ('A5', 'A6', 'A7', 'A8') OR seed = 0))"
)


@query(f"WITH {_GRID} SELECT ord::BIGINT AS ord, arm, model, seed::BIGINT AS seed, split, priority FROM g")
def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinations of a plan that fit together."""
    return _plan(spark, sf_dir).select("ord", "arm", "model", F.col("seed").cast("long").alias("seed"), "split", "priority")


@query(f"WITH {_GRID} SELECT experiment_id, CAST(row_number() OVER (ORDER BY CASE priority WHEN 'M' THEN 0 WHEN 'S' THEN 1 ELSE 3 END, seed, ord) - 1 AS INT) AS position FROM g")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run order of a plan."""
    return P.run_order(_plan(spark, sf_dir), 1000).select("experiment_id", "position")


@query(
    f"WITH {_GRID}, t AS (SELECT count(*) AS a, sum(1100.0::DOUBLE * 6000 * 2 / (100.0::DOUBLE + k % 50) / 3600 + 4 * 200 / 0.5::DOUBLE / 3600 + 0.03) AS h FROM (SELECT DISTINCT arm, model, k, seed FROM g WHERE arm IN ('A5', 'A6', 'A7', 'A8'))), "
    "e AS (SELECT count(*) AS n, sum(1147 / (0.5::DOUBLE * CASE WHEN arm IN ('A2', 'A4') THEN 0.35 ELSE 1 END) / 3600 + 0.03) AS h FROM g) "
    "SELECT a AS adapters, n AS evaluations, round(t.h, 1) AS train, round(e.h, 1) AS eval, round(t.h + e.h, 1) AS total FROM t, e"
)
def plan_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a plan; each adapter is trained once."""
    none = F.lit(None).cast("double")
    fields = {"tokens_per_question": none, "train_examples": F.lit(None).cast("int"), "train_questions": F.lit(None).cast("int"), "epochs": F.lit(2), "selection_checks": F.lit(4), "dev_examples": F.lit(200), "answers_per_s": F.lit(0.5), "eval_examples": F.lit(None).cast("int"), "eval_items": F.lit(1147)}
    return P.estimate(_plan(spark, sf_dir).withColumns(fields)).select("adapters", "evaluations", "train", "eval", "total")


@query(f"WITH {_GRID} SELECT experiment_id FROM g WHERE priority <> '' AND split = 'clean'")
def select_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of a plan; experiments without a priority never pass a priority filter."""
    return P.select_plan(_plan(spark, sf_dir), "MS", split="clean").select("experiment_id")


@query(
    f"WITH {_GRID} SELECT experiment_id, seed <> 1 AND split <> 'clean' AS run, CASE WHEN seed = 1 THEN 'already completed' WHEN split = 'clean' THEN 'missing data: clean' ELSE 'new' END AS reason FROM g"
)
def plan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a plan runs, and why not: some is done, some lacks its data."""
    configs = _plan(spark, sf_dir).withColumn("dataset", F.lit("finqa"))
    states = configs.where("seed = 1").select("experiment_id", F.lit("completed").alias("status"), F.lit(1).alias("attempts"), F.lit(2).alias("max_attempts"), F.lit(0.0).alias("last_update"))
    decisions = registry.should_run(states, F.lit(100.0)).select("experiment_id", "run", "reason")
    have = spark.createDataFrame([("finqa", "standard"), ("finqa", "dev"), ("finqa", "train")], "dataset string, split string")
    ready = P.preflight(configs, have, F.array(F.col("split"), F.lit("train")))
    return P.decide(configs, decisions, ready).select("experiment_id", "run", "reason")


@query(
    "SELECT o_orderkey, substr(sha1('{\"arm\": \"' || o_orderstatus || '\", \"learning_rate\": 0.0002, \"lora_dropout\": 0.05, \"on\": ' || (CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END) || ', \"seed\": ' || o_custkey || ', \"teacher\": null}'), 1, 12) AS id FROM orders"
)
def experiment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HX1, HX2: ids over canonical JSON."""
    fields = {"seed": (F.col("o_custkey"), "bigint"), "arm": (F.col("o_orderstatus"), "string"), "learning_rate": (F.lit(2e-4), "double"), "lora_dropout": (F.lit(0.05), "double"), "teacher": (F.lit(None), "string"), "on": (F.col("o_orderkey") % 2 == 0, "boolean")}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring(F.sha1(ids.canonical_json(fields)), 1, 12).alias("id"))


@query("SELECT o_orderkey, 'A5-m-finqa-' || CASE WHEN o_orderstatus = 'F' THEN 'clean' ELSE 'standard' END || '-s' || o_custkey || CASE WHEN o_orderkey % 4 > 1 THEN '-k' || o_orderkey % 4 ELSE '' END AS name, 'A5 m' || CASE WHEN o_custkey <> 0 THEN ' s' || o_custkey ELSE '' END AS label FROM orders")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HX3."""
    split = F.when(F.col("o_orderstatus") == "F", "clean").otherwise("standard")
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.default_name(F.lit("A5"), F.lit("m"), F.lit("finqa"), split, F.col("o_custkey"), F.col("o_orderkey") % 4).alias("name"), ids.run_label(F.lit("A5"), F.lit("m"), F.col("o_custkey")).alias("label"))


@query("SELECT l_returnflag AS arm, count(*) AS n, round(avg(l_quantity), 6) AS prompt, round(2 * 3e9 * avg(l_quantity) * count(*) + 2 * 3e9 * avg(l_linenumber) * count(*), -3) AS infer_flops, 4 * 3e9::DOUBLE * CAST(sum(l_quantity) AS BIGINT) * 1.33::DOUBLE AS train_flops FROM lineitem GROUP BY 1")
def flops_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, A28, A38."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("prompt"), F.avg("l_linenumber").alias("generated"), long(F.sum("l_quantity")).alias("tokens"))
    infer = costs.inference_flops(F.lit(3e9), F.col("prompt"), F.col("generated"), F.col("n"), F.lit(1))
    return rows.select("arm", "n", F.round("prompt", 6).alias("prompt"), F.round(infer, -3).alias("infer_flops"), costs.training_flops(F.lit(3e9), F.col("tokens"), F.lit(True), F.lit(True)).alias("train_flops"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "view", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "click", "not_ready").otherwise("reset")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("exp_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("ord"), event.alias("event"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


_FOLD = (
    "e AS (SELECT user_id AS exp_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'not_ready' ELSE 'reset' END AS ev FROM events), "
    "f AS (SELECT exp_id, 0::BIGINT AS i, false AS known, 'pending' AS status, 0 AS attempts, NULL::VARCHAR AS err FROM (SELECT DISTINCT exp_id FROM e) UNION ALL "
    "SELECT f.exp_id, e.i, known OR ev <> 'reset', CASE WHEN ev = 'running' THEN 'running' WHEN ev = 'completed' THEN 'completed' WHEN ev = 'failed' THEN CASE WHEN attempts >= 2 THEN 'permanently_failed' ELSE 'failed' END ELSE 'pending' END, "
    "CASE WHEN ev = 'running' THEN attempts + 1 WHEN ev = 'not_ready' THEN greatest(attempts - 1, 0) WHEN ev = 'reset' THEN 0 ELSE attempts END, "
    "CASE WHEN ev = 'failed' THEN 'e' || event_id WHEN ev = 'not_ready' THEN 'not ready: e' || event_id WHEN ev = 'running' THEN err END FROM f JOIN e ON e.exp_id = f.exp_id AND e.i = f.i + 1), "
    "s AS (SELECT f.exp_id, status, attempts, err FROM f JOIN (SELECT exp_id, max(i) AS i FROM e GROUP BY 1) m ON f.exp_id = m.exp_id AND f.i = m.i WHERE known)"
)


@query(f"WITH RECURSIVE {_FOLD} SELECT exp_id, status, CAST(attempts AS INT) AS attempts, err AS last_error FROM s")
def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States folded from events."""
    return registry.fold(_events(spark, sf_dir)).select("exp_id", "status", "attempts", "last_error")


@query(
    f"WITH RECURSIVE {_FOLD} SELECT exp_id, CASE status WHEN 'completed' THEN false WHEN 'permanently_failed' THEN false WHEN 'running' THEN attempts < 2 WHEN 'failed' THEN attempts < 2 ELSE true END AS run FROM s"
)
def should_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs again, long after the last event."""
    states = registry.fold(_events(spark, sf_dir)).withColumn("last_update", F.col("last_update") / 1e6)
    return registry.should_run(states, F.lit(4e9)).select("exp_id", "run")


@query(f"WITH RECURSIVE {_FOLD} SELECT s.exp_id, status, last FROM s JOIN (SELECT user_id, epoch_us(max(ts)) AS last FROM events GROUP BY 1) ON s.exp_id = user_id ORDER BY last DESC, s.exp_id LIMIT 50")
def recent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty states that changed last."""
    return registry.latest_first(registry.fold(_events(spark, sf_dir)), 50).select("exp_id", "status", F.col("last_update").alias("last"))


@query(f"WITH RECURSIVE {_FOLD} SELECT status, count(*) AS n FROM s GROUP BY 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, S21."""
    return registry.status_counts(registry.fold(_events(spark, sf_dir)))


@query(f"WITH RECURSIVE {_FOLD} SELECT exp_id, status FROM s WHERE status IN ('failed', 'permanently_failed')")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    return registry.failed(registry.fold(_events(spark, sf_dir))).select("exp_id", "status")


@query(f"WITH RECURSIVE {_FOLD} SELECT exp_id, CASE status WHEN 'completed' THEN 'finished' WHEN 'pending' THEN 'waiting' WHEN 'running' THEN 'interrupted or running' ELSE 'failed: ' || err END AS verdict FROM s")
def session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    return B.session_verdict(registry.fold(_events(spark, sf_dir)), F.lit(0)).select("exp_id", "verdict")


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by hash (no SQL form: the hash is Spark's)."""
    return L.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 100, "doc_id", 7)


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    return predict.length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 8, "doc_id").select("doc_id", "batch")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 OR o_custkey % 5 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, CAST(o_custkey % 5 AS BIGINT) + 1), lambda k: least(k * CAST(ceil((o_orderkey % 100) / nullif(o_custkey % 5, 0)::DOUBLE) AS BIGINT), o_orderkey % 100)))), ',') END AS steps FROM orders")
def selection_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, M4."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(costs.selection_steps(F.col("o_orderkey") % 100, F.col("o_custkey") % 5), ",").alias("steps"))


@query("SELECT count(*) FILTER (WHERE doc_id % 4 > 0 AND n_chars <= 2048) AS kept, count(*) FILTER (WHERE doc_id % 4 > 0 AND n_chars > 2048) AS too_long, count(*) FILTER (WHERE doc_id % 4 = 0) AS no_target, CAST(coalesce(sum(n_chars) FILTER (WHERE doc_id % 4 > 0 AND n_chars <= 2048), 0) AS BIGINT) AS tokens FROM documents")
def training_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    rows = table(spark, sf_dir, "documents").withColumn("gold_program", F.when(F.col("doc_id") % 4 > 0, "answer = 1"))
    return predict.training_counts(rows, F.col("n_chars"), 2048, "pot_gold")


_PLAN_TEXT = "\n".join([
    "# Plan", "**Status: under way**", "## 5. Glance", "| **P1** one | x | ~14 h |", "| **P2** two | x | 3.5–4 h |", "| **P3** three | x | 2 h (rented) |", "## 6. Tasks",
    "### P1 — Pilot  *(now)*", "- [x] **P1.1 (M) Share adapters.** Text.", "- [~] **P1.2 (S)** Next thing; more", "### P2 — Clean set", "- [ ] **P2.1 (M) Build it**", "- [ ] **P2.2 (C) Check it**", "- [x] **P2.3 Extra**",
    "### P3 — Wider", "- [x] **P3.1 Done.**", "## 8. Run log", "| date | run | h |", "| 2026-01-01 | a | 0.25 |", "| 2026-01-02 | b | 1.5 |", "| 2026-01-03 | c | n/a |",
])


def _roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan once per region, so that the scan has several documents."""
    return roadmap.lines(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), F.lit(_PLAN_TEXT).alias("text")))


@query("SELECT r_regionkey AS doc, phase, CAST(total AS BIGINT) AS total, CAST(done AS BIGINT) AS done, complete, gpu_hours, 1.75::DOUBLE AS used_hours FROM region, (VALUES ('P1', 2, 1, false, 14.0::DOUBLE), ('P2', 3, 1, false, 3.5), ('P3', 1, 1, true, NULL)) v(phase, total, done, complete, gpu_hours)")
def roadmap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S25, W5, A31."""
    each = _roadmap(spark, sf_dir)
    return roadmap.phases(each).join(roadmap.used_hours(each), "doc").select("doc", "phase", "total", "done", "complete", "gpu_hours", "used_hours")


@query("SELECT r_regionkey AS doc, task, status, priority, title, CAST(rank AS INT) AS rank FROM region, (VALUES ('P1.2', 'doing', 'S', 'Next thing', 1), ('P2.1', 'open', 'M', 'Build it', 1), ('P2.2', 'open', 'C', 'Check it', 2)) v(task, status, priority, title, rank)")
def roadmap_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8, T7."""
    return roadmap.next_tasks(roadmap.tasks(_roadmap(spark, sf_dir)), 2).select("doc", "task", "status", "priority", "title", "rank")


@query("SELECT r_regionkey AS doc, 'P2' AS phase, 'P1' AS current FROM region")
def roadmap_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    return roadmap.parallel_phases(roadmap.phases(_roadmap(spark, sf_dir)))


@query("SELECT conv_id, turn, coalesce(regexp_extract_all(coalesce(text, '') || ' ' || CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE '' END, '-?\\d+(?:\\.\\d+)?')[-1], '0')::DOUBLE AS value, false AS percent_form FROM conversations")
def predict_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch prediction by the stand-in model, which answers with a prompt's last number, and what its replies say."""
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("")).alias("prompt"))
    done = predict.finish(predict.generate(prompts, predict.echo_predictor), "answer")
    return done.select("conv_id", "turn", N.of("pred").value.alias("value"), "percent_form")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the log, upserted per key; the final snapshot."""
    folder = new_folder(spark, "stream")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = streams.latest_snapshot(spark, f"{sf_dir}/events.parquet", schema, "user_id", ["ts", "event_id"], folder)
    return rows.select("user_id", "event_id", "event_type")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of event time, over the whole table."""
    rows = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    return streams.tumbling_counts(rows, "time", "1 hour", "event_type").select(F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(start as timestamp_ntz))").alias("start"), "event_type", "n")


_SILENT_S = 6 * 3600
_SILENT = (
    "e AS (SELECT user_id AS exp_id, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'not_ready' ELSE 'reset' END AS ev FROM events), "
    "f AS (SELECT exp_id, 0::BIGINT AS i, 'pending' AS status, 0 AS attempts, 0::BIGINT AS last, 0 AS pauses FROM (SELECT DISTINCT exp_id FROM e) UNION ALL "
    "SELECT exp_id, i, CASE ev WHEN 'running' THEN 'running' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN CASE WHEN a >= 2 THEN 'permanently_failed' ELSE 'failed' END ELSE 'pending' END, "
    "CASE ev WHEN 'running' THEN a + 1 WHEN 'not_ready' THEN greatest(a - 1, 0) WHEN 'reset' THEN 0 ELSE a END, ts, pauses + gap FROM ("
    f"SELECT f.exp_id, e.i, e.ts, ev, pauses, CASE WHEN status = 'running' AND ts - last > {_SILENT_S * 1_000_000} THEN greatest(attempts - 1, 0) ELSE attempts END AS a, (status = 'running' AND ts - last > {_SILENT_S * 1_000_000})::INT AS gap "
    "FROM f JOIN e ON e.exp_id = f.exp_id AND e.i = f.i + 1)), "
    f"s AS (SELECT f.*, (SELECT max(epoch_us(ts)) FROM events) - last >= {_SILENT_S * 1_000_000} AS silent FROM f JOIN (SELECT exp_id, max(i) AS i FROM e GROUP BY 1) m ON f.exp_id = m.exp_id AND f.i = m.i)"
)


@query(
    f"WITH RECURSIVE {_SILENT} SELECT exp_id::VARCHAR AS exp_id, CASE WHEN status = 'running' AND silent THEN 'paused' ELSE status END AS status, (CASE WHEN status = 'running' AND silent THEN greatest(attempts - 1, 0) ELSE attempts END)::INT AS attempts, "
    "(pauses + (status = 'running' AND silent)::INT)::INT AS pauses FROM s"
)
def stream_silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events; a run that is silent for six hours is paused by its timer, and its attempt is given back."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def events() -> DataFrame:
        kind = F.col("event_type")
        event = F.when(kind == "view", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "click", "not_ready").otherwise("reset")
        return streams.read_events(spark, f"{sf_dir}/events.parquet", schema).select(F.col("user_id").alias("exp_id"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("ord"), event.alias("event"))

    return sessions.final_states(spark, events, _SILENT_S, new_folder(spark, "silent")).select("exp_id", "status", "attempts", "pauses")


@query("SELECT user_id AS key, list_reduce(list_prepend(0.0::DOUBLE, list(abs(value) + 0.013 ORDER BY event_id)), lambda a, x: round(a + x, 1)) AS seconds FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_gpu_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of sessions added up per key by a stream, rounded to tenths after each; every batch is delivered twice, which changes nothing."""
    folder = new_folder(spark, "seconds")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    add = sessions.seconds_sink(spark, folder)

    def twice(rows: DataFrame, number: int) -> None:
        add(rows, number)
        add(rows, number)

    rows = streams.read_events(spark, f"{sf_dir}/events.parquet", schema).where("value is not null").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), (F.abs("value") + 0.013).alias("seconds"))
    rows.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sessions.read_totals(spark, folder).select("key", "seconds")


@query(
    "WITH p AS (SELECT o_orderstatus AS session, o_orderkey, o_custkey % 97 + 1 AS need, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders), "
    "b AS (SELECT session, CASE WHEN session = 'P' THEN NULL ELSE sum(need) // 3 END AS budget FROM p GROUP BY 1), "
    "s AS (SELECT p.*, budget, sum(need) OVER (PARTITION BY session ORDER BY place) AS upto FROM p JOIN b USING (session)) "
    "SELECT session, o_orderkey, (upto - need)::BIGINT AS before, budget IS NULL OR upto <= budget AS starts FROM s"
)
def budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs of three sessions' plans start within their time, by the running sum of what they need; one session has no limit."""
    from pyspark.sql import Window

    plan = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("session"), "o_orderkey", (F.col("o_custkey") % 97 + 1).alias("need"), (F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey")) - 1).alias("place")
    )
    budgets = plan.groupBy("session").agg(F.when(F.first("session") != "P", F.floor(F.sum("need") / 3)).alias("budget"))
    return P.within_budget(plan.join(budgets, "session"), "need", "place", "budget", "session", block=64).select("session", "o_orderkey", "before", "starts")
