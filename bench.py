"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparkledger.plans import catalogue
from sparkledger.session import session

HEADLINE = [
    "ablation_gap", "primary_match_rate", "normalize_number_forms", "parse_answer_kinds", "outcome_counts", "rule_ladder", "dsl_eval", "dsl_table_ops", "grounding_cells", "item_scores",
    "latest_per_key", "registry_state", "gpu_price_join", "experiment_ids", "conv_history", "bootstrap_mean_ci", "accuracy_by_length_quartile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # starts the executor and the file cache
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
