"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import QUERIES  # noqa: E402

HEADLINE = (
    "roc_auc",
    "paired_bootstrap_ci",
    "analyze_arms",
    "evaluate_probabilities",
    "compare_predictions",
    "stratified_split",
    "nested_scarcity_subsets",
    "replication_weights",
    "replication_control",
    "reconcile_keys",
    "gate_predictions",
    "run_report",
    "impute_numeric",
    "run_condition_baseline",
    "run_condition_replication",
)


def session(cpus: str) -> SparkSession:
    work = subprocess.check_output(["mktemp", "-d", "/tmp/spark-XXXXXX"], text=True).strip()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pairwright-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.local.dir", work)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(f"{work}/checkpoints")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
