"""From arm metrics to contrast summaries, with the gates in between."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.contrast import (
    arm_join,
    paired_differences,
    restrict_to_grid,
    stratum_summaries,
)
from pairwright.operators.gates import (
    identity_gate,
    metric_range,
    prediction_gate,
    require_empty,
    single_class_groups,
    strata_gate,
    summary_gate,
)
from pairwright.operators.grid import IDENTITY, condition_grid, strata
from pairwright.operators.metrics import roc_auc
from pairwright.operators.ordering import settle
from pairwright.operators.reconcile import reconcile_keys
from pairwright.study import Study


def metrics_from_predictions(predictions: DataFrame, study: Study) -> DataFrame:
    """Gate the archives and return one AUC row per condition."""
    grid = condition_grid(predictions.sparkSession, study)
    require_empty(
        reconcile_keys(grid, predictions.select("key").distinct(), ["key"]).filter(
            "status != 'ok'"
        ),
        "prediction keys",
    )
    require_empty(prediction_gate(predictions, ["key"]), "predictions")
    require_empty(single_class_groups(predictions, ["key"]), "label classes")
    return grid.join(roc_auc(predictions, ["key"]).select("key", "roc_auc"), "key")


def arm_violations(rows: DataFrame, study: Study) -> DataFrame:
    """(key, code) of metric rows that fail identity, range or key checks."""
    grid = condition_grid(rows.sparkSession, study)
    keys = reconcile_keys(grid, rows, ["key"]).filter("status != 'ok'")
    return (
        identity_gate(rows, study)
        .unionByName(metric_range(rows))
        .unionByName(keys.select("key", F.col("status").alias("code")))
    )


def analyze(
    spark: SparkSession,
    arms: Mapping[str, DataFrame],
    study: Study,
    *,
    wider: Mapping[str, Study] | None = None,
    pcg64: bool = False,
) -> DataFrame:
    """One row per (stratum, contrast).

    ``wider`` names arms that come on a larger grid and are cut down to the study's.
    The metric tables are of grid size; each is evaluated once.
    """
    grid = condition_grid(spark, study)
    tables = {name: settle(rows.select("key", *IDENTITY, "roc_auc")) for name, rows in arms.items()}
    found = [
        arm_violations(table, (wider or {}).get(name, study)).withColumn("arm", F.lit(name))
        for name, table in tables.items()
    ]
    require_empty(reduce(DataFrame.unionByName, found), "arm metrics")
    ready = {name: restrict_to_grid(table, grid, ["key"]) for name, table in tables.items()}
    joined = arm_join(ready, list(IDENTITY))
    summary = settle(
        stratum_summaries(
            paired_differences(joined, list(IDENTITY), study.contrasts), study, pcg64=pcg64
        )
    )
    require_empty(
        summary_gate(summary, study).unionByName(
            strata_gate(summary, strata(spark, study), study)
        ),
        "summary",
    )
    return summary.select("*", F.lit(study.threshold).alias("practical_threshold"))
