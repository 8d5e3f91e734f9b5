"""Check a rerun against stored predictions: inputs first, then values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.gates import prediction_gate, require_empty
from pairwright.operators.ledger import reconcile_artifacts
from pairwright.operators.ordering import side_by_side
from pairwright.operators.reconcile import compare_predictions, compare_split_identity


def verify_inputs(
    stored: DataFrame, regenerated: DataFrame, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """Gate the stored archives, then compare ids and labels with the regenerated split."""
    require_empty(prediction_gate(stored, keys), "stored predictions")
    return compare_split_identity(stored, regenerated, keys)


def replay_report(
    stored: DataFrame,
    rerun: DataFrame,
    ledger: DataFrame,
    inventory: DataFrame,
    grid: DataFrame,
) -> DataFrame:
    """One row: compared and passing conditions, findings, and the overall status."""
    compared = compare_predictions(stored, rerun, ["key"]).agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("status") == "pass").alias("passed"),
    )
    findings = reconcile_artifacts(grid, ledger, inventory).agg(
        F.count(F.lit(1)).alias("findings")
    )
    expected = grid.agg(F.count(F.lit(1)).alias("expected"))
    return (
        side_by_side(compared, findings, expected)
        .withColumn(
            "status",
            F.when(
                (F.col("compared") == F.col("expected"))
                & (F.col("passed") == F.col("expected"))
                & (F.col("findings") == 0),
                "pass",
            ).otherwise("fail"),
        )
    )
