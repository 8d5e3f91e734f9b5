"""Inputs that cannot give a whole result must fail loudly, not shrink."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairwright.operators import metrics, reconcile, restore
from pairwright.operators import sampling as S
from pairwright.operators.gates import GateError
from pairwright.operators.logistic import NotConverged, fit_logistic
from pairwright.study import decimals


def test_a_fraction_too_small_for_its_classes_raises(spark):
    rows = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("target"))
    sampler = S.Sampler(rows, "toy", (0,), decimals("0.05", "0.50"))
    with pytest.raises(GateError, match="total_below_minimum"):
        sampler.subsets()


def test_a_final_size_below_the_retained_rows_raises(spark):
    rows = spark.createDataFrame(
        [("d", "001pct", 0, i, i, i % 2) for i in range(6)],
        "dataset STRING, retained_fraction_token STRING, seed INT, pos LONG, row_id LONG, target INT",
    )
    for call in ("restored", "copies"):
        with pytest.raises(GateError):
            getattr(restore.Restorer(rows, F.lit(2), position="pos"), call)()


def predictions(spark, rows):
    return spark.createDataFrame(rows, "key STRING, pos LONG, test_index LONG, y_true INT, probability FLOAT")


@pytest.mark.parametrize("metric", [metrics.roc_auc, metrics.threshold_metrics, metrics.average_precision])
def test_null_labels_are_refused(spark, metric):
    rows = predictions(spark, [("a", 0, 0, 1, 0.9), ("a", 1, 1, 0, 0.1), ("a", 2, 2, None, 0.5)])
    with pytest.raises(Exception, match="null in label column y_true"):
        metric(rows, ["key"]).collect()


def test_infinite_scores_rank_first_and_last(spark):
    rows = predictions(
        spark,
        [("a", 0, 0, 1, math.inf), ("a", 1, 1, 0, -math.inf), ("a", 2, 2, 1, 0.2), ("a", 3, 3, 0, 0.4)],
    )
    assert metrics.roc_auc(rows, ["key"]).first()["roc_auc"] == 0.75


def test_one_bad_archive_fails_alone(spark):
    good = [("a", i, i, i % 2, 0.1 * i) for i in range(6)] + [("b", i, i, i % 2, 0.1 * i) for i in range(6)]
    bad = [(k, p, t, None if k == "b" and p == 0 else y, math.inf if k == "b" and p == 1 else s) for k, p, t, y, s in good]
    got = reconcile.compare_predictions(predictions(spark, good), predictions(spark, bad), ["key"])
    assert {r.key: r.status for r in got.collect()} == {"a": "pass", "b": "fail"}


def test_unconverged_fits_are_refused(spark):
    rows = spark.range(40).select(
        F.lit(0).alias("seed"),
        (F.col("id") % 3 == 0).cast("int").alias("target"),
        F.lit(1.0).alias("weight"),
        F.array((F.col("id") / 7.0), F.lit(1.0)).alias("x"),
    )
    with pytest.raises(NotConverged):
        fit_logistic(rows, ["seed"], 2, steps=1)
    assert fit_logistic(rows, ["seed"], 2).first()["converged"]
