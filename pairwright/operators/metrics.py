"""Tie-aware ranking metrics and threshold metrics per group.

Predictions are first folded to distinct scores, map-side. Running counts are taken
inside score buckets (see ``functions.scores.score_bucket``) and the bucket totals are
summed along the group, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.scores import is_finite, score_bucket

METRICS = ("roc_auc", "precision", "recall", "f1", "accuracy", "average_precision")
_COUNT = "decimal(19,0)"


def _positive(label: str) -> Column:
    """Whether a label is 1; a missing label fails the job rather than fall out of a metric."""
    missing = F.raise_error(F.lit(f"null in label column {label}")).cast("boolean")
    return F.when(F.col(label).isNull(), missing).otherwise(F.col(label) == 1)


def distinct_scores(
    predictions: DataFrame, group: Sequence[str], label: str, score: str
) -> DataFrame:
    """Positives ``p1`` and negatives ``p0`` per (group, bucket, score)."""
    if dict(predictions.dtypes)[score] != "float":
        raise TypeError(f"{score} must be a FLOAT column")
    positive = _positive(label)
    return (
        predictions.groupBy(*group, F.col(score).alias("_score"))
        .agg(F.count_if(positive).alias("p1"), F.count_if(~positive).alias("p0"))
        .withColumn("_bucket", score_bucket(F.col("_score")))
    )


def _running(distinct: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts strictly below each score inside its bucket."""
    below = Window.partitionBy(*group, "_bucket").orderBy("_score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return distinct.select(
        "*",
        F.coalesce(F.sum("p0").over(below), F.lit(0)).alias("in0"),
        F.coalesce(F.sum("p1").over(below), F.lit(0)).alias("in1"),
    )


def _doubled_wins(below: Column) -> Column:
    """2 x (positive, lower negative) pairs plus (positive, equal negative) pairs."""
    return F.col("p1").cast(_COUNT) * (2 * below + F.col("p0")).cast(_COUNT)


def roc_auc(
    predictions: DataFrame,
    group: Sequence[str],
    *,
    label: str = "y_true",
    score: str = "probability",
    name: str = "roc_auc",
) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting one half.

    All counts are exact integers; the only rounding is the last division. A group
    with a single class gets null (report it with ``gates.single_class_groups``).
    """
    along = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    buckets = (
        _running(distinct_scores(predictions, group, label, score), group)
        .groupBy(*group, "_bucket")
        .agg(
            F.sum("p1").alias("b1"),
            F.sum("p0").alias("b0"),
            F.sum(_doubled_wins(F.col("in0"))).cast("decimal(38,0)").alias("inside"),
        )
        .withColumn("_under", F.coalesce(F.sum("b0").over(along), F.lit(0)))
    )
    across = (F.col("b1").cast(_COUNT) * (2 * F.col("_under")).cast(_COUNT)).cast("decimal(38,0)")
    pairs = F.col("positives").cast(_COUNT) * F.col("negatives").cast(_COUNT)
    return (
        buckets.groupBy(*group)
        .agg(
            F.sum("b1").alias("positives"),
            F.sum("b0").alias("negatives"),
            F.sum(F.col("inside") + across).cast("decimal(38,0)").alias("_wins"),
        )
        .select(
            *group,
            "positives",
            "negatives",
            F.when(
                (F.col("positives") > 0) & (F.col("negatives") > 0),
                F.col("_wins").cast("double") / (2 * pairs).cast("double"),
            ).alias(name),
        )
    )


def score_curve(
    predictions: DataFrame,
    group: Sequence[str],
    *,
    label: str = "y_true",
    score: str = "probability",
) -> DataFrame:
    """Per distinct score: its counts and the counts strictly below it in the group."""
    local = _running(distinct_scores(predictions, group, label, score), group)
    along = Window.partitionBy(*group).orderBy("_bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        local.groupBy(*group, "_bucket")
        .agg(F.sum("p1").alias("b1"), F.sum("p0").alias("b0"))
        .select(
            *group,
            "_bucket",
            F.coalesce(F.sum("b0").over(earlier), F.lit(0)).alias("off0"),
            F.coalesce(F.sum("b1").over(earlier), F.lit(0)).alias("off1"),
            F.sum("b0").over(whole).alias("negatives"),
            F.sum("b1").over(whole).alias("positives"),
        )
    )
    return local.join(offsets, [*group, "_bucket"]).select(
        *group,
        F.col("_score").alias("score"),
        "p1",
        "p0",
        (F.col("in0") + F.col("off0")).alias("negatives_below"),
        (F.col("in1") + F.col("off1")).alias("positives_below"),
        "positives",
        "negatives",
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _threshold_columns() -> list[Column]:
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp
    return [
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    ]


def threshold_metrics(
    predictions: DataFrame,
    group: Sequence[str],
    *,
    label: str = "y_true",
    score: str = "probability",
    threshold: float = 0.5,
) -> DataFrame:
    """Precision, recall, F1 and accuracy at ``score >= threshold``; 0 for 0/0."""
    chosen, positive = F.col(score) >= F.lit(threshold), _positive(label)
    return (
        predictions.groupBy(*group)
        .agg(
            F.count_if(positive).alias("positives"),
            F.count_if(~positive).alias("negatives"),
            F.count_if(chosen & positive).alias("tp"),
            F.count_if(chosen & ~positive).alias("fp"),
        )
        .select(*group, "positives", "negatives", "tp", "fp", *_threshold_columns())
    )


def average_precision(
    predictions: DataFrame,
    group: Sequence[str],
    *,
    label: str = "y_true",
    score: str = "probability",
    name: str = "average_precision",
) -> DataFrame:
    return evaluate(predictions, group, label=label, score=score).select(
        *group, "positives", "negatives", F.col("average_precision").alias(name)
    )


def evaluate(
    predictions: DataFrame,
    group: Sequence[str],
    *,
    label: str = "y_true",
    score: str = "probability",
    threshold: float = 0.5,
) -> DataFrame:
    """All six metrics from one pass over the predictions."""
    curve = score_curve(predictions, group, label=label, score=score)
    tp = F.col("positives") - F.col("positives_below")
    fp = F.col("negatives") - F.col("negatives_below")
    chosen = F.col("score") >= F.lit(threshold)
    step = F.when(F.col("p1") > 0, F.col("p1") * tp / (tp + fp)).otherwise(0.0)
    pairs = F.col("positives").cast(_COUNT) * F.col("negatives").cast(_COUNT)
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return (
        curve.groupBy(*group)
        .agg(
            F.max("positives").alias("positives"),
            F.max("negatives").alias("negatives"),
            F.sum(_doubled_wins(F.col("negatives_below"))).cast("decimal(38,0)").alias("_wins"),
            F.sum(step).alias("_area"),
            F.sum(F.when(chosen, F.col("p1")).otherwise(0)).alias("tp"),
            F.sum(F.when(chosen, F.col("p0")).otherwise(0)).alias("fp"),
        )
        .select(
            *group,
            "positives",
            "negatives",
            F.when(both, F.col("_wins").cast("double") / (2 * pairs).cast("double")).alias(
                "roc_auc"
            ),
            *_threshold_columns(),
            _ratio(F.col("_area"), F.col("positives")).alias("average_precision"),
        )
    )


def usable(probability: Column) -> Column:
    return is_finite(probability) & probability.between(0.0, 1.0)
