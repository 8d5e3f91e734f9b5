"""Rows behind the published figure and table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display names.
DISPLAY = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "harmful": "Harmful",
    "no_clear_practically_meaningful_difference": "No clear practically meaningful difference",
    "helpful": "Helpful",
    "gaussian_minus_replication": "Gaussian − replication",
    "replication_minus_real_only": "Replication − real-only",
    "gaussian_minus_real_only": "Gaussian − real-only",
}


def display_name(value: Column) -> Column:
    names = F.create_map(*[F.lit(item) for pair in DISPLAY.items() for item in pair])
    return F.coalesce(names[value], value)


def percent(fraction: Column) -> Column:
    return F.format_string("%.0f%%", fraction.cast("double") * 100)


def forest_plot_rows(summary: DataFrame, contrast: str) -> DataFrame:
    """Point, error-bar lengths and label per stratum of one contrast."""
    label = F.concat_ws(
        " · ", F.initcap("dataset"), percent(F.col("retained_fraction")),
        display_name(F.col("model")),
    )
    return summary.filter(F.col("contrast") == contrast).select(
        label.alias("label"),
        "estimate",
        (F.col("estimate") - F.col("ci_lower")).alias("lower_error"),
        (F.col("ci_upper") - F.col("estimate")).alias("upper_error"),
        "interpretation",
    )


def public_table(summary: DataFrame, contrast: str) -> DataFrame:
    four = lambda column: F.format_string("%.4f", F.col(column))
    return summary.filter(F.col("contrast") == contrast).select(
        F.initcap("dataset").alias("Dataset"),
        percent(F.col("retained_fraction")).alias("Retained fraction"),
        display_name(F.col("model")).alias("Model"),
        F.col("pairs").cast("long").alias("Paired seeds"),
        four("estimate").alias("Estimate"),
        four("ci_lower").alias("CI lower"),
        four("ci_upper").alias("CI upper"),
        display_name(F.col("interpretation")).alias("Interpretation"),
    )


def count_table(counts: DataFrame) -> DataFrame:
    """Interpretation counts with display names."""
    labels = [c for c in counts.columns if c != "contrast"]
    return counts.select(
        display_name(F.col("contrast")).alias("Contrast"),
        *[F.col(c).alias(DISPLAY.get(c, c)) for c in labels],
    )
