"""Summary and report documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.grid import STRATUM

_CONTRAST = (
    "STRUCT<estimate: DOUBLE, ci_lower: DOUBLE, ci_upper: DOUBLE, interpretation: STRING, "
    "bootstrap_seed: DECIMAL(20,0), bootstrap_resamples: INT, method: STRING, "
    "quantiles: ARRAY<DOUBLE>, quantile_method: STRING>"
)
_ROW = {
    "dataset": "STRING",
    "retained_fraction": "DECIMAL(3,2)",
    "retained_fraction_token": "STRING",
    "model": "STRING",
    "paired_seed_count": "INT",
    "contrasts": f"MAP<STRING, {_CONTRAST}>",
}
ROW_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _ROW.items())
_NESTED_ROW = ", ".join(f"{name}: {kind}" for name, kind in _ROW.items())
DOCUMENT_SCHEMA = (
    f"stratum_count INT, practical_threshold DOUBLE, rows ARRAY<STRUCT<{_NESTED_ROW}>>"
)


def nested_summary(summary: DataFrame) -> DataFrame:
    """One row per stratum with a map from contrast to its result."""
    result = F.struct(
        F.col("estimate").alias("estimate"),
        F.col("ci_lower").alias("ci_lower"),
        F.col("ci_upper").alias("ci_upper"),
        F.col("interpretation").alias("interpretation"),
        F.col("bootstrap_seed").alias("bootstrap_seed"),
        F.col("bootstrap_resamples").cast("int").alias("bootstrap_resamples"),
        F.lit("paired_seed_level_bootstrap").alias("method"),
        F.array(F.lit(0.025), F.lit(0.975)).alias("quantiles"),
        F.lit("linear").alias("quantile_method"),
    )
    return summary.groupBy(*STRATUM).agg(
        F.max("pairs").cast("int").alias("paired_seed_count"),
        F.map_from_entries(F.collect_list(F.struct(F.col("contrast"), result))).alias("contrasts"),
    )


def tidy_summary(nested: DataFrame) -> DataFrame:
    """The inverse of :func:`nested_summary`: one row per (stratum, contrast)."""
    return nested.select(
        *STRATUM, F.col("paired_seed_count").alias("pairs"),
        F.explode("contrasts").alias("contrast", "_r"),
    ).select(
        *STRATUM, "contrast", "pairs", "_r.estimate", "_r.ci_lower", "_r.ci_upper",
        "_r.interpretation", "_r.bootstrap_seed", "_r.bootstrap_resamples",
    )


def read_summary_document(spark: SparkSession, path: str) -> DataFrame:
    """A stored summary document, as tidy rows."""
    document = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    return tidy_summary(document.select(F.inline("rows")))


def write_summary_rows(summary: DataFrame, path: str) -> None:
    """One JSON line per stratum; refuses to replace what is there."""
    nested_summary(summary).write.mode("errorifexists").json(path)


def write_seed_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("errorifexists").json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
