"""Labelled and metric tables from CSV, with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.keys import condition_key, fraction_token
from pairwright.functions.scores import binarize_target
from pairwright.operators.gates import GateError
from pairwright.operators.ordering import settle
from pairwright.study import TableSpec

# Columns of the two metric tables, in file order.
BASELINE_COLUMNS = (
    "dataset", "model", "seed", "scarcity_fraction", "training_pool_size", "retained_size",
    "retained_negative", "retained_positive", "test_size", "fit_seconds", "roc_auc", "precision",
    "recall", "f1", "accuracy", "average_precision",
)
AUGMENTATION_COLUMNS = (
    "dataset", "model", "seed", "scarcity_fraction", "training_pool_size", "retained_size",
    "synthetic_size", "generator_seconds", "fit_seconds", "roc_auc", "precision", "recall", "f1",
    "accuracy", "average_precision",
)
_TYPES = {
    "dataset": T.StringType(), "model": T.StringType(), "seed": T.IntegerType(),
    "scarcity_fraction": T.DecimalType(3, 2),
}
_LONGS = {"training_pool_size", "retained_size", "retained_negative", "retained_positive",
          "test_size", "synthetic_size"}

# The public tables' columns and feature roles.
DIABETES_TARGET = "Diabetes_binary"
DIABETES_NUMERIC = ("BMI", "MentHlth", "PhysHlth", "GenHlth", "Age", "Education", "Income")
HEART_COLUMNS = ("age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang",
                 "oldpeak", "slope", "ca", "thal", "num")
HEART_NUMERIC = ("age", "trestbps", "chol", "thalach", "oldpeak", "ca")
HEART_NOMINAL = ("cp", "restecg", "slope", "thal")
HEART_BINARY = ("sex", "fbs", "exang")


def metric_schema(columns: Sequence[str]) -> T.StructType:
    kind = lambda name: _TYPES.get(
        name, T.LongType() if name in _LONGS else T.DoubleType()
    )
    return T.StructType([T.StructField(name, kind(name)) for name in columns])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, in file order: one line is read."""
    return spark.read.option("header", True).csv(path).columns


def with_row_id(scan: DataFrame) -> DataFrame:
    """Number the rows of a file scan from zero, in file order, as ``row_id``.

    The number of a row is its place in its file block plus the rows of all blocks
    before it. Blocks are counted in one pass; no row is shuffled or sorted.
    """
    columns = scan.columns
    marked = scan.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = settle(
        marked.groupBy("_file", "_block")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    lost = F.raise_error(F.lit("a file block was cut differently between two scans"))
    number = (F.col("_before") + F.col("_id") - F.col("_first")).cast("long")
    return marked.join(blocks, ["_file", "_block"], "left").select(
        F.when(F.col("_before").isNull(), lost.cast("long")).otherwise(number).alias("row_id"), *columns
    )


def scan_labelled_csv(
    spark: SparkSession,
    path: str,
    name: str,
    target: str,
    numeric: Sequence[str],
    nominal: Sequence[str] = (),
    fractions: Sequence = (),
) -> tuple[DataFrame, TableSpec]:
    """Headered CSV: target to TINYINT, every column without a role is binary."""
    header = header_of(spark, path)
    lost = [c for c in (target, *numeric, *nominal) if c not in header]
    if lost:
        raise GateError(f"{name}: columns missing from the header: {lost}")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in header])
    scan = (
        spark.read.schema(schema)
        .options(header=True, enforceSchema=False, mode="FAILFAST")
        .csv(path)
    )
    rows = with_row_id(scan).withColumn(target, F.col(target).cast("tinyint"))
    known = {target, *numeric, *nominal}
    binary = tuple(c for c in header if c not in known)
    spec = TableSpec(name, target, tuple(numeric), tuple(nominal), binary, tuple(fractions))
    return rows, spec


def scan_headerless_csv(
    spark: SparkSession,
    path: str,
    name: str,
    columns: Sequence[str] = HEART_COLUMNS,
    source: str = "num",
    numeric: Sequence[str] = HEART_NUMERIC,
    nominal: Sequence[str] = HEART_NOMINAL,
    binary: Sequence[str] = HEART_BINARY,
    missing: str = "?",
    fractions: Sequence = (),
) -> tuple[DataFrame, TableSpec]:
    """Headerless CSV with named columns, ``?`` as null, and target = (source > 0)."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    scan = spark.read.schema(schema).options(
        header=False, nullValue=missing, mode="FAILFAST"
    ).csv(path)
    rows = with_row_id(scan).withColumn("target", binarize_target(F.col(source))).drop(source)
    spec = TableSpec(
        name, "target", tuple(numeric), tuple(nominal), tuple(binary), tuple(fractions)
    )
    return rows, spec


def scan_metric_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Metric rows from a CSV whose header must be ``columns``, in that order."""
    found = header_of(spark, path)
    if found != list(columns):
        raise GateError(f"metric table header changed: {found}")
    raw = (
        spark.read.schema(metric_schema(columns))
        .options(header=True, enforceSchema=False, mode="FAILFAST")
        .csv(path)
    )
    token = fraction_token(F.col("scarcity_fraction"))
    return raw.select(
        condition_key(F.col("dataset"), token, F.col("seed"), F.col("model")).alias("key"),
        "dataset",
        F.col("scarcity_fraction").alias("retained_fraction"),
        token.alias("retained_fraction_token"),
        "seed",
        "model",
        "roc_auc",
    )


def scan_metric_keys(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Keys of a metric CSV. Only the four identity columns are parsed."""
    return scan_metric_csv(spark, path, columns).select("key")
