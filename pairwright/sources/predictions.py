"""Prediction archives: a long table, partitioned by dataset and model, or nested arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.ordering import CHUNK

SCHEMA = (
    "key STRING, pos BIGINT, test_index BIGINT, y_true TINYINT, probability FLOAT, "
    "dataset STRING, model STRING"
)
ARRAYS = ("test_index", "y_true", "probability")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write the long table; the commit protocol shows complete files only."""
    predictions.write.mode("errorifexists").partitionBy("dataset", "model").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def to_arrays(predictions: DataFrame, keys: Sequence[str], block: int = CHUNK) -> DataFrame:
    """Three parallel arrays per key and block of positions."""
    packed = F.sort_array(F.collect_list(F.struct("pos", *ARRAYS)))
    return (
        predictions.groupBy(*keys, F.floor(F.col("pos") / block).cast("long").alias("block"))
        .agg(packed.alias("_rows"))
        .select(*keys, "block", *[F.col(f"_rows.{name}").alias(name) for name in ARRAYS])
    )


def from_arrays(archives: DataFrame, keys: Sequence[str], block: int = CHUNK) -> DataFrame:
    """Open nested archives to rows; arrays of unequal length leave nulls to be gated."""
    start = F.col("block") * block if "block" in archives.columns else F.lit(0)
    return archives.select(
        *keys, start.alias("_start"), F.posexplode(F.arrays_zip(*ARRAYS)).alias("_i", "_row")
    ).select(
        *keys,
        (F.col("_start") + F.col("_i")).cast("long").alias("pos"),
        *[F.col(f"_row.{name}").alias(name) for name in ARRAYS],
    )
