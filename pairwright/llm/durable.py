"""Results that must outlive an executor: written once to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pairwright.operators.shared import shared_folder


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and written to ``spark.checkpoint.dir``."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def reread(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet below the checkpoint folder, and read from there."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.parquet(path)
