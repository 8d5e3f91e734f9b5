"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session (``spark.checkpoint.dir``).

    On a cluster it must be shared storage. Only a session that has none, a test on one
    machine, gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settle(table: DataFrame) -> DataFrame:
    """``table`` evaluated once, written as Parquet and read from there.

    Nothing passes through the driver, lost executors lose nothing, and the size of the
    files tells the optimizer whether a join may broadcast it.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
