"""Cutting lineage where a table is read again and again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own only where that is unset and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="lithos-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    folder(df.sparkSession)
    return df.checkpoint()
