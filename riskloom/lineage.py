"""Cutting lineage between the steps of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new one only where that is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: a step's plan begins at its inputs, and lost executors lose nothing."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As saved(), as a Parquet table: for loops, as what a checkpoint knows about its columns grows with every turn."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
