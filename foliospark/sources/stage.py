"""Cutting a chain of DataFrames into stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. One of this machine only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliospark-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder: later steps start from there, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
