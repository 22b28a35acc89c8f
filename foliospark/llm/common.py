"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. One of this machine only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliospark-"))
    return sc.getCheckpointDir()


#: Narrow rows that one task may well hold.
ROWS = 65_536


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, its narrow rows (about so many) in no more tasks than they need."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that lost executors do not lose it. rows: about how many, if they are narrow."""
    checkpoint_folder(df.sparkSession)
    return (df if rows is None else sized(df, rows)).checkpoint()


def matched(df: DataFrame, rows: int | None = None, most: int = 0) -> DataFrame:
    """df as a side of a join: sent to all executors if its rows were counted to be `most` at most, else joined by shuffle.

    The planner left alone sends what it sizes below spark.sql.autoBroadcastJoinThreshold, and it sizes from compressed files, keeps the size through
    an explode, and keeps a planned broadcast when the true size is known: the driver then builds a table of many times that.
    """
    return F.broadcast(df) if rows is not None and rows <= most else df.hint("merge")


class Scratch:
    """Tables written below the checkpoint folder. On leaving, those of a passing one are removed; the others are read by a result that is yet to run."""

    def __init__(self, spark: SparkSession, passing: bool = False) -> None:
        self.spark, self.passing = spark, passing
        self.at = f"{checkpoint_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        if self.passing:
            remove(self.spark, self.at)

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, computed once as Parquet, which takes less room than a checkpoint. rows: about how many, if they are narrow."""
        at, self.n = f"{self.at}/{self.n}", self.n + 1
        (df if rows is None else sized(df, rows)).write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whichever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the broadcasts and shuffle files of finished queries, which it does only after a collection of the driver's garbage.

    Between the rounds of an operator of many queries: else the driver's heap grows to its limit first, and stays so large.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def uniform(*cols: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def undealt(col: Column | str) -> Column:
    """A long column, its value unchanged, that the planner does not know the rows to be dealt by.

    A join on it shuffles this side again, though small, and so lets AQE split a hot key of the other, large side.
    """
    return (F.col(col) if isinstance(col, str) else col).bitwiseXOR(F.lit(0).cast("long"))
