"""Folders and checkpoints that every executor can reach, and the splitting of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, one of this machine's own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="offerlake-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that a lost executor costs no more than a read."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


#: Keys that are held to be hot at most, so that the table of them can be broadcast.
HOT = 100_000


def hot_pieces(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Values of key that more than `most` rows have, null among them, as __key, and __pieces that each is to be cut into.

    Where more than HOT values could have so many rows, `most` is raised to what HOT values at most can have.
    """
    bound = max(most, -(-rows.count() // HOT))
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > bound)
    return counts.select("__key", F.ceil(F.col("__n") / bound).cast("int").alias("__pieces"))


def with_piece(df: DataFrame, hot: DataFrame, key: str, *spread: str | Column) -> DataFrame:
    """df with a column piece: 0, and for a hot key a hash of `spread` and the task, below its number of pieces.

    Equal rows of a hot key part by the tasks that they are in, which a task that is run again doesn't change.
    """
    joined = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left")
    piece = F.when(F.col("__pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread, F.spark_partition_id()), F.col("__pieces")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], piece.cast("int").alias("piece"))


class Stages:
    """Tables of one run in the shared folder; a table is removed once the next but one is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-2])
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.parquet(path)
