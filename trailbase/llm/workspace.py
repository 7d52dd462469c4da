"""Tables between the jobs of one operator, in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; a local
session that names none gets a temporary folder of its own.  What a run wrote
is deleted when the driver ends, or before, as soon as nothing reads it.
A written table cuts the lineage: an executor lost later costs the tasks that
it ran, not the jobs before.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import SETTING, delete_at_exit, shared_folder, shared_root

BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BY_SIZE = ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder itself."""
    return shared_root(spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """A folder for one run of one operator.

    Sets the session to merge shuffle partitions by their size (BY_SIZE): a
    small table is one file and not one for each core, a large one as many as
    its size asks for.
    """

    def __init__(self, spark: SparkSession, name: str):
        spark.conf.set(*BY_SIZE)
        self.spark, self.path = spark, shared_folder(spark, name)
        delete_at_exit(spark, self.path)

    def keep(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Write df and read it back; free: Spark deletes the shuffle files of df as soon as it is written."""
        before = self.spark.conf.get(FREE, "false")
        self.spark.conf.set(FREE, "true" if free else before)
        try:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(FREE, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark drop shuffle files whose plans are gone."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
        gc.collect()
        self.spark._jvm.System.gc()


def width(spark: SparkSession, least: int = 1) -> int:
    """How many partitions an exchange of this session has."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ids_are_unique(docs: DataFrame) -> bool:
    """Whether no doc_id is null or repeats."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    return again.isEmpty()


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and nothing else, so that further columns never clash.

    Sets the session's Arrow batches to BATCH: a batch holds a few megabytes of
    text however long the texts are, on both sides of the pipe to Python.
    """
    docs.sparkSession.conf.set(*BATCH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
