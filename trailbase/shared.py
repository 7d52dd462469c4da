"""Tables between jobs, in the folder that all executors share.

The folder is the one that ``spark.checkpoint.dir`` names.  A session on a local
master that names none gets a temporary folder of its own; on a cluster, whose
machines share no such folder, that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="trailbase-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set(SETTING, base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a folder when it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: what follows starts from files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
