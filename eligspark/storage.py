"""Shared-folder tables: how lineage is cut so that a lost executor never loses results.

`materialize` writes a DataFrame as Parquet under the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back.  Nothing is kept in executor memory or on a
local disk, so any task of a later stage can be retried anywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and all of it runs on one machine (tests, notebooks).
DEFAULT_SHARED_DIR = "/tmp/checkpoints/eligspark"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; ValueError on a cluster that names none, because a machine's own folder isn't shared."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(DEFAULT_SHARED_DIR)
    return DEFAULT_SHARED_DIR


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/eligspark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and return it read back (lineage cut, columns prunable)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table that `df` was read from, once a later table that no longer needs it is written; other files stay."""
    spark = df.sparkSession
    jvm, root = spark.sparkContext._jvm, scratch_root(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if f"{jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()}/" in f"{path.toUri().getPath()}/":
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, and no other's (call when results are written)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
