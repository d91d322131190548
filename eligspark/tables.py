"""Reading the Parquet tables of one scale folder through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of folder `sf_dir`; any path that Spark's file systems open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
