"""Access to the Parquet tables under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; the path goes to Spark alone, so any store that Spark can read will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
