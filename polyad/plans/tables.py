"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; only the columns that a query uses are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
