"""Parquet table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
