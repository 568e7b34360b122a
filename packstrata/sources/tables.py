"""Readers of the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder holding one parquet table per relation."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
