"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) of ``data_dir``."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
