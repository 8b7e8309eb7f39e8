"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; Spark prunes its columns from what a plan uses."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
