"""Parquet tables of an index directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """`<base>/<name>.parquet`, a file or a directory of files."""
    return spark.read.parquet(f"{base}/{name}.parquet")
