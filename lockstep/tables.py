"""Readers of the test tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lockstep.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; columns are pruned by the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
