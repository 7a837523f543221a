"""Table access by folder: one Parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; nothing is read until an action."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
