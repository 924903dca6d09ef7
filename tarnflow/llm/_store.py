"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import write_through


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back, compressed well: texts and sketches are in it."""
    return write_through(df, name, compression="zstd")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
