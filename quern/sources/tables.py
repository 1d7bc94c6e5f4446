"""Named Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> None:
    """Each table as a temporary view of its name, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
