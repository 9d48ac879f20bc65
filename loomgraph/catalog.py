"""Where the queries find their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES under sf_dir, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
