"""Tables of a folder of Parquet files, as DataFrames and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of the named tables (all of NAMES, if none is named)."""
    for n in names or NAMES:
        table(spark, folder, n).createOrReplaceTempView(n)


def sql(spark: SparkSession, folder: str, query: str, *names: str) -> DataFrame:
    views(spark, folder, *names)
    return spark.sql(query)
