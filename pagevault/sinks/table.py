"""The raw store as a Parquet table, partitioned by patch and locale, for querying at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagevault.schemas import METADATA


def write_table(pages: DataFrame, path: str) -> None:
    """Replaces the partitions that pages has rows for and leaves the others.

    Rows of a partition are dealt to as many tasks as their size asks for, not one, so a large version is no hot task.
    """
    pages = pages.hint("rebalance", "patch", "locale")
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patch", "locale").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The columns of METADATA and content. The schema is given: inferred versions would make 3.1 of 3.10."""
    return spark.read.schema(T.StructType([*METADATA.fields, T.StructField("content", T.BinaryType())])).parquet(path)
