from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagevault.operators import metadata, successful
from pagevault.schemas import RAW_PAGE


def metadata_stream(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of raw page records that are added to a folder of Parquet files. Nothing is kept between batches."""
    return metadata(successful(spark.readStream.schema(RAW_PAGE).parquet(path)))
