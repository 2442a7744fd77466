"""The engine behind one object, and its health as DataFrames. Nothing is started at import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagevault.schemas import HEALTH

TITLE, VERSION, DESCRIPTION = "pagevault", "0.1.0", "Collects and queries raw web pages."


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.title, self.version, self.description = spark, TITLE, VERSION, DESCRIPTION

    def live(self) -> DataFrame:
        """status: always ok."""
        return self.spark.createDataFrame([("ok",)], HEALTH)

    def ready(self) -> DataFrame:
        """status: always ok; no dependency is asked."""
        return self.spark.createDataFrame([("ok",)], HEALTH)


def session(app: str = TITLE) -> SparkSession:
    """A session with the settings that the engine expects: UTC, and partition values as text."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    return builder.config("spark.sql.sources.partitionColumnTypeInference.enabled", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def create_engine(spark: SparkSession | None = None) -> Engine:
    return Engine(spark or session())
