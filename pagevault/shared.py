"""The folder that driver and executors share, for checkpoints and tables that one job writes for another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder in the warehouse, unless that is a folder of one machine of a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"machines of a cluster do not share {folder}: set spark.checkpoint.dir")
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def own_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder; what is written there goes when the session ends, or before, by delete()."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)  # only what is there can be marked
    files.deleteOnExit(path)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def use_checkpoints(spark: SparkSession) -> None:
    """Sets the folder for checkpoints if the session has none yet; what is written there goes when the session ends."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        path, files = _path(spark, spark.sparkContext.getCheckpointDir())
        files.deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage; partitions keep their rows and order."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
