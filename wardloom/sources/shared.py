"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder where none is set, under a local master alone (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file:///tmp/checkpoints/wardloom")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/wardloom-{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder; what lies there stays until ``clear``."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application put into its part of the shared folder; for when its results have been written out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
