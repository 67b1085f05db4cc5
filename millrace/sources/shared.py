"""The folder that all executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/run"


def kept(df: DataFrame) -> DataFrame:
    """df written as a table and read back: what comes after does not compute it again, nor depend on an executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
