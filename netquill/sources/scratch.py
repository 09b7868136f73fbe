"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``); a local one only where none is set and all runs here."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    system, made = _path(spark, path)
    return system.exists(made)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    system, made = _path(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(made)) if system.exists(made) else []


def delete(spark: SparkSession, path: str) -> None:
    system, made = _path(spark, path)
    system.delete(made, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back: it is computed once, and what reads it needs no earlier task."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
