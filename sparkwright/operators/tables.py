"""Intermediate tables in the folder that driver and executors share, so that later jobs survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a folder of its own, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def forgotten(*tables: DataFrame | None) -> None:
    """Delete what ``written`` wrote, once nothing that is still to run reads it."""
    for table in tables:
        if table is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
