"""Shared helpers: the shared folder, intermediate tables, and columns that cannot clash with a caller's."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster executors would write apart, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs start from the table, whatever executors are lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote, once nothing that is still to run reads it."""
    for table in tables:
        if table is not None:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(table.cut_path)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of about ``most`` bytes, or single rows; Spark bounds a batch by rows and bytes (64 MB) itself."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [name for i in range(n + len(taken)) if (name := f"own_{i}") not in taken][:n]


def input_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_long_id(df: DataFrame, name: str) -> F.Column:
    return df[name].cast("long")


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, set at the lowest ``bits`` of each number in the only column; gathered as chunks of 65,536 places."""
    place = F.pmod(F.col(numbers.columns[0]), F.lit(1 << bits))
    chunks = numbers.select(place.alias("p")).distinct().groupBy(F.expr("p div 65536").alias("chunk"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in chunks.agg(F.collect_list(F.pmod("p", F.lit(65536)).cast("int")).alias("at")).toLocalIterator():
        own = np.zeros(65536, bool)
        own[r["at"]] = True
        out[r["chunk"] * 8192 : (r["chunk"] + 1) * 8192] = np.packbits(own, bitorder="little")
    return out
