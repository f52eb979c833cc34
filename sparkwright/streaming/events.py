"""Structured Streaming forms of the hourly panel, visits and late data; those with state of their own are in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly counts; a window is emitted when the watermark passes its end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return w.select("key", F.col("window.start").alias("hour"), "n")


def sliding(events: DataFrame, key: str, hours: int, late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", "1 hour"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return w.select("key", F.col("window.end").alias("until"), "n")


def visits(events: DataFrame, key: str, pause: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions cut at pauses."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", pause), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return w.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def lateness(events: DataFrame, key: str, seen: str, late: str = "2 hours") -> DataFrame:
    """By hour and key: events, their mean and largest seconds from event time to ``seen``, and how many came before it."""
    lag = F.col(seen).cast("double") - F.col("ts").cast("double")
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg(lag).alias("mean_s"), F.max(lag).alias("max_s"), F.count_if(lag < 0).alias("negative"))
    return w.select("key", F.col("window.start").alias("hour"), "n", "mean_s", "max_s", "negative")


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the largest version; of equal ones the largest row."""
    return rows.groupBy(key).agg(F.max(F.struct(F.col(version).alias("__version"), *[F.col(c) for c in rows.columns])).alias("__r")).select(*[F.col("__r")[c].alias(c) for c in rows.columns])


def upserts(changes: DataFrame, table: str, key: str, version: str, checkpoint: str):
    """Keeps the changes of each micro-batch, reduced to each key's newest, as a delta of its own at ``table``.

    A batch that is run again replaces its own delta, so a restart neither loses nor repeats anything, and a write costs
    what the batch holds, not what the table holds. ``current`` reads the table, ``compacted`` makes the deltas one.
    """

    def keep(batch: DataFrame, number: int) -> None:
        newest(batch, key, version).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, table: str, key: str, version: str) -> DataFrame:
    """The newest row of each key over all deltas."""
    return newest(spark.read.option("basePath", table).parquet(f"{table}/batch=*").drop("batch"), key, version)


def compacted(spark: SparkSession, table: str, key: str, version: str) -> None:
    """Make all deltas but the last one the first of them; the last stays, since a restart may run its batch again.

    The merged rows are whole beside the deltas before any of these goes, and rows that are there twice change nothing,
    so a stop at any point leaves a table that reads the same.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch=*")))
    old = [n for n in found if n != found[-1]]
    if len(old) < 2:
        return
    rows = spark.read.option("basePath", table).parquet(*[f"{table}/batch={n}" for n in old]).drop("batch")
    number = min(-1, found[0] - 1)  # no micro-batch has it
    newest(rows, key, version).write.mode("overwrite").parquet(f"{table}/batch={number}")
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch={n}"), True)
