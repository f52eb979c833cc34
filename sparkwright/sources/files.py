"""Reading and writing tables: CSV with sniffed headers, JSON lines, cached Parquet, manifests, resumed batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.text import snake_case


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, in snake case; raises if two become equal."""
    first = spark.read.option("header", True).csv(path).columns
    names = [snake_case(c) for c in first]
    if len(set(names)) < len(names):
        raise ValueError(f"columns with equal names: {sorted({n for n in names if names.count(n) > 1})}")
    return names


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named in snake case: the staging form, to be typed by an explicit select."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).toDF(*header(spark, path))


def external_csv(spark: SparkSession, name: str, path: str, schema: str) -> DataFrame:
    """A temporary view over CSV files with a stated schema."""
    spark.read.option("header", True).schema(schema).csv(path).createOrReplaceTempView(name)
    return spark.table(name)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, missing_is_empty: bool = True) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a line that is not an object raises, an absent file is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if missing_is_empty:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog has a table or view of this name."""
    return spark.catalog.tableExists(name)


def created_as(df: DataFrame, name: str, replace: bool = False) -> DataFrame:
    """A table of the catalog made of ``df``; one that exists raises, unless it may be replaced."""
    if not replace and table_exists(df.sparkSession, name):
        raise ValueError(f"{name} exists")
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def inserted(df: DataFrame, name: str) -> None:
    """Append ``df`` to a table, columns by name and in the table's types; a value that its type doesn't hold raises.

    A column that the table lacks raises, one that ``df`` lacks is null.
    """
    target = df.sparkSession.table(name)
    unknown = set(df.columns) - set(target.columns)
    if unknown:
        raise ValueError(f"{name} has no {sorted(unknown)}")
    typed = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    df.select(*typed).write.mode("append").insertInto(name)


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only in a, and only in b."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def answer_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text with their fields in order of name."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, digest (of each row's hash, whatever the order) of each table."""
    out = None
    for name, df in tables.items():
        row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sha2(F.bit_xor(row).cast("string"), 256), F.sha2(F.lit(""), 256)).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side (left or right) of keys that only one table has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def resumed(spark: SparkSession, path: str, wanted: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parquet at ``path``, one folder for each value of ``key``; only values that have none yet are made."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        wanted = wanted.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    if wanted.limit(1).count():
        make(wanted).write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path)


def batched(events: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """``events`` with batch: groups, in order of their first event, are never split.

    A batch ends where the running sum of the sizes passes a multiple of ``most``, so it has at most ``most`` events and
    those of one group more. Groups are put in order by range partitions.
    """
    from sparkwright.operators.ordered import running

    sizes = events.groupBy(group).agg(F.count("*").alias("__n"), F.min(order).alias("__o"))
    placed = running(sizes, ["__o", group], {"__upto": F.col("__n")}, "__no").withColumn("batch", F.floor((F.col("__upto") - 1) / F.lit(most)))
    return events.join(placed.select(group, "batch"), group)
