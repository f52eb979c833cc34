"""The profile of a table: all columns in one pass, by exact sums and by sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.streams import sequential_bootstrap
from sparkwright.operators.ordered import numbered
from sparkwright.plans.domain import r6, table

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def described(df: DataFrame, rank_error: float = 0.001, distinct_error: float = 0.02, top: int = 5) -> DataFrame:
    """One row for each column of ``df``, in order of place.

    place, column, type; rows, nulls; mean, std, low and high (numbers; NaN counts as a value, as Spark has it) and first,
    last (the smallest and largest as text, of all types that have an order); distinct, within ``distinct_error`` (relative
    standard deviation); quantiles of ``QUANTILES``, each the value of a row whose rank is within ``rank_error`` of the
    share; common, the ``top`` most frequent values with their counts, which are too high by what the sketch merged, never
    too low. Sketches are of bounded size, so a column of any number of values costs each task the same.
    """
    parts: dict[str, Column] = {"rows": F.count("*")}
    entries = []
    for place, field in enumerate(df.schema.fields):
        c, number = F.col(f"`{field.name}`"), is_number(field.dataType)
        ordered = not isinstance(field.dataType, (T.MapType, T.VariantType))
        plain = isinstance(field.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        own = {
            "nulls": F.count_if(c.isNull()),
            "mean": F.avg(c.cast("double")) if number else F.lit(None).cast("double"),
            "std": F.stddev_samp(c.cast("double")) if number else F.lit(None).cast("double"),
            "low": F.min(c.cast("double")) if number else F.lit(None).cast("double"),
            "high": F.max(c.cast("double")) if number else F.lit(None).cast("double"),
            "first": F.min(c).cast("string") if ordered and plain else F.lit(None).cast("string"),
            "last": F.max(c).cast("string") if ordered and plain else F.lit(None).cast("string"),
            "distinct": F.approx_count_distinct(c, distinct_error) if ordered else F.lit(None).cast("long"),
            "quantiles": F.percentile_approx(c.cast("double"), list(QUANTILES), round(1 / rank_error)) if number else F.lit(None).cast("array<double>"),
            "common": F.expr(f"transform(approx_top_k(cast(`{field.name}` as string), {top}), s -> struct(s.item as value, s.count as n))") if plain else F.lit(None).cast("array<struct<value:string,n:long>>"),
        }
        parts |= {f"{k}_{place}": v for k, v in own.items()}
        entries.append(F.struct(F.lit(place).alias("place"), F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("type"), "rows", *[F.col(f"{k}_{place}").alias(k) for k in own]))
    once = df.agg(*[v.alias(k) for k, v in parts.items()])
    return once.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fields of the profile of the order lines."""
    p = described(table(spark, sf_dir, "lineitem"))
    return p.select("column", "rows", "nulls", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "low", "high")


def balance_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean balance of all customers and its interval, as one seeded generator resamples them in order of key."""
    c = numbered(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v")), "c_custkey")
    interval = sequential_bootstrap(c, "v", F.avg("v"), 20260914, 300)
    return c.agg(F.count("*").alias("customers"), r6(F.avg("v")).alias("mean")).crossJoin(interval.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high")))


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]
QUERIES = {"m_table_profile": table_profile, "m_balance_interval": balance_interval}
#: The interval's draws are no SQL; tests hold it against the generator itself.
SQL = {
    "m_table_profile": " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, min(CAST({c} AS DOUBLE)) AS low, max(CAST({c} AS DOUBLE)) AS high FROM lineitem" for c in NUMBERS]
        + [f"SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL FROM lineitem" for c in TEXTS])
}
