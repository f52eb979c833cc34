"""Numbers, ranks and running sums over one order of all rows, without sorting them in one task.

Rows are range-partitioned, which the table written between keeps; each partition counts and sums alone, the partitions'
few totals are summed, and both are added. Equal rows of the order may stand in different partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators.tables import written


def running(df: DataFrame, order: list[str | Column], values: dict[str, Column], number: str = "s") -> DataFrame:
    """``df`` with ``number`` (from 1) and the running sums of ``values`` by name, in ``order``."""
    placed = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "placed")
    totals = placed.groupBy("__p").agg(F.count("*").alias("__n"), *[F.sum(v).alias(f"__t_{k}") for k, v in values.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = totals.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in values])
    own = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = placed.withColumns({"__r": F.row_number().over(own), **{f"__r_{k}": F.sum(v).over(own) for k, v in values.items()}})
    joined = ran.join(F.broadcast(base), "__p")
    return joined.select(*df.columns, (F.col("__b") + F.col("__r")).alias(number), *[(F.col(f"__b_{k}") + F.col(f"__r_{k}")).alias(k) for k in values])


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with i (from 0) and n, the number of rows."""
    return running(df, list(order), {}, "i").crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).withColumn("i", F.col("i") - 1)


def average_ranks(df: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """``df`` with each rank by name (from 1, ties at their mean) of the values that ``ranks`` gives; a null is a value, the first."""
    for name, value in ranks.items():
        counts = df.groupBy(value.alias("__v")).agg(F.count("*").alias("__c"))
        ran = running(counts, ["__v"], {"__to": F.col("__c")}, "__i").select("__v", (F.col("__to") - (F.col("__c") - 1) / F.lit(2.0)).alias(name))
        df = df.withColumn("__own", value).join(ran, F.col("__own").eqNullSafe(F.col("__v"))).select(*df.columns, name)
    return df


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: q, the linearly interpolated quantiles of ``value`` at ``shares``, as an array; null without values.

    Values are counted, put in order by range partitions, and only those at the wanted places are taken, so no task holds
    them all; equal values are one row from the start.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    ran = running(counts, ["__v"], {"__to": F.col("__c")}, "__no")
    total = F.broadcast(counts.agg(F.sum("__c").alias("__n")))
    # a value stands at the places from (__to - __c) to __to - 1
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("__n") - 1).cast("double").alias("m"), F.lit(float(s)).alias("s")) for k, s in enumerate(shares)])
    at = ran.crossJoin(total).withColumn("__p", F.explode(places)).withColumn("__x", F.col("__p.m") * F.col("__p.s"))
    low, high = F.floor("__x"), F.ceil("__x")
    holds = lambda place: (place >= F.col("__to") - F.col("__c")) & (place < F.col("__to"))
    taken = at.filter(holds(low) | holds(high)).groupBy(F.col("__p.k").alias("k")).agg(F.max(F.when(holds(low), F.col("__v"))).alias("a"), F.max(F.when(holds(high), F.col("__v"))).alias("b"), F.max(F.col("__x") - low).alias("w"))
    each = taken.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", ((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b")).alias("q")))).alias("all"))
    return each.select(F.when(F.size("all") > 0, F.transform("all", lambda x: x["q"])).alias("q"))
