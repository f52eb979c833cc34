"""Joins, selections and grids that Spark has no single call for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators.ordered import quantiles, running
from sparkwright.operators.tables import written


def completed(counts: DataFrame, keys: list[str], ts: str, values: list[str], hours: int = 1) -> DataFrame:
    """One row for each key and step from the first to the last time of the table, missing ``values`` as 0.

    Keys come from the table; the steps are one sequence, made where it is exploded, so no row list passes the driver.
    """
    span = counts.agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    grid = counts.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("__a", "__b", F.make_dt_interval(F.lit(0), F.lit(hours)))).alias(ts))
    return grid.join(counts, [*keys, ts], "left").select(*keys, ts, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, width: float) -> DataFrame:
    """Rows of both with equal keys and |x - y| <= width: joined by buckets as wide as the band, so each bucket meets three."""
    w = F.lit(float(width))
    a = left.withColumn("__k", F.explode(F.array(*[F.floor(F.col(x) / w) + d for d in (-1, 0, 1)])))
    b = right.withColumn("__k", F.floor(F.col(y) / w))
    return a.join(b, [*keys, "__k"]).filter(F.abs(F.col(x) - F.col(y)) <= w).drop("__k")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, columns: list[str]) -> DataFrame:
    """``left`` with the ``columns`` of the first row of ``right`` of its keys that starts strictly after ``at``.

    One sort of both sides together and a running first value from behind, not a join of all pairs of a key.
    """
    what = F.struct(F.col(start).alias("__start"), *columns)
    marked = left.withColumn("__own", F.struct(*left.columns)).select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), "__own", F.lit(None).cast(right.select(what.alias("w")).schema["w"].dataType).alias("__next"))
    events = right.select(*keys, F.col(start).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(marked.schema["__own"].dataType).alias("__own"), what.alias("__next"))
    # read from behind; at equal times the rows that look stand before the events, which are not after them. Frames that
    # end with the last row would be gone through anew for each row.
    order = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__side"), F.desc(F.col("__next")[columns[0]])).rowsBetween(Window.unboundedPreceding, -1)
    found = marked.unionByName(events).withColumn("__next", F.last("__next", True).over(order)).filter("__side = 1")
    return found.select("__own.*", *[F.col("__next")[c].alias(f"next_{c}") for c in columns], F.col("__next.__start").alias(f"next_{start}"))


def nearest(left: DataFrame, right: DataFrame, x: str, y: str, column: str) -> DataFrame:
    """``left`` with the value of ``column`` of the row of ``right`` nearest in y, smaller values first.

    Both sides stand in one order, range-partitioned; a row's candidates are the last row of ``right`` before it and the
    first after it, each partition learning its neighbours' from one row a partition.
    """
    best = right.groupBy(F.col(y).cast("double").alias("__t")).agg(F.min(column).alias("__v")).filter("__t is not null")
    own = left.withColumn("__own", F.struct(*left.columns)).select(F.col(x).cast("double").alias("__t"), F.lit(None).cast(best.schema["__v"].dataType).alias("__v"), "__own")
    both = own.unionByName(best.withColumn("__own", F.lit(None).cast(own.schema["__own"].dataType)))
    placed = written(both.repartitionByRange("__t").withColumn("__p", F.spark_partition_id()), "placed")
    at = F.when(F.col("__own").isNull(), F.struct("__t", "__v"))
    ends = placed.groupBy("__p").agg(F.max(at).alias("a"), F.min(at).alias("b"))
    passed = (Window.unboundedPreceding, -1)  # both ways: a frame that ends with the last row would be gone through anew for each row
    ends = ends.select("__p", F.last("a", True).over(Window.orderBy("__p").rowsBetween(*passed)).alias("__before"), F.last("b", True).over(Window.orderBy(F.desc("__p")).rowsBetween(*passed)).alias("__after"))  # a row a partition
    here, back = Window.partitionBy("__p").orderBy("__t", F.col("__own").isNotNull()), Window.partitionBy("__p").orderBy(F.desc("__t"), F.col("__own").isNull())
    found = placed.withColumn("__a", F.last(at, True).over(here.rowsBetween(*passed))).withColumn("__b", F.last(at, True).over(back.rowsBetween(*passed))).filter("__own is not null").join(F.broadcast(ends), "__p")
    pick = F.array_min(F.transform(F.array_compact(F.array(F.coalesce("__a", "__before"), F.coalesce("__b", "__after"))), lambda s: F.struct(F.abs(s["__t"] - F.col("__t")).alias("d"), s["__v"].alias("v"))))
    return found.select("__own.*", pick["v"].alias(f"nearest_{column}"), pick["d"].alias("distance"))


def only_with(df: DataFrame, keys: list[str], other: DataFrame) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is not null and not among the parent's."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def divided(df: DataFrame, item: str, by: str) -> DataFrame:
    """The items that come with every value of ``by``."""
    total = df.agg(F.countDistinct(by).alias("__n"))
    return df.groupBy(item).agg(F.countDistinct(by).alias("__c")).crossJoin(F.broadcast(total)).filter("__c = __n").select(item)


def joined_once(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A many-to-one join; raises if a key of ``right`` repeats."""
    if right.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"keys repeat: {keys}")
    return left.join(right, keys, how)


def undominated(df: DataFrame, name: str, up: list[str], down: list[str], block: int = 8192) -> DataFrame:
    """Rows that no other row equals or beats everywhere and beats somewhere; rows with a null in these columns are none.

    First the rows that lose within a block of ``block`` rows go (whoever beats a row that beat another beats that one, so
    none is needed any more); each block of what is left is then compared with each.
    """
    whole = df.dropna(subset=[*up, *down])
    signs = [F.col(c).cast("double") for c in up] + [-F.col(c).cast("double") for c in down]
    slim = whole.select(F.col(name).alias("__n"), F.array(*signs).alias("__v"))
    parts, width = max(1, -(-slim.count() // block)), len(signs)
    slim = slim.withColumn("__a", F.pmod(F.xxhash64("__n"), F.lit(parts)).cast("int"))

    def beaten(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        v, w = (np.array(x["__v"].tolist()).reshape(len(x), width) for x in (rows, others))
        lost = [bool(((w >= x).all(axis=1) & (w > x).any(axis=1)).any()) for x in v]
        return rows.loc[lost, ["__n"]]

    schema = slim.select("__n").schema
    lost = slim.groupBy("__a").applyInPandas(lambda pdf: beaten(pdf, pdf), schema)
    front = written(slim.join(lost, "__n", "left_anti"), "front")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    lost = front.withColumn("__b", blocks).groupBy("__a", "__b").cogroup(front.withColumnRenamed("__a", "__b").withColumn("__a", blocks).groupBy("__a", "__b")).applyInPandas(beaten, schema)
    kept = front.select("__n").join(lost, "__n", "left_anti")
    return df.join(kept, df[name] == kept["__n"], "left_semi")


def top_with_ties(df: DataFrame, value: str) -> DataFrame:
    best = df.agg(F.max(value).alias("__m"))
    return df.join(F.broadcast(best), F.col(value) == F.col("__m")).drop("__m")


def deciles(df: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """``df`` with bucket from 0: by linearly interpolated quantile edges, equal edges merged."""
    edges = quantiles(df, value, [i / parts for i in range(parts + 1)]).select(F.array_distinct("q").alias("__e"))
    above = F.size(F.filter("__e", lambda e: e < F.col(value))) - 1
    return df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.greatest(above, F.lit(0))).drop("__e")


def codes(df: DataFrame, column: str, train: Column | None = None) -> DataFrame:
    """``df`` with code: the value's place among the sorted training values, -1 for others."""
    known = (df.filter(train) if train is not None else df).filter(F.col(column).isNotNull()).select(column).distinct()
    known = running(known, [column], {}, "code").withColumn("code", F.col("code") - 1)
    return df.join(known, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def sampled(df: DataFrame, strata: list[str], n: int, seed: int, *ident: str) -> DataFrame:
    """n rows of each stratum, by a seeded hash, the same for every run."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *ident), *ident)
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")


def separated(candidates: DataFrame, at: str, score: str, gap: float, most: int) -> DataFrame:
    """Greedy selection by falling score (then earlier), no two closer than ``gap``; at most ``most``.

    In rounds: a row that is the best within ``gap`` of itself is chosen by the greedy order too, whatever comes before it
    elsewhere, and rules out its neighbours; the others wait for the next round. Times are joined by buckets as wide as
    ``gap``, so each meets three; rows of one time are first reduced to the best.
    """
    columns = candidates.columns
    left = written(candidates.filter(F.col(score).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(at).alias("__t")).agg(F.max_by(F.struct(*columns), F.col(score)).alias("__row"), F.max(score).alias("__s")), "candidates")
    chosen = None
    width = F.lit(float(gap))
    while left.limit(1).count():
        other = left.select(F.col("__t").alias("__u"), F.struct(F.col("__s"), -F.col("__t")).alias("__o")).withColumn("__k", F.floor(F.col("__u") / width))
        near = left.select("__t", "__s", F.explode(F.array(*[F.floor(F.col("__t") / width) + d for d in (-1, 0, 1)])).alias("__k")).join(other, "__k").filter(F.abs(F.col("__t") - F.col("__u")) < width)
        best = written(near.groupBy("__t").agg(F.max_by("__u", "__o").alias("__best")).filter("__t = __best").select("__t"), "best")
        now = left.join(best, "__t")
        chosen = now if chosen is None else chosen.unionByName(now)
        out = best.select(F.col("__t").alias("__u"), F.explode(F.array(*[F.floor(F.col("__t") / width) + d for d in (-1, 0, 1)])).alias("__k"))
        ruled = left.select("__t", F.floor(F.col("__t") / width).alias("__k")).join(out, "__k").filter(F.abs(F.col("__t") - F.col("__u")) < width).select("__t").distinct()
        left = written(left.join(ruled, "__t", "left_anti"), "candidates")
    return (candidates.limit(0) if chosen is None else chosen.select("__row.*")).orderBy(F.desc(score), at).limit(most)


def matched(left: DataFrame, right: DataFrame, x: str, y: str, width: float, rank: str) -> DataFrame:
    """One-to-one pairs within ``width``, nearest first, then by ``rank``, x and y; x and y are unique on their sides.

    In rounds: a pair that is the first of both its rows is a pair of the greedy order too; its rows leave.
    """
    pairs = band_join(left, right, [], x, y, width).withColumn("__d", F.abs(F.col(x) - F.col(y)))
    schema, order = pairs.drop("__k").schema, F.struct("__d", rank, x, y)
    open_, taken = written(pairs, "pairs"), None
    while open_.limit(1).count():
        firsts = open_.withColumns({"__x": F.min(order).over(Window.partitionBy(x)), "__y": F.min(order).over(Window.partitionBy(y))})
        now = written(firsts.filter((order == F.col("__x")) & (order == F.col("__y"))).drop("__x", "__y"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        open_ = written(open_.join(now.select(x), x, "left_anti").join(now.select(y), y, "left_anti"), "pairs")
    return (pairs if taken is None else taken).select(*schema.names)
