"""Staged text made typed, calendars of the days that occur, and how peaks spread to other keys; on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions import windows as W
from sparkwright.plans import mobility as M
from sparkwright.plans.domain import PANEL, TRAIN_END, panel, r6, table
from sparkwright.sources import trips as T


def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a file of trips would give them: all text, some of it blank or malformed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    x = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    hit = lambda n: k % n == 0
    number = lambda c: F.col(c).cast("string")
    place = F.concat(F.lit("POINT ("), (F.col("l_suppkey") % 97).cast("string"), F.lit(" 0)"))
    return x.select(
        "l_returnflag", F.when(hit(97), "  ").otherwise(F.concat_ws("-", number("l_orderkey"), number("l_linenumber"))).alias("trip_id"),
        F.when(hit(89), "unknown").when(hit(83), "").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a")).alias("trip_start_timestamp"),
        F.when(hit(67), " ").when(hit(61), "-60").otherwise((F.col("l_quantity").cast("long") * 60).cast("string")).alias("trip_seconds"), number("l_quantity").alias("trip_miles"),
        F.when(hit(71), "n/a").when(hit(73), "-1.5").otherwise(F.concat(F.lit(" "), number("l_extendedprice"))).alias("fare"), F.when(hit(5), F.lit(None)).otherwise(number("l_discount")).alias("tip"), F.when(hit(3), "").otherwise(place).alias("pickup_centroid_location"))


def staged_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files, one of which lacks the tips, made one typed table: rows, times, nulls and negatives of each."""
    s = staged_lines(spark, sf_dir)
    parts = [T.clean((s.drop("tip") if f == "R" else s).filter(F.col("l_returnflag") == f), f) for f in ("A", "N", "R")]
    return T.quality(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day with orders: how many, whether it is a federal holiday, and the next day's (holidays computed once a day)."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    marked = days.withColumn("holiday", S.is_federal_holiday(F.col("day")))
    after = marked.select(F.date_sub("day", 1).alias("day"), F.col("holiday").alias("eve"), F.col("orders").alias("orders_after"))
    return marked.join(after, "day", "left").select(F.col("day").cast("string").alias("day"), "orders", "holiday", F.coalesce("eve", F.lit(False)).alias("eve"), S.ratio(F.col("orders_after"), F.col("orders")).alias("ratio")).withColumn("ratio", r6(F.col("ratio")))


def largest_elsewhere(rows: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` of other keys at the same time; null where no other key has one.

    The two largest of each time are enough to leave any key's own out.
    """
    best = F.max(F.struct(F.col(value).alias("v"), F.col(key).alias("k")))
    first = rows.filter(F.col(value).isNotNull()).groupBy(at).agg(best.alias("__a"))
    second = rows.filter(F.col(value).isNotNull()).join(first, at).filter(F.col(key) != F.col("__a.k")).groupBy(at).agg(F.max(value).alias("__b"))
    both = first.join(second, at, "left")
    return rows.join(both, at, "left").withColumn(name, F.when(F.col("__a.k") == F.col(key), F.col("__b")).otherwise(F.col("__a.v"))).drop("__a", "__b")


def peak_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's hours with what the others do: spread score, centres of peaks, the last day's sum, the hour's change."""
    keys = ["key", "dow_mon0", "clock"]
    p = panel(spark, sf_dir)
    z = p.join(M.baseline(p.filter(F.col("hour") < TRAIN_END), keys), keys, "left").withColumn("z", F.round((F.col("n") - F.col("mean")) / F.greatest("std", F.lit(1.0)), 9))
    s = M.spread(largest_elsewhere(z, "key", "hour", "z", "near_z"))
    w = W.series(["key"], "hour")
    out = s.withColumns({"day_sum": W.trailing(F.sum, F.col("n"), w, 24, 2), "change": W.change_share(F.col("n"), w), "top": S.largest(F.col("z"), F.col("near_z"), F.col("ahead"))})
    shown: list[Column] = [r6(F.col(c)).alias(c) for c in ("z", "near_z", "spread", "change", "top")]
    return out.select("key", "hour", *shown, F.coalesce("is_centre", F.lit(False)).alias("is_centre"), "day_sum")


QUERIES = {"m_staged_trips": staged_trips, "m_order_calendar": order_calendar, "m_peak_spread": peak_spread}
SQL = {
    "m_staged_trips": """WITH x AS (SELECT l_returnflag AS source_file, l_orderkey * 7 + l_linenumber AS k, o_orderdate AS d, l_quantity AS q, l_extendedprice AS e, l_discount AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N', 'R')),
      y AS (SELECT *, CASE WHEN k % 89 <> 0 AND k % 83 <> 0 THEN date_trunc('second', d) END AS start, CASE WHEN k % 71 = 0 THEN NULL WHEN k % 73 = 0 THEN -1.5 ELSE e END AS fare, CASE WHEN source_file <> 'R' AND k % 5 <> 0 THEN t END AS tip, CASE WHEN k % 67 = 0 THEN NULL WHEN k % 61 = 0 THEN -60 ELSE q * 60 END AS seconds FROM x)
      SELECT source_file, count(*) AS rows, min(start) AS first, max(start) AS last, count_if(k % 97 = 0) AS trip_id_null, count_if(start IS NULL) AS trip_start_timestamp_null, count_if(fare IS NULL) AS fare_null, count_if(tip IS NULL) AS tip_null, count_if(k % 3 = 0) AS pickup_centroid_location_null,
        count_if(seconds < 0) AS trip_seconds_negative, count_if(q < 0) AS trip_miles_negative, count_if(fare < 0) AS fare_negative, count(*) FILTER (tip < 0) AS tip_negative FROM y GROUP BY 1""",
    "m_order_calendar": """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1), y AS (SELECT DISTINCT year(day) + g AS y FROM d, (SELECT unnest([0, 1]) AS g)),
      fx AS (SELECT make_date(y, m, n) AS h FROM y, (SELECT unnest([{'m': 1, 'n': 1}, {'m': 6, 'n': 19}, {'m': 7, 'n': 4}, {'m': 11, 'n': 11}, {'m': 12, 'n': 25}], recursive := true))),
      mv AS (SELECT CASE WHEN k > 0 THEN f + CAST((w - isodow(f) + 7) % 7 + 7 * (k - 1) AS INT) ELSE last_day(f) - CAST((isodow(last_day(f)) - w + 7) % 7 AS INT) END AS h FROM (SELECT make_date(y, m, 1) AS f, w, k FROM y, (SELECT unnest([{'m': 1, 'w': 1, 'k': 3}, {'m': 2, 'w': 1, 'k': 3}, {'m': 5, 'w': 1, 'k': -1}, {'m': 9, 'w': 1, 'k': 1}, {'m': 10, 'w': 1, 'k': 2}, {'m': 11, 'w': 4, 'k': 4}], recursive := true)))),
      hd AS (SELECT h FROM fx UNION SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END FROM fx UNION SELECT h FROM mv), m AS (SELECT *, day IN (SELECT h FROM hd) AS holiday FROM d)
      SELECT CAST(m.day AS VARCHAR) AS day, m.orders, m.holiday, coalesce(n.holiday, false) AS eve, round(n.orders / m.orders, 6) AS ratio FROM m LEFT JOIN m n ON n.day = m.day + 1""",
    "m_peak_spread": "WITH " + PANEL + f""", base AS (SELECT key, dow, clock, avg(n) AS mean, coalesce(nullif(stddev_samp(n), 0), 1) AS sd FROM panel WHERE hour < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2, 3), zs AS (SELECT key, hour, n, round((n - mean) / greatest(sd, 1), 9) AS z FROM panel LEFT JOIN base USING (key, dow, clock)),
      nz AS (SELECT a.key, a.hour, a.n, a.z, (SELECT max(b.z) FROM zs b WHERE b.hour = a.hour AND b.key <> a.key) AS near_z FROM zs a), ah AS (SELECT *, greatest(lead(near_z, 1) OVER w, lead(near_z, 2) OVER w) AS ahead, sum(n) OVER p AS s, count(n) OVER p AS c, lag(n) OVER w AS before FROM nz WINDOW w AS (PARTITION BY key ORDER BY hour), p AS (PARTITION BY key ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
      SELECT key, hour, round(z, 6) AS z, round(near_z, 6) AS near_z, round(greatest(z, 0) + 0.6::DOUBLE * greatest(near_z, 0) + 0.4::DOUBLE * coalesce(greatest(ahead - near_z, 0), 0), 6) AS spread, CASE WHEN before <> 0 THEN round(least(greatest(n / before - 1, -5), 5), 6) END AS change, round(greatest(z, near_z, ahead), 6) AS top,
        coalesce(z >= 3 AND greatest(near_z, ahead) >= 2 AND z > near_z, false) AS is_centre, CASE WHEN c >= 2 THEN CAST(s AS BIGINT) END AS day_sum FROM ah""",
}
