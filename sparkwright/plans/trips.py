"""Trips between places: their features and filters, rates with a fallback, flows of two sides, representatives, best lags.

Order lines stand in for trips (from the customer's nation to the supplier's, in the time from order to shipment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions.stats import guarded_corr
from sparkwright.plans.domain import CORR, PANEL, panel, r6, table


def trip_features(trips: DataFrame) -> DataFrame:
    """``trips`` (origin, destination, start, end, distance, fare) with what a model of them looks at.

    seconds; speed a 3,600 seconds (null for a trip that takes none); same_place; crosses_date; log_fare (null below 0);
    fare_per_distance (null for none); clock, weekday, month of the start. Nulls give nulls.
    """
    seconds = (S.micros(F.col("end")) - S.micros(F.col("start"))) / F.lit(1e6)
    return trips.withColumns({
        "seconds": seconds, "speed": S.ratio(F.col("distance") * 3600.0, seconds), "same_place": F.col("origin") == F.col("destination"), "crosses_date": F.to_date("start") != F.to_date("end"),
        "log_fare": F.when(F.col("fare") >= 0, F.log1p("fare")), "fare_per_distance": S.ratio(F.col("fare"), F.col("distance")), "clock": F.hour("start"), "weekday": F.weekday("start"), "month": F.month("start")})


def plausible(bands: dict[str, tuple[float, float]], distinct_places: bool = False) -> Column:
    """All columns within their bands, both ends included; nulls are not plausible. With ``distinct_places`` round trips go too."""
    out = F.lit(True)
    for name, (low, high) in bands.items():
        out = out & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return out & ~F.coalesce(F.col("same_place"), F.lit(False)) if distinct_places else out


def rates(rows: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """For every combination of ``keys`` that occurs: mean and n of the first level with ``least`` rows, and that level.

    Level 0 is all keys, each next one drops the first of those that are left, the last is the whole table (which is taken
    however few its rows). Each level's sums come from the one before, so rows are read once.
    """
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    out, level = sums.select(*keys, F.array(F.struct(F.col("s"), F.col("c"))).alias("levels")), sums
    for i in range(1, len(keys) + 1):
        rest = keys[i:]
        level = level.groupBy(*rest).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        name = level.select(*[F.col(k).alias(f"__{k}") for k in rest], F.struct("s", "c").alias("next"))
        joined = out.join(F.broadcast(name)) if not rest else out.join(name, [out[k].eqNullSafe(name[f"__{k}"]) for k in rest])
        out = joined.select(*keys, F.array_append("levels", F.col("next")).alias("levels"))
    enough = F.filter(F.transform("levels", lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"), x["c"].alias("c"))), lambda x: (x["c"] >= least) | (x["i"] == len(keys)))[0]
    return out.select(*keys, S.ratio(enough["s"], enough["c"]).alias("rate"), enough["c"].alias("n"), enough["i"].alias("level"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Null where the weights sum to 0; rows with a null in either count for nothing."""
    both = x.isNotNull() & w.isNotNull()
    return S.ratio(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))


def coverage(x: Column, low: Column, high: Column) -> Column:
    """The share of rows within their interval, ends included."""
    return F.avg(x.between(low, high).cast("double"))


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` with the most frequent value (of equally frequent ones the smallest) and its count; nulls are no value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias("mode"), (-F.col("b.c")).alias("count"))


def representatives(rows: DataFrame, keys: list[str], value: str, ident: str, shares: tuple[float, ...]) -> DataFrame:
    """For each of ``keys`` and share, the quantile of ``value`` and the row (``ident``) nearest to it, ties to the smaller."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("q")).select(*keys, F.posexplode("q").alias("at", "quantile"))
    off = F.abs(F.col(value) - F.col("quantile"))
    near = rows.join(F.broadcast(q), keys).groupBy(*keys, "at", "quantile").agg(F.min(F.struct(off.alias("off"), F.col(ident).alias("id"), F.col(value).alias("v"))).alias("b"))
    return near.select(*keys, F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1).alias("share"), "quantile", F.col("b.id").alias(ident), F.col("b.v").alias(value))


def two_sided(out_rows: DataFrame, in_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both sides by ``keys``: each side is summed where it lies, padded with zeros, and the union summed again."""
    side = lambda df, a, b: df.groupBy(*keys).agg(F.count("*").alias("c")).select(*keys, (F.col("c") * a).alias("left_here"), (F.col("c") * b).alias("came_here"))
    both = side(out_rows, 1, 0).unionByName(side(in_rows, 0, 1))
    return both.groupBy(*keys).agg(F.sum("left_here").alias("left_here"), F.sum("came_here").alias("came_here"))


def best_lags(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each of ``keys`` the lag (of ``pairs``: keys, lag, x, y) with the largest correlation, smaller lags first; none without one."""
    r = pairs.groupBy(*keys, "lag").agg(guarded_corr("x", "y").alias("r"), F.count("*").alias("hours")).filter("r is not null")
    first = Window.partitionBy(*keys).orderBy(F.desc(F.round("r", 9)), "lag")
    return r.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("origin"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("destination"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("start"))
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.col("l_shipdate").alias("end"), F.col("l_quantity").alias("distance"), F.col("l_extendedprice").alias("fare"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"))
    return x.join(o, "o_orderkey").join(c, "o_custkey").join(s, "l_suppkey")


BANDS = {"fare": (1_000.0, 90_000.0), "distance": (2.0, 49.0), "speed": (0.0, 5.0)}


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By flag and month: how many trips are plausible, and their speed, places, dates and fares."""
    t = trip_features(lines(spark, sf_dir)).withColumn("kept", plausible(BANDS, distinct_places=True))
    own = lambda c: F.when(F.col("kept"), c)
    g = t.groupBy("flag", "month").agg(F.count("*").alias("trips"), F.count_if("kept").alias("kept"), F.avg(F.col("same_place").cast("double")).alias("same_place"), F.avg(F.col("crosses_date").cast("double")).alias("crosses_date"), F.avg(own(F.col("speed"))).alias("speed"), F.avg(own(F.col("log_fare"))).alias("log_fare"), F.avg(own(F.col("fare_per_distance"))).alias("fare_per_distance"))
    return g.select("flag", F.col("month").cast("int").alias("month"), "trips", "kept", *[r6(F.col(c)).alias(c) for c in ("same_place", "crosses_date", "speed", "log_fare", "fare_per_distance")])


def fallback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts by origin, destination and month, or by fewer of them where lines are few; how far the lines bear them out."""
    x = lines(spark, sf_dir).select("origin", "destination", F.month("start").alias("month"), F.col("discount").cast("double").alias("d"))
    keys = ["origin", "destination", "month"]
    rate = rates(x, keys, "d", 12)
    g = x.join(rate, keys).groupBy("level").agg(F.count("*").alias("lines"), F.countDistinct(*keys).alias("keys"), weighted_mean(F.col("rate"), F.col("n")).alias("rate"), F.min("n").alias("least"), coverage(F.col("d"), F.col("rate") - 0.0253711, F.col("rate") + 0.0253711).alias("inside"))
    return g.select("level", "lines", "keys", r6(F.col("rate")).alias("rate"), "least", r6(F.col("inside")).alias("inside"))


def order_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each priority the orders nearest to three quantiles of the total, with the most frequent weekday of its orders."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.weekday("o_orderdate").alias("day"))
    q = representatives(o, ["o_orderpriority"], "o_totalprice", "o_orderkey", (0.1, 0.5, 0.9))
    return q.join(mode(o, ["o_orderpriority"], "day"), "o_orderpriority").select("o_orderpriority", "share", r6(F.col("quantile")).alias("quantile"), "o_orderkey", "o_totalprice", F.col("mode").cast("int").alias("usual_day"), "count")


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that leave and that reach each nation by month, and the logarithm of their ratio (of the sums, not its mean)."""
    x = lines(spark, sf_dir)
    f = two_sided(x.select(F.col("origin").alias("nation"), F.month("start").alias("month")), x.select(F.col("destination").alias("nation"), F.month("end").alias("month")), ["nation", "month"])
    g = f.rollup("nation", "month").agg(F.sum("left_here").alias("left_here"), F.sum("came_here").alias("came_here"), F.grouping_id().alias("level"))
    return g.select("nation", F.col("month").cast("int").alias("month"), "left_here", "came_here", r6(F.log1p("came_here") - F.log1p("left_here")).alias("excess"), F.col("level").cast("int").alias("level"))


def key_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type, on weekdays and weekends, the lag of up to six hours at which views foretell it best."""
    p = panel(spark, sf_dir)
    x = p.filter("key = 'view'").select(F.col("hour").alias("at"), F.col("n").alias("x")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("hour", F.col("at") + F.make_dt_interval(F.lit(0), F.col("lag")))
    pairs = p.filter("key <> 'view'").select("key", (F.weekday("hour") >= 5).alias("weekend"), "hour", F.col("n").alias("y")).join(x, "hour")
    return best_lags(pairs, ["key", "weekend"]).select("key", "weekend", "lag", "hours", r6(F.col("r")).alias("r"))


QUERIES = {"m_line_features": line_features, "m_fallback_rates": fallback_rates, "m_order_representatives": order_representatives, "m_nation_flows": nation_flows, "m_key_lags": key_lags}
LINES = """x AS (SELECT c_nationkey AS origin, s_nationkey AS destination, o_orderdate AS a, l_shipdate AS b, l_quantity AS distance, l_extendedprice AS fare, l_returnflag AS flag, CAST(l_discount AS DOUBLE) AS d
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
SQL = {
    "m_line_features": "WITH " + LINES + """, s AS (SELECT *, (epoch_us(b) - epoch_us(a)) / 1e6 AS seconds FROM x), t AS (SELECT *, CASE WHEN seconds <> 0 THEN distance * 3600.0 / seconds END AS speed FROM s),
      k AS (SELECT *, coalesce(fare BETWEEN 1000 AND 90000 AND distance BETWEEN 2 AND 49 AND speed BETWEEN 0 AND 5, false) AND origin <> destination AS kept FROM t)
      SELECT flag, CAST(month(a) AS INT) AS month, count(*) AS trips, count(*) FILTER (kept) AS kept, round(avg(CAST(origin = destination AS DOUBLE)), 6) AS same_place, round(avg(CAST(CAST(a AS DATE) <> CAST(b AS DATE) AS DOUBLE)), 6) AS crosses_date,
        round(avg(speed) FILTER (kept), 6) AS speed, round(avg(ln(1 + fare)) FILTER (kept), 6) AS log_fare, round(avg(CASE WHEN distance <> 0 THEN fare / distance END) FILTER (kept), 6) AS fare_per_distance FROM k GROUP BY 1, 2""",
    "m_fallback_rates": "WITH " + LINES + """, k AS (SELECT origin, destination, month(a) AS month, d FROM x), l0 AS (SELECT origin, destination, month, avg(d) AS r, count(*) AS c FROM k GROUP BY 1, 2, 3), l1 AS (SELECT destination, month, avg(d) AS r, count(*) AS c FROM k GROUP BY 1, 2),
      l2 AS (SELECT month, avg(d) AS r, count(*) AS c FROM k GROUP BY 1), l3 AS (SELECT avg(d) AS r, count(*) AS c FROM k), p AS (SELECT l0.origin, l0.destination, l0.month, CASE WHEN l0.c >= 12 THEN 0 WHEN l1.c >= 12 THEN 1 WHEN l2.c >= 12 THEN 2 ELSE 3 END AS level,
        CASE WHEN l0.c >= 12 THEN l0.r WHEN l1.c >= 12 THEN l1.r WHEN l2.c >= 12 THEN l2.r ELSE l3.r END AS rate, CASE WHEN l0.c >= 12 THEN l0.c WHEN l1.c >= 12 THEN l1.c WHEN l2.c >= 12 THEN l2.c ELSE l3.c END AS n
        FROM l0 JOIN l1 USING (destination, month) JOIN l2 USING (month), l3)
      SELECT CAST(level AS INT) AS level, count(*) AS lines, count(DISTINCT (origin, destination, month)) AS keys, round(sum(rate * n) / sum(n), 6) AS rate, min(n) AS least, round(avg(CAST(d BETWEEN rate - 0.0253711::DOUBLE AND rate + 0.0253711::DOUBLE AS DOUBLE)), 6) AS inside FROM k JOIN p USING (origin, destination, month) GROUP BY 1""",
    "m_order_representatives": """WITH o AS (SELECT o_orderpriority, o_orderkey, o_totalprice, isodow(o_orderdate) - 1 AS day FROM orders), q AS (SELECT o_orderpriority, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS share, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) AS quantile FROM o GROUP BY 1),
      n AS (SELECT q.*, o_orderkey, o_totalprice FROM q JOIN o USING (o_orderpriority) QUALIFY row_number() OVER (PARTITION BY o_orderpriority, share ORDER BY abs(o_totalprice - quantile), o_orderkey) = 1),
      d AS (SELECT o_orderpriority, day, count(*) AS c FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, day) = 1)
      SELECT o_orderpriority, share, round(quantile, 6) AS quantile, o_orderkey, o_totalprice, CAST(day AS INT) AS usual_day, c AS count FROM n JOIN d USING (o_orderpriority)""",
    "m_nation_flows": "WITH " + LINES + """, f AS (SELECT nation, month, sum(o) AS o, sum(i) AS i FROM (SELECT origin AS nation, month(a) AS month, 1 AS o, 0 AS i FROM x UNION ALL SELECT destination, month(b), 0, 1 FROM x) GROUP BY 1, 2)
      SELECT nation, CAST(month AS INT) AS month, CAST(sum(o) AS BIGINT) AS left_here, CAST(sum(i) AS BIGINT) AS came_here, round(ln(1 + sum(i)) - ln(1 + sum(o)), 6) AS excess, CAST(grouping(nation, month) AS INT) AS level FROM f GROUP BY ROLLUP (nation, month)""",
    "m_key_lags": "WITH " + PANEL + f""", j AS (SELECT b.key, isodow(b.hour) >= 6 AS weekend, CAST(l AS INT) AS lag, CAST(a.n AS DOUBLE) AS x, CAST(b.n AS DOUBLE) AS y FROM panel b, range(0, 7) r(l) JOIN panel a ON a.key = 'view' AND a.hour = b.hour - to_hours(CAST(l AS INT)) WHERE b.key <> 'view'),
      c AS (SELECT key, weekend, lag, count(*) AS hours, {CORR.format(x='x', y='y')} AS r FROM j GROUP BY 1, 2, 3) SELECT key, weekend, lag, hours, round(r, 6) AS r FROM c WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, weekend ORDER BY round(r, 9) DESC, lag) = 1""",
}
