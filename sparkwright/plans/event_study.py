"""Event studies to the end: arrival and exit scores, their timing and rank, and placebo days that bound what chance gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.operators.ordered import running
from sparkwright.plans import mobility as M
from sparkwright.plans.domain import ANCHOR_SQL, PANEL, anchors, event_hours, panel, r6


def outside(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of ``points`` whose ``at`` lies in no interval from ``start`` to ``end``, both included.

    Starts, points and ends stand in one order, range-partitioned; a running sum counts the intervals that are open at
    each point, so long or many intervals cost a row for each end, not one for each time that they cover. Rows or
    intervals with a null time, and intervals that end before they start, count for nothing.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    own = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__delta"), row.alias("__row"))
    nothing = F.lit(None).cast(own.schema["__row"].dataType).alias("__row")
    real = intervals.filter(F.col(start) <= F.col(end))
    starts = real.select(F.col(start).alias("__t"), F.lit(0).alias("__kind"), F.lit(1).cast("long").alias("__delta"), nothing)
    ends = real.select(F.col(end).alias("__t"), F.lit(2).alias("__kind"), F.lit(-1).cast("long").alias("__delta"), nothing)
    ran = running(own.unionByName(starts).unionByName(ends), ["__t", "__kind"], {"__open": F.col("__delta")}, "__no")
    return ran.filter("__row is not null and __open = 0").select("__row.*")


def placebo_anchors(events: DataFrame, span: DataFrame, offsets: Sequence[int], excluded: DataFrame, days: int = 70, step: int = 7) -> DataFrame:
    """matched, anchor: the times ``step`` days apart within ``days`` of each event that could pass for one.

    ``events``: anchor; ``span``: first and last hour that are known; ``excluded``: start, end of what no window may touch.
    A placebo is on no event's date, its whole window is known and outside.
    """
    shifts = F.explode(F.sequence(F.lit(-days), F.lit(days), F.lit(step))).alias("k")
    shifted = events.select(F.col("anchor").alias("matched"), shifts).filter("k <> 0").withColumn("anchor", F.col("matched") + F.make_dt_interval(F.col("k"))).drop("k")
    free = shifted.withColumn("day", F.to_date("anchor")).join(events.select(F.to_date("anchor").alias("day")).distinct(), "day", "left_anti")
    at = lambda h: F.col("anchor") + F.make_dt_interval(F.lit(0), F.lit(h))
    known = free.crossJoin(F.broadcast(span)).filter((at(min(offsets)) >= F.col("first")) & (at(max(offsets)) <= F.col("last"))).select("matched", "anchor")
    hours = known.select("matched", "anchor", F.explode(F.array(*[at(h) for h in offsets])).alias("hour"))
    whole = outside(hours, "hour", excluded, "start", "end").groupBy("matched", "anchor").count()
    return whole.filter(F.col("count") == len(offsets)).select("matched", "anchor")


def signatures(z: DataFrame, windows: DataFrame, offsets: Sequence[int], arrival: tuple[str, Sequence[int]], leaving: tuple[str, Sequence[int]]) -> DataFrame:
    """``windows`` (matched, anchor, sample) with mean, largest and its hour of robust_z: of the one key before, of the other after.

    ``z``: key, hour, robust_z. Windows that lack an hour of either key are left out; of equal values the earlier hour counts.
    """
    hours = windows.select("*", F.explode(F.array(*[F.lit(h) for h in offsets])).alias("offset")).withColumn("hour", F.col("anchor") + F.make_dt_interval(F.lit(0), F.col("offset")))
    rows = hours.join(z, "hour")
    out = []
    for name, (key, part) in (("arrival", arrival), ("exit", leaving)):
        mine = F.when((F.col("key") == key) & F.col("offset").isin(list(part)), F.col("robust_z"))
        out += [F.avg(mine).alias(f"{name}_score"), F.max(mine).alias(f"{name}_peak"), (-F.max(F.when(mine.isNotNull(), F.struct(mine.alias("z"), (-F.col("offset")).alias("o"))))["o"]).alias(f"{name}_hour")]
    return rows.groupBy("matched", "anchor", "sample").agg(F.count("*").alias("rows"), *out).filter(F.col("rows") == 2 * len(offsets)).drop("rows")


def compared(signed: DataFrame, level: float = 0.95) -> DataFrame:
    """Each event's scores, their rank among events, and how they stand to its placebos: number, threshold, share below."""
    real, placebo = signed.filter("sample = 'event'"), signed.filter("sample = 'placebo'")
    p = lambda c: F.percentile(c, F.lit(level))
    bars = placebo.groupBy("matched").agg(F.count("*").alias("placebos"), p("arrival_score").alias("arrival_p95"), p("exit_score").alias("exit_p95"))
    below = real.select("matched", F.col("arrival_score").alias("a"), F.col("exit_score").alias("e")).join(placebo, "matched").groupBy("matched").agg(F.avg((F.col("arrival_score") < F.col("a")).cast("double")).alias("arrival_share"), F.avg((F.col("exit_score") < F.col("e")).cast("double")).alias("exit_share"))
    ranked = lambda c: F.rank().over(Window.partitionBy("sample").orderBy(F.desc_nulls_last(c))).cast("long")  # noqa: E731  events are few
    of = real.withColumns({"arrival_rank": ranked("arrival_score"), "exit_rank": ranked("exit_score")})
    joined = of.join(bars, "matched", "left").join(below, "matched", "left")
    return joined.withColumns({"placebos": F.coalesce("placebos", F.lit(0)), "arrival_above": F.col("arrival_score") > F.col("arrival_p95"), "exit_above": F.col("exit_score") > F.col("exit_p95")}).drop("matched", "sample")


OFFSETS, ARRIVAL, EXIT = range(-4, 6), ("view", (-3, -2, -1)), ("purchase", (2, 3, 4))


def placebo_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two events against matched placebo days: scores by controls of the same weekday and hour, thresholds, ranks."""
    p = panel(spark, sf_dir).filter(F.col("key").isin(ARRIVAL[0], EXIT[0]))
    span = p.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    events = anchors(spark)
    closed = events.select((F.col("anchor") - F.expr("interval 8 hours")).alias("start"), (F.col("anchor") + F.expr("interval 10 hours")).alias("end"))
    placebos = placebo_anchors(events, span, OFFSETS, closed, days=21)
    windows = events.select(F.col("anchor").alias("matched"), "anchor", F.lit("event").alias("sample")).unionByName(placebos.select("matched", "anchor", F.lit("placebo").alias("sample")))
    hours = windows.select(F.explode(F.array(*[F.col("anchor") + F.make_dt_interval(F.lit(0), F.lit(h)) for h in OFFSETS])).alias("hour")).distinct()
    targets = hours.crossJoin(F.broadcast(p.select("key").distinct()))
    z = M.matched_controls(p, targets, event_hours(spark), days=14, least=2).select("key", F.col("target").alias("hour"), "robust_z")
    c = compared(signatures(z, windows, OFFSETS, ARRIVAL, EXIT))
    numbers = ("arrival_score", "arrival_peak", "exit_score", "exit_peak", "arrival_p95", "exit_p95", "arrival_share", "exit_share")
    return c.select("anchor", *[r6(F.col(x)).alias(x) for x in numbers], "arrival_hour", "exit_hour", "arrival_rank", "exit_rank", "placebos", "arrival_above", "exit_above")


QUERIES = {"m_placebo_comparison": placebo_comparison}
SQL = {
    "m_placebo_comparison": "WITH " + PANEL + ", " + ANCHOR_SQL + """, bad AS (SELECT unnest(generate_series(anchor - INTERVAL 8 HOUR, anchor + INTERVAL 10 HOUR, INTERVAL 1 HOUR)) AS hour FROM anchors), two AS (SELECT * FROM panel WHERE key IN ('view', 'purchase')),
      span AS (SELECT min(hour) AS a, max(hour) AS b FROM two), off AS (SELECT CAST(o AS INT) AS o FROM range(-4, 6) r(o)), cand AS (SELECT anchor AS matched, anchor + to_days(k) AS anchor FROM anchors, (SELECT unnest([-21, -14, -7, 7, 14, 21]) AS k)),
      plac AS (SELECT * FROM cand, span WHERE CAST(anchor AS DATE) NOT IN (SELECT CAST(anchor AS DATE) FROM anchors) AND anchor - INTERVAL 4 HOUR >= a AND anchor + INTERVAL 5 HOUR <= b AND NOT EXISTS (SELECT 1 FROM off, bad WHERE bad.hour = cand.anchor + to_hours(o))),
      wi AS (SELECT anchor AS matched, anchor, 'event' AS sample FROM anchors UNION ALL SELECT matched, anchor, 'placebo' FROM plac), tg AS (SELECT DISTINCT anchor + to_hours(o) AS hour FROM wi, off),
      pr AS (SELECT t.key, t.hour AS target, t.n AS actual, c.n, abs(date_diff('day', c.hour, t.hour)) <= 14 AS near FROM two t JOIN tg USING (hour) JOIN two c ON c.key = t.key AND c.dow = t.dow AND c.clock = t.clock WHERE c.hour NOT IN (FROM bad)),
      us AS (SELECT * FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY key, target) AS c FROM pr) WHERE c < 2 OR near), md AS (SELECT key, target, median(n) AS med FROM us GROUP BY 1, 2),
      z AS (SELECT us.key, us.target AS hour, CASE WHEN median(abs(n - med)) > 0 THEN (any_value(actual) - any_value(med)) / (1.4826 * median(abs(n - med))) END AS z FROM us JOIN md USING (key, target) GROUP BY 1, 2),
      sg AS (SELECT matched, anchor, sample, avg(z) FILTER (key = 'view' AND o IN (-3, -2, -1)) AS sa, max(z) FILTER (key = 'view' AND o IN (-3, -2, -1)) AS pa, arg_max(o, (z, -o)) FILTER (key = 'view' AND o IN (-3, -2, -1) AND z IS NOT NULL) AS ha,
        avg(z) FILTER (key = 'purchase' AND o IN (2, 3, 4)) AS se, max(z) FILTER (key = 'purchase' AND o IN (2, 3, 4)) AS pe, arg_max(o, (z, -o)) FILTER (key = 'purchase' AND o IN (2, 3, 4) AND z IS NOT NULL) AS he FROM wi, off, z WHERE z.hour = anchor + to_hours(o) GROUP BY 1, 2, 3 HAVING count(*) = 20),
      re AS (SELECT *, rank() OVER (ORDER BY sa DESC NULLS LAST) AS ra, rank() OVER (ORDER BY se DESC NULLS LAST) AS rb FROM sg WHERE sample = 'event'), ba AS (SELECT matched, count(*) AS placebos, quantile_cont(sa, 0.95) AS qa, quantile_cont(se, 0.95) AS qe FROM sg WHERE sample = 'placebo' GROUP BY 1),
      be AS (SELECT r.matched, avg(CAST(p.sa < r.sa AS DOUBLE)) AS ba, avg(CAST(p.se < r.se AS DOUBLE)) AS bb FROM re r JOIN sg p ON p.matched = r.matched AND p.sample = 'placebo' GROUP BY 1)
      SELECT anchor, round(sa, 6) AS arrival_score, round(pa, 6) AS arrival_peak, round(se, 6) AS exit_score, round(pe, 6) AS exit_peak, round(qa, 6) AS arrival_p95, round(qe, 6) AS exit_p95, round(be.ba, 6) AS arrival_share, round(bb, 6) AS exit_share,
        ha AS arrival_hour, he AS exit_hour, ra AS arrival_rank, rb AS exit_rank, coalesce(placebos, 0) AS placebos, sa > qa AS arrival_above, se > qe AS exit_above FROM re LEFT JOIN ba USING (matched) LEFT JOIN be USING (matched)"""
}
