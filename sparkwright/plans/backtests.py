"""Backtests by origin and horizon, and a blind scan for events: candidates, matches, precision and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions import windows as W
from sparkwright.functions.stats import regression_metrics
from sparkwright.operators import relational as R
from sparkwright.plans import mobility as M
from sparkwright.plans.domain import ANCHORS, PANEL, TRAIN_END, anchors, panel, r6


def hours_of(c: Column) -> Column:
    """Whole hours since 1970."""
    return F.floor(S.micros(c) / F.lit(3_600_000_000)).cast("long")


def origins(panel: DataFrame, every: int, before: int, ahead: int) -> DataFrame:
    """origin: each ``every``-th hour of the panel, counted from its first, with ``before`` hours behind it and ``ahead`` from it on."""
    span = panel.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    known = panel.select("hour").distinct().crossJoin(F.broadcast(span))
    since, left = hours_of(F.col("hour")) - hours_of(F.col("a")), hours_of(F.col("b")) - hours_of(F.col("hour"))
    return known.filter((F.pmod(since, F.lit(every)) == 0) & (since >= before) & (left >= ahead - 1)).select(F.col("hour").alias("origin"))


def at_horizons(panel: DataFrame, origins: DataFrame, horizons: int, keep: Sequence[str] = ()) -> DataFrame:
    """key, origin, horizon, target, label and ``keep`` as they are at the origin, one row for each horizon.

    Horizon 1 is the origin itself, horizon h the hour h - 1 later. Rows whose target the panel lacks, or has as null, are
    left out; a (key, hour) that repeats in the panel raises.
    """
    at = panel.join(F.broadcast(origins.distinct()), F.col("hour") == F.col("origin")).select("key", "origin", *keep)
    rows = at.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("target", F.col("origin") + F.make_dt_interval(F.lit(0), F.col("horizon") - 1))
    future = panel.select("key", F.col("hour").alias("target"), F.col("n").alias("label"))
    return R.joined_once(rows, future, ["key", "target"]).filter("label is not null")


def aligned(left: DataFrame, right: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Both sides' forecasts by ``keys``; raises unless each row of ``left`` has its row in ``right`` with the same label."""
    other = right.withColumnRenamed(label, "__label").withColumn("__there", F.lit(True))
    both = R.joined_once(left, other, keys)
    bad = both.agg(F.count_if(F.col("__there").isNull()).alias("missing"), F.count_if(~F.col(label).eqNullSafe(F.col("__label")) & F.col("__there").isNotNull()).alias("different")).first()
    if bad["missing"] or bad["different"]:
        raise ValueError(f"{bad['missing']} rows lack their partner, {bad['different']} have another label")
    return both.drop("__label", "__there")


def backtest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By horizon and model, errors over all keys and origins: last value, last week's, and the training profile."""
    p = panel(spark, sf_dir)
    at = origins(p, 13, 168, 24)
    last = p.select("key", "hour", "n").withColumn("value_before", F.lag("n").over(W.series(["key"], "hour")))
    rows = at_horizons(last, at, 24, ["value_before"])
    week = p.select("key", (F.col("hour") + F.expr("interval 168 hours")).alias("target"), F.col("n").alias("week"))
    base = M.baseline(p.filter(F.col("hour") < TRAIN_END), ["key", "dow_mon0", "clock"]).select("key", "dow_mon0", "clock", F.col("mean").alias("profile"))
    seen = at_horizons(p, at, 24).join(week, ["key", "target"])
    typical = at_horizons(p, at, 24).withColumns({"dow_mon0": F.weekday("target"), "clock": F.hour("target")}).join(base, ["key", "dow_mon0", "clock"], "left").select("key", "origin", "horizon", "label", F.coalesce("profile", F.lit(0.0)).alias("profile"))
    keys = ["key", "origin", "horizon"]
    both = aligned(aligned(rows, seen.select(*keys, "label", "week"), keys, "label"), typical, keys, "label")
    models = F.explode(F.create_map(*[x for m, c in (("last", "value_before"), ("week", "week"), ("profile", "profile")) for x in (F.lit(m), F.col(c).cast("double"))])).alias("model", "p")
    long = both.select("horizon", F.col("label").cast("double").alias("y"), models)
    e = long.groupBy("model", "horizon").agg(*regression_metrics("y", "p"))
    return e.select("model", "horizon", "n", *[r6(F.col(c)).alias(c) for c in ("mae", "rmse", "wape", "bias")])


def scan_features(z: DataFrame, parts: dict[str, tuple[str, Sequence[int]]]) -> DataFrame:
    """hour and, for each part, the mean z of its key over its offsets, for hours that have them all.

    ``z``: key, hour, z. Each value is sent to the hours that it counts for, so no hour is joined with its window.
    """
    of = {key: sorted({-o for k, offsets in parts.values() if k == key for o in offsets}) for key, _ in parts.values()}
    shifts = None
    for key, back in of.items():
        own = F.array(*[F.lit(o) for o in back])
        shifts = F.when(F.col("key") == key, own) if shifts is None else shifts.when(F.col("key") == key, own)
    sent = z.filter(F.col("key").isin(list(of)) & F.col("z").isNotNull()).select("key", "z", "hour", F.explode(shifts).alias("back")).withColumn("hour", F.col("hour") + F.make_dt_interval(F.lit(0), F.col("back")))
    mine = {name: F.when((F.col("key") == key) & F.col("back").isin([-o for o in offsets]), F.col("z")) for name, (key, offsets) in parts.items()}
    rows = sent.groupBy("hour").agg(*[F.avg(m).alias(name) for name, m in mine.items()], *[F.count(m).alias(f"__{name}") for name, m in mine.items()])
    for name, (_, offsets) in parts.items():
        rows = rows.filter(F.col(f"__{name}") == len(set(offsets))).drop(f"__{name}")
    return rows


def detections(scores: DataFrame, gap: float, most: int) -> DataFrame:
    """at (hours since 1970), score, place (from 1): the highest of ``scores`` (hour, score), no two within ``gap`` hours."""
    from pyspark.sql import Window

    found = R.separated(scores.select(hours_of(F.col("hour")).cast("double").alias("at"), "score"), "at", "score", gap, most)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "at")))  # at most ``most`` rows


def quality_at(found: DataFrame, events: DataFrame, within: float, ks: Sequence[int]) -> DataFrame:
    """k, hits, precision, recall of the first k detections; an event (at, in hours) is hit by the nearest one ``within`` hours."""
    pairs = R.matched(found.select("at", "place"), events.select(F.col("at").cast("double").alias("event_at")), "at", "event_at", within, "place").select(F.col("at").alias("hit_at"))
    marked = found.join(pairs, found["at"] == pairs["hit_at"], "left")
    rows = marked.crossJoin(F.broadcast(events.agg(F.count("*").alias("events")))).select("place", "events", F.col("hit_at").isNotNull().alias("hit"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter("place <= k")
    return rows.groupBy("k", "events").agg(F.count("*").alias("found"), F.count_if("hit").alias("hits")).select("k", "found", "hits", (F.col("hits") / F.col("found")).alias("precision"), S.ratio(F.col("hits"), F.col("events")).alias("recall"))


PARTS = {"arrival": ("view", (-3, -2, -1)), "leaving": ("purchase", (2, 3, 4))}


def blind_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour scored by how unusual arrivals before and departures after it are; the best, apart, against the known events."""
    p = panel(spark, sf_dir)
    z = p.withColumn("month", F.month("hour")).join(M.normal_profile(p, least=3, floor=1.0).select("month", "dow_mon0", "clock", "median", "scale"), ["month", "dow_mon0", "clock"]).select("key", "hour", ((F.col("n") - F.col("median")) / F.col("scale")).alias("z"))
    scores = scan_features(z, PARTS).select("hour", F.round(0.6 * F.col("arrival") + 0.4 * F.col("leaving"), 6).alias("score"))
    known = anchors(spark).select(hours_of(F.col("anchor")).alias("at"))
    return quality_at(detections(scores, 18.0, 12), known, 6.0, (4, 8, 12)).select("k", "found", "hits", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


QUERIES = {"m_backtest_errors": backtest_errors, "m_blind_scan": blind_scan}
ERRORS = ", ".join(f"round({e}, 6) AS {n}" for n, e in (("mae", "avg(abs(p - y))"), ("rmse", "sqrt(avg((p - y) * (p - y)))"), ("wape", "CASE WHEN sum(abs(y)) <> 0 THEN sum(abs(p - y)) / sum(abs(y)) END"), ("bias", "avg(p - y)")))
SQL = {
    "m_backtest_errors": "WITH " + PANEL + f""", span AS (SELECT min(hour) AS a, max(hour) AS b FROM panel), og AS (SELECT DISTINCT hour AS origin FROM panel, span WHERE date_diff('hour', a, hour) % 13 = 0 AND date_diff('hour', a, hour) >= 168 AND date_diff('hour', hour, b) >= 23),
      bl AS (SELECT key, dow, clock, avg(n) AS profile FROM panel WHERE hour < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2, 3), la AS (SELECT key, hour, lag(n) OVER (PARTITION BY key ORDER BY hour) AS before FROM panel),
      x AS (SELECT t.key, origin, CAST(h AS INT) AS horizon, CAST(t.n AS DOUBLE) AS y, before, w.n AS week, coalesce(profile, 0) AS profile FROM og, range(1, 25) r(h) JOIN panel t ON t.hour = origin + to_hours(CAST(h - 1 AS INT)) JOIN la ON la.key = t.key AND la.hour = origin
        JOIN panel w ON w.key = t.key AND w.hour = t.hour - INTERVAL 168 HOUR LEFT JOIN bl ON bl.key = t.key AND bl.dow = t.dow AND bl.clock = t.clock)
      SELECT model, horizon, count(*) AS n, {ERRORS} FROM (SELECT horizon, y, unnest([{{'m': 'last', 'p': CAST(before AS DOUBLE)}}, {{'m': 'week', 'p': CAST(week AS DOUBLE)}}, {{'m': 'profile', 'p': profile}}], recursive := true) FROM x) u(horizon, y, model, p) GROUP BY 1, 2""",
    "m_blind_scan": "WITH RECURSIVE " + PANEL + f""", mid AS (SELECT dow, clock, median(n) AS med FROM panel GROUP BY 1, 2), dev AS (SELECT dow, clock, any_value(med) AS med, greatest(1.4826 * median(abs(n - med)), sqrt(any_value(med) + 1), 1.0) AS scale FROM panel JOIN mid USING (dow, clock) GROUP BY 1, 2),
      z AS (SELECT key, hour, (n - med) / scale AS z FROM panel JOIN dev USING (dow, clock)), ft AS (SELECT h.hour, avg(z) FILTER (key = 'view' AND o BETWEEN -3 AND -1) AS arrival, avg(z) FILTER (key = 'purchase' AND o BETWEEN 2 AND 4) AS leaving,
        count(*) FILTER (key = 'view' AND o BETWEEN -3 AND -1) AS ca, count(*) FILTER (key = 'purchase' AND o BETWEEN 2 AND 4) AS cl FROM (SELECT DISTINCT hour FROM panel) h, range(-3, 5) r(o) JOIN z ON z.hour = h.hour + to_hours(CAST(o AS INT)) GROUP BY 1),
      sc AS MATERIALIZED (SELECT CAST(epoch_us(hour) // 3600000000 AS BIGINT) AS hr, round(0.6 * arrival + 0.4 * leaving, 6) AS score FROM ft WHERE ca = 3 AND cl = 3),
      pick(k, chosen) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL SELECT k + 1, list_append(chosen, (SELECT arg_max(hr, (score, -hr)) FROM sc WHERE len(list_filter(chosen, lambda c: abs(c - hr) < 18)) = 0)) FROM pick WHERE k < 12),
      fo AS (SELECT chosen[k] AS hr, k AS place FROM pick WHERE chosen[k] IS NOT NULL), ev AS (SELECT unnest([{', '.join(f"epoch_us(TIMESTAMP '{a}') // 3600000000" for a in ANCHORS)}]) AS e),
      hit AS (SELECT hr, e FROM fo JOIN ev ON abs(hr - e) <= 6 QUALIFY row_number() OVER (PARTITION BY e ORDER BY abs(hr - e), place) = 1)
      SELECT CAST(k AS INT) AS k, count(*) AS found, count(hit.hr) AS hits, round(count(hit.hr) / count(*), 6) AS precision, round(count(hit.hr) / 2, 6) AS recall FROM (SELECT unnest([4, 8, 12]) AS k) JOIN fo ON place <= k LEFT JOIN hit USING (hr) GROUP BY 1""",
}
