"""Hourly panels: counts, completed grids, baselines, scores, features, controls, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions import windows as W
from sparkwright.functions.stats import guarded_corr, robust
from sparkwright.operators.relational import completed


def hourly(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """key, hour, n."""
    return events.groupBy(F.col(key).alias("key"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def panel(events: DataFrame, key: str) -> DataFrame:
    """The completed hourly grid with its calendar."""
    grid = completed(hourly(events, key), ["key"], "hour", ["n"])
    return grid.withColumns({**{("clock" if k == "hour" else k): v for k, v in S.day_numbers(F.col("hour")).items()}, "is_missing_hour": S.is_missing_hour(F.col("hour"))})


def with_neighbours(panel: DataFrame, near: DataFrame) -> DataFrame:
    """near_n: the counts of each key's neighbours (near: key, neighbour), summed from hourly counts, not from events."""
    of = panel.select(F.col("key").alias("neighbour"), "hour", F.col("n").alias("m")).filter("m > 0")
    sums = of.join(near, "neighbour").groupBy("key", "hour").agg(F.sum("m").alias("near_n"), F.count("*").alias("active_near"))
    return panel.join(sums, ["key", "hour"], "left").na.fill(0, ["near_n", "active_near"])


def baseline(train: DataFrame, keys: list[str]) -> DataFrame:
    """mean, std (1 if null or 0) of n by key."""
    return train.groupBy(*keys).agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std")).withColumn("std", F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std")))


def scored(panel: DataFrame, base: DataFrame, keys: list[str], peak: int = 3, least: int = 1, low: float = 1.0) -> DataFrame:
    """Anomaly columns: z, ratio, change of z, velocity, acceleration, peak and low flags, run and its age, trend."""
    w = W.series(["key"], "hour")
    df = panel.join(base, keys, "left").withColumn("z", (F.col("n") - F.col("mean")) / F.greatest("std", F.lit(1.0)))
    df = df.withColumns({"ratio": S.ratio(F.col("n"), F.col("mean")), "z_change": F.col("z") - F.lag("z").over(w), "step": F.col("n") - F.lag("n").over(w), "change_share": W.change_share(F.col("n"), w)})
    df = df.withColumns({"velocity": F.avg("step").over(w.rowsBetween(-2, 0)), "acceleration": F.col("step") - F.lag("step").over(w), "is_peak": (F.col("z") >= peak) & (F.col("n") >= least), "is_low": (F.col("z") <= -peak) & (F.col("mean") >= low) & ~F.col("is_missing_hour")})
    df = df.withColumn("__s", W.run_start(F.col("is_peak"), F.lag("hour").over(w) + F.expr("interval 1 hour") == F.col("hour"), w)).withColumn("run", F.sum("__s").over(w))
    df = df.withColumn("peak_age", F.when(F.col("is_peak"), F.row_number().over(Window.partitionBy("key", "run").orderBy("hour"))).otherwise(0))
    high, fall, rise = F.col("is_peak"), F.col("z_change") <= -1, F.col("z_change") >= 1
    trend = F.when(high & rise, "rapid_high_rise").when(high, "high").when(F.col("is_low") & fall, "rapid_low_drop").when(F.col("is_low"), "low").when(rise, "rising").when(fall, "falling").otherwise("normal")
    return df.withColumn("trend", trend).drop("__s")


def features(panel: DataFrame, lags=(1, 2, 3, 6, 24, 168), spans=(3, 6, 24, 168), leads=(1, 2, 3, 6)) -> DataFrame:
    """Lags, trailing means and deviations without the current hour, cycles, and the targets ahead."""
    w = W.series(["key"], "hour")
    n = F.col("n")
    out = {f"lag_{k}": F.lag("n", k).over(w) for k in lags} | {f"lead_{k}": F.lead("n", k).over(w) for k in leads}
    out |= {f"mean_{k}": W.trailing(F.avg, n, w, k, max(2, k // 3)) for k in spans} | {f"std_{k}": W.trailing(F.stddev_samp, n, w, k, max(2, k // 3)) for k in spans}
    for name, c, period in (("clock", F.col("clock"), 24), ("day", F.col("dow_mon0"), 7), ("year", F.col("day_of_year"), 365.25)):
        out[f"{name}_sin"], out[f"{name}_cos"] = S.cyclical(c, period)
    out |= {f"naive_{h}": F.lag("n", 168 - h).over(w) for h in leads}
    return panel.withColumns(out)


def horizon_errors(features: DataFrame, leads=(1, 2, 3, 6)) -> DataFrame:
    """For each horizon, how far the current value and last week's value are from what comes."""
    wide = features.select(*[x for h in leads for x in (F.col(f"lead_{h}"), F.col(f"naive_{h}"))], "n")
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"lead_{h}").alias("y"), F.col("n").alias("now"), F.col(f"naive_{h}").alias("week")) for h in leads])
    rows = wide.select(F.explode(parts).alias("r")).select("r.*").filter("y is not null and week is not null")
    e = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    return rows.groupBy("horizon").agg(F.count("*").alias("rows"), e("now").alias("mae_now"), e("week").alias("mae_week"), F.sqrt(F.avg(F.pow(F.col("now") - F.col("y"), 2))).alias("rmse_now"))


def lag_correlations(a: DataFrame, b: DataFrame, most: int = 6) -> DataFrame:
    """lag, r of b's count with a's count that many hours earlier (a, b: hour, n)."""
    shifted = a.select(F.col("hour").alias("at"), F.col("n").alias("x")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("hour", F.col("at") + F.make_dt_interval(F.lit(0), F.col("lag")))
    return shifted.join(b.select("hour", F.col("n").alias("y")), "hour").groupBy("lag").agg(F.count("*").alias("hours"), guarded_corr("x", "y").alias("r"))


def spread(panel: DataFrame) -> DataFrame:
    """Spatial spread of a peak from a key to its neighbours; ``panel`` has z and near_z."""
    w = W.series(["key"], "hour")
    up = lambda c: F.greatest(c, F.lit(0.0))
    ahead = F.greatest(F.lead("near_z", 1).over(w), F.lead("near_z", 2).over(w))
    df = panel.withColumn("ahead", ahead).withColumn("spread", up(F.col("z")) + 0.6 * up(F.col("near_z")) + 0.4 * F.coalesce(up(F.col("ahead") - F.col("near_z")), F.lit(0.0)))
    return df.withColumn("is_centre", (F.col("z") >= 3) & (F.greatest("near_z", "ahead") >= 2) & (F.col("z") > F.col("near_z")))


def matched_controls(panel: DataFrame, targets: DataFrame, excluded: DataFrame, days: int = 70, least: int = 10) -> DataFrame:
    """Each target hour (key, hour) against the same weekday and clock hour of other days.

    Controls lie within ``days``, or anywhere if that gives less than ``least``; hours in ``excluded`` (hour) are none.
    Equal key, weekday and clock hour make the join's key; the distance in days is a condition on it.
    """
    keys = ["key", "dow_mon0", "clock"]
    of = targets.select("key", F.col("hour").alias("target")).join(panel.select(*keys, F.col("hour").alias("target"), F.col("n").alias("actual")), ["key", "target"])
    controls = panel.join(excluded.select("hour").distinct(), "hour", "left_anti").select(*keys, F.col("hour").alias("control"), "n")
    pairs = of.join(controls, keys).withColumn("near", F.abs(F.datediff("target", "control")) <= days)
    some = pairs.groupBy("key", "target").agg(F.count_if("near").alias("c"))
    used = pairs.join(some, ["key", "target"]).filter((F.col("c") < least) | F.col("near"))
    stats = used.groupBy("key", "target", "actual").agg(F.count("*").alias("controls"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.percentile("n", F.lit(0.05)).alias("p05"), F.percentile("n", F.lit(0.95)).alias("p95"), (100 * F.avg((F.col("n") <= F.col("actual")).cast("double"))).alias("percentile"))
    scale = robust(used, ["key", "target"], "n").drop("n")
    out = stats.join(scale, ["key", "target"])
    return out.withColumns({"robust_z": S.ratio(F.col("actual") - F.col("median"), F.col("scale")), "z": S.ratio(F.col("actual") - F.col("mean"), F.col("std")), "lift": 100 * (S.ratio(F.col("actual"), F.col("mean")) - 1)})


def normal_profile(panel: DataFrame, least: int = 8, floor: float = 5.0) -> DataFrame:
    """median and scale by month, weekday and clock hour; months beside it where fewer than ``least`` days are there."""
    base = panel.select(F.month("hour").alias("month_"), "dow_mon0", "clock", "n")
    months = base.select("month_", "dow_mon0", "clock").distinct()
    near = months.withColumnRenamed("month_", "m").join(base.withColumnRenamed("month_", "o"), ["dow_mon0", "clock"]).withColumn("d", S.month_distance(F.col("m"), F.col("o"))).filter("d <= 1")
    few = near.groupBy("m", "dow_mon0", "clock").agg(F.count_if(F.col("d") == 0).alias("own"))
    used = near.join(few, ["m", "dow_mon0", "clock"]).filter((F.col("own") < least) | (F.col("d") == 0)).select(F.col("m").alias("month"), "dow_mon0", "clock", "n")
    r = robust(used, ["month", "dow_mon0", "clock"], "n").drop("n")
    return r.withColumn("scale", F.greatest("scale", F.sqrt(F.col("median") + 1), F.lit(floor)))


def log_excess(panel: DataFrame, profile: DataFrame) -> DataFrame:
    of = panel.withColumn("month", F.month("hour")).join(profile, ["month", "dow_mon0", "clock"])
    return of.withColumn("excess", F.log1p("n") - F.log1p("median"))


def around(panel: DataFrame, anchors: DataFrame, before: int = 6, after: int = 8) -> DataFrame:
    """anchor, offset, n for the hours around each anchor (anchor) whose window is whole."""
    offsets = anchors.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("hour", F.col("anchor") + F.make_dt_interval(F.lit(0), F.col("offset")))
    rows = panel.join(offsets, "hour")
    whole = rows.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") == before + after + 1).select("anchor")
    return rows.join(whole, "anchor")


def template(windows: DataFrame, value: str = "excess") -> DataFrame:
    return windows.groupBy("offset").agg(F.avg(value).alias("effect"), F.median(value).alias("median_effect"), F.stddev_samp(value).alias("std_effect"), F.count("*").alias("windows"))


def window_features(windows: DataFrame, shape: DataFrame, value: str = "excess") -> DataFrame:
    """Cosine and correlation of each anchor's window with the template, its mean and largest value, its peak's offset."""
    j = windows.join(shape.select("offset", "effect"), "offset")
    x, y = F.col(value), F.col("effect")
    return j.groupBy("anchor").agg(S.ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"), guarded_corr(value, "effect").alias("r"), F.avg(x).alias("mean"), F.max(x).alias("top"), F.max_by("offset", F.struct(x, -F.col("offset"))).alias("peak_offset"))


def economics(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means and second moments by key, in one pass."""
    return rows.groupBy(*keys).agg(F.count("*").alias("trips"), *[f for v in values for f in (F.avg(v).alias(f"mean_{v}"), F.avg(F.col(v) * F.col(v)).alias(f"square_{v}"))])


def lognormal(mean: Column, square: Column, spread: float = 0.45) -> tuple[Column, Column]:
    """mu and sigma of a lognormal from its first two moments; ``spread`` where they do not allow one."""
    cv2 = F.try_divide(square, mean * mean) - 1
    var = F.log1p(F.when(cv2 > 0, cv2).otherwise(F.lit(spread**2)))
    return F.log(mean) - var / 2, F.sqrt(var)


def residual_walk(panel: DataFrame, value: str = "excess", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """By key: the lag-1 correlation and population deviation of residuals clipped to their percentiles."""
    edges = panel.groupBy("key").agg(F.percentile(value, F.lit(low)).alias("a"), F.percentile(value, F.lit(high)).alias("b"))
    w = W.series(["key"], "hour")
    r = panel.join(edges, "key").withColumn("x", F.least(F.greatest(value, "a"), "b")).withColumn("y", F.lag("x").over(w))
    return r.groupBy("key").agg(F.stddev_pop("x").alias("std"), F.min("a").alias("low"), F.max("b").alias("high"), guarded_corr("x", "y").alias("phi"))
