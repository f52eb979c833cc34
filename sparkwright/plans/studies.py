"""Studies on the hourly panel and on places: weather, peaks and their evidence, ablations, zones, explanations.

Each operator takes DataFrames; each query below applies one to the test tables (events by type and hour stand in for
trips, suppliers for places) and has its SQL of DuckDB in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions import stats
from sparkwright.functions import windows as W
from sparkwright.functions.text import without_fence
from sparkwright.operators import relational as R
from sparkwright.operators.ordered import numbered
from sparkwright.plans import mobility as M
from sparkwright.plans.domain import CORR, PANEL, TRAIN_END, events, panel, r6, table
from sparkwright.plans.traces_sql import weight
from sparkwright.sources.trips import cell_distance, ring

HOUR = "interval 1 hour"


# weather

def weather(rows: DataFrame, keys: list[str], ts: str, means: list[str], sums: list[str], code: str, limit: int = 3) -> DataFrame:
    """One row for each key and hour: repeated hours merged, missing ones filled, imputed marking hours that lacked anything.

    Means are interpolated up to ``limit`` hours from a value, sums are 0, the code is carried on, at the start back.
    """
    own = rows.filter(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("hour")).agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], F.max(code).alias(code))
    span = own.agg(F.min("hour").alias("__a"), F.max("hour").alias("__b"))
    grid = own.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("__a", "__b", F.expr(HOUR))).alias("hour"))
    df = grid.join(own, [*keys, "hour"], "left")
    lacks = F.lit(False)
    for c in (*means, *sums, code):
        lacks = lacks | F.col(c).isNull()
    w = W.series(keys, "hour")
    df = df.withColumn("imputed", lacks).withColumn("__at", F.row_number().over(w))
    filled = {c: W.interpolated(F.col(c), w, F.col("__at"), limit) for c in means} | {c: F.coalesce(c, F.lit(0.0)) for c in sums}
    filled[code] = F.coalesce(F.last(code, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(code, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return df.withColumns(filled).drop("__at")


def weather_type(snow: Column, rain: Column) -> Column:
    return F.when(snow > 0, "snow").when(rain > 0, "rain_no_snow").otherwise("dry")


def weather_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large values of each type as a weather table with gaps: mean, sums of two kinds, a code."""
    e = events(spark, sf_dir).filter("value > 100").select(F.col("event_type").alias("key"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value", F.when(F.col("event_id") % 5 == 0, 0.5).otherwise(0.0).alias("rain"), F.when(F.col("event_id") % 31 == 0, 1.0).otherwise(0.0).alias("snow"), (F.col("event_id") % 100).alias("code"))
    w = weather(e, ["key"], "ts", ["value"], ["rain", "snow"], "code")
    return w.select("key", "hour", r6(F.col("value")).alias("value"), "rain", "snow", "code", "imputed", weather_type(F.col("snow"), F.col("rain")).alias("weather_type"))


# peaks: evidence, payloads, replies

def evidence(rules: dict[str, tuple[Column, str]]) -> Column:
    """A map of the rules that hold to their texts."""
    pairs = [x for name, (holds, text) in rules.items() for x in (F.lit(name), F.when(F.coalesce(holds, F.lit(False)), F.lit(text)))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def peak_rules() -> dict[str, tuple[Column, str]]:
    return {
        "S0_current_peak": (F.lit(True), "The hour is a peak."), "S1_rising": (F.col("z_change") >= 1, "z rose by 1 or more."), "S2_recent_rise": (F.col("velocity") >= 0.5, "The last hours rose."),
        "S3_lasting": (F.col("peak_age") >= 2, "The peak lasts two hours or more."), "S4_neighbours": (F.col("near_z") >= 2, "Neighbours are high too."), "S6_weekly": (F.col("lag_168") >= F.col("n") * 0.9, "Last week's hour was as high."),
    }


def history(value: Column, w, hours: int = 24) -> Column:
    """The values of the last ``hours`` hours on a gap-free grid, oldest first, 0 before its start."""
    have = F.collect_list(value).over(w.rowsBetween(1 - hours, 0))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(hours) - F.size(have)), have)


def peak_cases(p: DataFrame, base: DataFrame, peak: float = 2) -> DataFrame:
    """The peak hours with what is known of them: evidence, 24 hours of history."""
    keys = ["key", "dow_mon0", "clock"]
    w = W.series(["key"], "hour")
    s = M.scored(p, base, keys, peak=peak)
    at = s.groupBy("hour").agg(F.sum("z").alias("all_z"), F.count("z").alias("c"))
    s = s.join(at, "hour").withColumns({"near_z": S.ratio(F.col("all_z") - F.col("z"), F.col("c") - 1), "lag_168": F.lag("n", 168).over(w), "history": history(F.col("n"), w)})
    return s.filter("is_peak").withColumn("evidence", evidence(peak_rules()))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return peak_cases(p, M.baseline(p.filter(F.col("hour") < TRAIN_END), ["key", "dow_mon0", "clock"]))


def payload() -> Column:
    """A case as JSON: what a judge of its continuation is shown."""
    return F.to_json(F.struct(F.concat_ws("@", "key", F.date_format("hour", "yyyyMMddHH")).alias("case_id"), F.struct("dow_mon0", "clock").alias("calendar"), F.struct("n", "peak_age").alias("peak"), F.struct(F.col("history").alias("last_24")).alias("history"), F.array_sort(F.map_keys("evidence")).alias("eligible")))


def peak_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("key", "hour", F.concat_ws(",", F.array_sort(F.map_keys("evidence"))).alias("evidence"), payload().alias("payload"))


REPLY = "predictions array<struct<case_id:string,label:string,evidence:array<string>>>"


def replies(rows: DataFrame, content: str, labels: tuple[str, ...], allowed: DataFrame) -> DataFrame:
    """case_id, label, cited, problem of each prediction in the replies ``content``; ``allowed``: case_id, eligible.

    problem: malformed (no such JSON), unknown_case, invalid_label, evidence_not_allowed, or null. Code fences are dropped.
    """
    parsed = rows.select(F.from_json(without_fence(F.col(content)), REPLY)["predictions"].alias("p"))
    each = parsed.select(F.explode_outer("p").alias("p"), F.col("p").isNull().alias("bad")).select("p.case_id", "p.label", F.coalesce("p.evidence", F.array().cast("array<string>")).alias("cited"), "bad")
    j = each.join(allowed, "case_id", "left")
    problem = F.when(F.col("bad"), "malformed").when(F.col("eligible").isNull(), "unknown_case").when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "invalid_label").when(F.size(F.array_except("cited", "eligible")) > 0, "evidence_not_allowed")
    return j.select("case_id", "label", "cited", problem.alias("problem"))


def reply_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about the peak cases, some of them faulty: how many of each label have which problem."""
    c = cases(spark, sf_dir).select(F.concat_ws("@", "key", F.date_format("hour", "yyyyMMddHH")).alias("case_id"), F.array_sort(F.map_keys("evidence")).alias("eligible"), F.hour("hour").alias("h"))
    cited = F.when(F.col("h") % 5 == 0, F.concat("eligible", F.array(F.lit("S9_unknown")))).otherwise(F.col("eligible"))
    label = F.when(F.col("h") % 7 == 0, "perhaps").when(F.col("h") % 2 == 0, "continue").otherwise("end")
    body = F.to_json(F.struct(F.array(F.struct(F.when(F.col("h") % 11 == 0, "nobody").otherwise(F.col("case_id")).alias("case_id"), label.alias("label"), cited.alias("evidence"))).alias("predictions")))
    text = F.when(F.col("h") == 13, "no answer").when(F.col("h") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    out = replies(c.select(text.alias("content")), "content", ("continue", "end"), c.select("case_id", "eligible"))
    return out.groupBy("label", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.sum(F.size("cited")).alias("cited"))


# forecasts

def scenarios(df: DataFrame, column: str, factors: tuple[float, ...], score: Column) -> DataFrame:
    """factor, rows, the mean of ``score`` with ``column`` scaled by it, and its change against factor 1."""
    plain = df.withColumn("__plain", score)
    scaled = plain.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors]))).withColumn(column, F.col(column) * F.col("factor"))
    return scaled.groupBy("factor").agg(F.count(score).alias("rows"), F.avg(score).alias("mean"), F.avg(score - F.col("__plain")).alias("change"))


def lag_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.features(panel(spark, sf_dir)).filter("lag_168 is not null").withColumn("lag_1", F.col("lag_1").cast("double"))
    out = scenarios(f, "lag_1", (1.0, 0.9, 0.7, 0.5, 0.3), 0.5 * F.col("lag_1") + 0.3 * F.col("lag_24") + 0.2 * F.col("lag_168"))
    return out.select("factor", "rows", r6(F.col("mean")).alias("mean"), r6(F.col("change")).alias("change"))


def importances(df: DataFrame, features: list[str], score: Column, target: str, ident: str, seed: int = 42) -> DataFrame:
    """feature, increase: how much the mean absolute error grows when a feature's values are dealt anew among the rows.

    A feature's values change places by two orders of all rows, by ident and by a seeded hash.
    """
    base = df.agg(F.avg(F.abs(score - F.col(target))).alias("base"))
    out = None
    own = numbered(df, ident)
    for name in features:
        dealt = numbered(df.select(F.col(name).alias("__dealt"), ident), F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), F.col(ident).cast("string"))), ident).select("i", "__dealt")
        one = own.join(dealt, "i").withColumn(name, F.col("__dealt")).agg(F.lit(name).alias("feature"), F.avg(F.abs(score - F.col(target))).alias("error")).crossJoin(base)
        out = one if out is None else out.union(one)
    return out.select("feature", (F.col("error") - F.col("base")).alias("increase"))


def order_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's mean line."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealing discount or tax anew, for the product that gives a mean line's price after discount and tax."""
    lines = order_means(spark, sf_dir)
    score = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    out = importances(lines.withColumn("target", score), ["l_discount", "l_tax"], score, "target", "line")
    return out.select("feature", F.round("increase", 4).alias("increase"))


def supply_pressure(a: DataFrame, b: DataFrame, train: Column) -> DataFrame:
    """key, hour, net (b - a), its mean by key, weekday and hour in training, and z; deviations of at least 1."""
    keys = ["key", "dow_mon0", "clock"]
    net = a.select(*keys, "hour", F.col("n").alias("out_n")).join(b.select("key", "hour", F.col("n").alias("in_n")), ["key", "hour"]).withColumn("n", F.col("in_n") - F.col("out_n"))
    base = M.baseline(net.filter(train), keys)
    return net.join(base, keys, "left").select("key", "hour", F.col("n").alias("net"), "mean", ((F.col("n") - F.col("mean")) / F.greatest("std", F.lit(1.0))).alias("pressure"))


def pressure_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views against clicks by thirds of the users: the ten hours of the largest net inflow and the ten of the largest outflow."""
    e = events(spark, sf_dir).withColumn("third", (F.col("user_id") % 3).cast("string"))
    side = lambda kind: M.panel(e.filter(F.col("event_type") == kind), "third")
    s = supply_pressure(side("view"), side("click"), F.col("hour") < TRAIN_END).filter((F.col("hour") >= TRAIN_END) & F.col("pressure").isNotNull())
    top = lambda sign, name: s.orderBy(F.round("pressure", 9) * sign, "key", "hour").limit(10).select(F.lit(name).alias("side"), "key", "hour", "net", r6(F.col("pressure")).alias("pressure"))
    return top(-1, "inflow").union(top(1, "outflow"))


def ablation(errors: DataFrame, slices: dict[str, Column], repetitions: int = 300, seed: int = 42) -> DataFrame:
    """By slice: hours, both models' mean errors, mean difference b - a and its interval; ``errors``: hour, a, b, one row an hour.

    A slice's resamples take each hour a Poisson number of times, by hashes.
    """
    out = None
    for name, keep in slices.items():
        n = errors.filter(keep).withColumn("d", F.col("b") - F.col("a"))
        one = n.agg(F.count("*").alias("hours"), F.avg("a").alias("mae_a"), F.avg("b").alias("mae_b"), F.avg("d").alias("difference")).crossJoin(stats.bootstrap(n.select("hour", "d"), F.col("hour"), stats.mean_of(F.col("d")), repetitions, seed)).withColumn("slice", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def ablation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training days' mean against last week's count, by hour over all types; all days, workdays, weekends."""
    keys = ["key", "dow_mon0", "clock"]
    p = panel(spark, sf_dir)
    f = M.features(p, leads=(1,)).join(M.baseline(p.filter(F.col("hour") < TRAIN_END), keys), keys, "left").filter((F.col("hour") >= TRAIN_END) & F.col("lag_168").isNotNull() & F.col("mean").isNotNull())
    errors = f.groupBy("hour").agg(F.round(F.avg(F.abs(F.col("n") - F.col("mean"))), 9).alias("a"), F.round(F.avg(F.abs(F.col("n") - F.col("lag_168"))), 9).alias("b"))
    out = ablation(errors, {"all": F.lit(True), "workday": F.weekday("hour") < 5, "weekend": F.weekday("hour") >= 5})
    return out.select("slice", "hours", *[r6(F.col(c)).alias(c) for c in ("mae_a", "mae_b", "difference", "low", "high")])


def peak_detection(rows: DataFrame, keys: list[str], limit: float, least: float = 1.0) -> DataFrame:
    """By ``keys``: rows, valid ones, precision, recall, f1 and average precision of predicted peaks.

    ``rows``: y (is a peak), prediction, mean, std. The score is (prediction - mean) / std; rows without one are counted as
    excluded. A predicted peak has a score of ``limit`` and a prediction of ``least`` or more.
    """
    score = F.round(S.number_or_null(S.ratio(F.col("prediction") - F.col("mean"), F.when(F.col("std") > 0, F.col("std")))), 9)
    x = rows.withColumn("score", F.when(F.col("y").isNotNull(), score))
    valid = x.filter("score is not null")
    n = x.groupBy(*keys).agg(F.count("*").alias("total"), F.count("score").alias("valid"))
    m = valid.groupBy(*keys).agg(*stats.classification_metrics(F.col("y"), (F.col("score") >= limit) & (F.col("prediction") >= least)))
    return n.join(m, keys, "left").join(stats.ranking_metrics(valid, "y", "score", *keys), keys, "left").select(*keys, "total", "valid", (F.col("total") - F.col("valid")).alias("excluded"), "tp", "fp", "fn", "precision", "recall", "f1", "average_precision")


def peak_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Now's and last week's counts as predictions of the hour 1, 3 and 6 hours ahead, and the peaks that they tell."""
    keys = ["key", "dow_mon0", "clock"]
    p = panel(spark, sf_dir)
    base = M.baseline(p.filter(F.col("hour") < TRAIN_END), keys)
    s = p.join(base, keys, "left")
    w = W.series(["key"], "hour")
    parts = [F.struct(F.lit(h).alias("horizon"), F.lit(name).alias("model"), c.cast("double").alias("prediction"), F.lead("n", h).over(w).alias("actual"), F.lead("mean", h).over(w).alias("m"), F.lead("std", h).over(w).alias("s")) for h in (1, 3, 6) for name, c in (("now", F.col("n")), ("week", F.lag("n", 168 - h).over(w)))]
    rows = s.select(F.array(*parts).alias("parts")).select(F.explode("parts").alias("r")).select("r.horizon", "r.model", "r.prediction", "r.actual", F.col("r.m").alias("mean"), F.col("r.s").alias("std")).filter("actual is not null")
    rows = rows.withColumn("y", S.ratio(F.col("actual") - F.col("mean"), F.col("std")) >= 1)
    out = peak_detection(rows, ["model", "horizon"], 1.0)
    return out.select("model", "horizon", "total", "valid", "excluded", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "average_precision")])


# places

def zones(places: DataFrame, latitude: float, longitude: float, core: int, radius_km: float, most: int) -> DataFrame:
    """``places`` (place, latitude, longitude, activity) with distance_km and zone: the ``core`` nearest ones, expanded (the
    ``most`` busiest of the others within ``radius_km``), or outside. Ties go to the smaller place."""
    d = places.withColumn("distance_km", S.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude)))
    near = d.orderBy("distance_km", "place").limit(core).select("place", F.lit("core").alias("zone"))
    busy = d.join(near, "place", "left_anti").filter(F.col("distance_km") <= radius_km).orderBy(F.desc("activity"), "place").limit(most).select("place", F.lit("expanded").alias("zone"))
    return d.join(near.union(busy), "place", "left").withColumn("zone", F.coalesce("zone", F.lit("outside")))


def supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("activity"))
    return table(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left").select(k.alias("place"), (41.6 + k % 97 / 250).alias("latitude"), (-87.9 + k % 89 / 250).alias("longitude"), F.coalesce("activity", F.lit(0)).alias("activity"))


def zone_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(supplier_places(spark, sf_dir), 41.8623, -87.6167, 5, 12.0, 8).select("place", "activity", r6(F.col("distance_km")).alias("distance_km"), "zone")


def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 0.02 degrees: their activity, their ring's, and their distance in cells from one cell."""
    s = supplier_places(spark, sf_dir)
    cells = s.groupBy(F.floor(F.col("latitude") / 0.02).alias("row"), F.floor(F.col("longitude") / 0.02).alias("col")).agg(F.sum("activity").alias("activity"))
    cells = cells.select(F.concat_ws(":", "row", "col").alias("cell"), "activity")
    around = cells.select("cell", F.explode(ring(F.col("cell"))).alias("near")).join(cells.select(F.col("cell").alias("near"), F.col("activity").alias("a")), "near").groupBy("cell").agg(F.sum("a").alias("near_activity"), F.count("*").alias("near_cells"))
    return cells.join(around, "cell", "left").select("cell", "activity", F.coalesce("near_activity", F.lit(0)).alias("near_activity"), F.coalesce("near_cells", F.lit(0)).alias("near_cells"), cell_distance(F.col("cell"), F.lit("2090:-4385")).alias("steps"))


# events

def anchor_windows(p: DataFrame, anchors: DataFrame, before: int = 6, after: int = 8) -> DataFrame:
    """key, anchor, offset, excess: the log of each hour's count over the median of the key's same weekday and hour."""
    mid = p.groupBy("key", "dow_mon0", "clock").agg(F.median("n").alias("median"))
    x = p.join(mid, ["key", "dow_mon0", "clock"]).select("key", "hour", (F.log1p("n") - F.log1p("median")).alias("excess"))
    offsets = anchors.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("hour", F.col("anchor") + F.make_dt_interval(F.lit(0), F.col("offset")))
    return x.join(offsets, "hour").select("key", "anchor", "offset", "excess")


def event_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type: the largest multiplier of the event template and its hour, and the mean multiplier of each event (heat table)."""
    from sparkwright.plans.domain import anchors

    w = anchor_windows(panel(spark, sf_dir), anchors(spark))
    shape = w.groupBy("key", "offset").agg(F.round(F.avg("excess"), 9).alias("effect"))
    peak = shape.groupBy("key").agg(F.exp(F.max("effect")).alias("multiplier"), F.max_by("offset", F.struct("effect", -F.col("offset"))).alias("peak_hour"))
    heat = w.groupBy("key").agg(*[F.exp(F.avg(F.when(F.dayofmonth("anchor") == d, F.col("excess")))).alias(f"day_{d}") for d in (12, 24)])
    return peak.join(heat, "key").select("key", r6(F.col("multiplier")).alias("multiplier"), "peak_hour", r6(F.col("day_12")).alias("day_12"), r6(F.col("day_24")).alias("day_24"))


def typed_candidates(candidates: DataFrame, known: DataFrame, at: str, known_at: str, name: str, near: float, wide: float) -> DataFrame:
    """``candidates`` with the nearest of ``known``, the distance, and match: exact (within ``near``), related (within ``wide``), none."""
    n = R.nearest(candidates, known, at, known_at, name)
    return n.withColumn("match", F.when(F.col("distance") <= near, "exact").when(F.col("distance") <= wide, "related").otherwise("none"))


def candidate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors' hours against the purchases': nearest purchase hour, and the kind of match within 0 and 2 hours."""
    at = (S.micros(F.date_trunc("hour", "ts")) / F.lit(3600e6)).cast("double")
    e = events(spark, sf_dir)
    a = e.filter("event_type = 'error' and value > 40").select("event_id", at.alias("x"))
    b = e.filter("event_type = 'purchase' and value > 40").select(F.col("event_id").alias("purchase_id"), at.alias("y"))
    return typed_candidates(a, b, "x", "y", "purchase_id", 0.0, 2.0).select("event_id", F.col("nearest_purchase_id").alias("purchase_id"), "distance", "match")


# tables and explanations

def pattern_tables(rows: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """By key: n, the share of positive values, their mean with and without the others; keys with support only."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((v > 0).cast("double")).alias("rate"), F.avg(v).alias("mean"), F.avg(F.when(v > 0, v)).alias("positive_mean")).filter(F.col("n") >= least)


def discount_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts by ship mode and return flag, as tips by route; at least 30 lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws(" -> ", "l_returnflag", "l_linestatus").alias("route"), F.month("l_shipdate").alias("month"), F.col("l_discount").cast("double").alias("tip"))
    t = pattern_tables(lines, ["route", "month"], "tip", 30)
    return t.select("route", "month", "n", *[r6(F.col(c)).alias(c) for c in ("rate", "mean", "positive_mean")])


def explanations(rows: DataFrame, ident: str, contributions: dict[str, Column], n: int = 5) -> DataFrame:
    """ident, rank, feature, contribution: the ``n`` contributions of the largest size of each row, ties by name."""
    each = rows.select(ident, F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("contribution")) for k, v in contributions.items()])).alias("c")).select(ident, "c.*").filter("contribution is not null")
    w = Window.partitionBy(ident).orderBy(F.desc(F.abs("contribution")), "feature")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose guess by quantity differs from the truth by price: the two parts that weigh most in a linear score."""
    lines = order_means(spark, sf_dir).filter("(l_extendedprice > 50000) <> (l_quantity > 25)")
    return explanations(lines, "line", {"quantity": F.round((F.col("l_quantity") - 25) / 10, 6), "discount": F.round((F.col("l_discount") - 0.05) * 20, 6), "tax": F.round((F.col("l_tax") - 0.04) * 20, 6)}, 2).select("line", F.col("rank").cast("long").alias("rank"), "feature", r6(F.col("contribution")).alias("contribution"))


def bundles(traces: DataFrame, observations: DataFrame, answers: DataFrame, annotations: DataFrame) -> DataFrame:
    """trace_id, bundle: each trace with its observations, answers and annotations as one JSON text, parts in order of their ids."""
    part = lambda df, key, name, *cols: df.groupBy(F.col(key).alias("trace_id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    o, n, a = part(observations, "trace_id", "observations", "observation_id", "type", "status"), part(answers, "trace_id", "answers", "answer_id", "task_id"), part(annotations.filter("target_type = 'trace'"), "target_id", "annotations", "annotation_id")
    j = traces.select("trace_id", "status").join(o, "trace_id", "left").join(n, "trace_id", "left").join(a, "trace_id", "left")
    return j.select("trace_id", F.to_json(F.struct("trace_id", "status", *[F.coalesce(c, F.array()).alias(c) for c in ("observations", "answers", "annotations")])).alias("bundle"))


def trace_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.plans.bundle import stand_in

    b = stand_in(spark, sf_dir)
    return bundles(b.traces, b.observations, b.answers, b.annotations).select("trace_id", F.md5("bundle").alias("bundle_md5"))


QUERIES = {f"m_{f.__name__}": f for f in (weather_hours, peak_payloads, reply_audit, lag_sensitivity, feature_importances, pressure_extremes, ablation_slices, peak_metrics, zone_selection, grid_neighbours, event_diagnostics, candidate_types, discount_patterns, disagreements, trace_bundles)}

TRAINED = PANEL + f""", base AS (SELECT key, dow, clock, avg(n) AS mean, CASE WHEN coalesce(stddev_samp(n), 0) = 0 THEN 1 ELSE stddev_samp(n) END AS sd FROM panel WHERE hour < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2, 3)"""
CASES = TRAINED + """, a AS (SELECT p.*, mean, (n - mean) / greatest(sd, 1) AS z FROM panel p LEFT JOIN base USING (key, dow, clock)),
b AS (SELECT *, z - lag(z) OVER w AS dz, n - lag(n) OVER w AS step, z >= 2 AND n >= 1 AS is_peak, lag(n, 168) OVER w AS week, list(n) OVER (PARTITION BY key ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS last, sum(z) OVER (PARTITION BY hour) AS az, count(z) OVER (PARTITION BY hour) AS cz FROM a WINDOW w AS (PARTITION BY key ORDER BY hour)),
c AS (SELECT *, avg(step) OVER (PARTITION BY key ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS velocity, CASE WHEN lag(is_peak) OVER w IS NOT DISTINCT FROM is_peak THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY key ORDER BY hour)),
d AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY hour) AS run FROM c),
cases AS (SELECT key, hour, n, dow, clock, row_number() OVER (PARTITION BY key, run ORDER BY hour) AS age, list_concat([0 for i in range(0, 24 - len(last))], last) AS h24, dz, velocity, week, (az - z) / nullif(cz - 1, 0) AS nz FROM d WHERE is_peak),
ev AS (SELECT *, key || '@' || strftime(hour, '%Y%m%d%H') AS case_id, list_filter(['S0_current_peak', CASE WHEN dz >= 1 THEN 'S1_rising' END, CASE WHEN velocity >= 0.5 THEN 'S2_recent_rise' END, CASE WHEN age >= 2 THEN 'S3_lasting' END, CASE WHEN nz >= 2 THEN 'S4_neighbours' END, CASE WHEN week >= n * 0.9::DOUBLE THEN 'S6_weekly' END], lambda x: x IS NOT NULL) AS eligible FROM cases)"""
PLACES = """places AS (SELECT s_suppkey AS place, 41.6::DOUBLE + s_suppkey % 97 / 250.0::DOUBLE AS lat, -87.9::DOUBLE + s_suppkey % 89 / 250.0::DOUBLE AS lon, coalesce(c, 0) AS activity FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
WINDOWS = PANEL + """, anchors AS (SELECT unnest([TIMESTAMP '2024-01-12 19:00:00', TIMESTAMP '2024-01-24 13:00:00']) AS anchor), mid AS (SELECT key, dow, clock, median(n) AS med FROM panel GROUP BY 1, 2, 3), ex AS (SELECT key, hour, ln(1 + n) - ln(1 + med) AS excess FROM panel JOIN mid USING (key, dow, clock)),
wi AS (SELECT key, anchor, CAST(o AS INT) AS o, excess FROM anchors, range(-6, 9) r(o), ex WHERE ex.hour = anchor + to_hours(o))"""
LINES = "lines AS (SELECT l_orderkey AS line, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 6) AS e, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY 1)"

SQL: dict[str, str] = {
    "weather_hours": """WITH own AS (SELECT event_type AS key, date_trunc('hour', ts) AS hour, avg(value) AS v, sum(CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END) AS rain, sum(CASE WHEN event_id % 31 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS snow, max(event_id % 100) AS code FROM events WHERE value > 100 GROUP BY 1, 2),
      g AS (SELECT key, unnest(generate_series((SELECT min(hour) FROM own), (SELECT max(hour) FROM own), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT key FROM own)), j AS (SELECT g.key, g.hour, v, rain, snow, code, row_number() OVER (PARTITION BY g.key ORDER BY g.hour) AS p FROM g LEFT JOIN own ON own.key = g.key AND own.hour = g.hour),
      k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS x0, first_value(v IGNORE NULLS) OVER a AS x1, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1, last_value(code IGNORE NULLS) OVER b AS c0, first_value(code IGNORE NULLS) OVER a AS c1 FROM j
        WINDOW b AS (PARTITION BY key ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY key ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT key, hour, round(CASE WHEN v IS NOT NULL THEN v WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND least(p - p0, p1 - p) <= 3 THEN x0 + (x1 - x0) * (p - p0) / (p1 - p0) WHEN x1 IS NULL AND p - p0 <= 3 THEN x0 WHEN x0 IS NULL AND p1 - p <= 3 THEN x1 END, 6) AS value,
        coalesce(rain, 0) AS rain, coalesce(snow, 0) AS snow, coalesce(code, c0, c1) AS code, v IS NULL AS imputed, CASE WHEN snow > 0 THEN 'snow' WHEN rain > 0 THEN 'rain_no_snow' ELSE 'dry' END AS weather_type FROM k""",
    "peak_payloads": "WITH " + CASES + """ SELECT key, hour, array_to_string(eligible, ',') AS evidence, '{"case_id":"' || case_id || '","calendar":{"dow_mon0":' || dow || ',"clock":' || clock || '},"peak":{"n":' || n || ',"peak_age":' || age || '},"history":{"last_24":[' || array_to_string(h24, ',') || ']},"eligible":["' || array_to_string(eligible, '","') || '"]}' AS payload FROM ev""",
    "reply_audit": "WITH " + CASES + """, r AS (SELECT CASE WHEN clock = 13 THEN 'malformed' WHEN clock % 11 = 0 THEN 'unknown_case' WHEN clock % 7 = 0 THEN 'invalid_label' WHEN clock % 5 = 0 THEN 'evidence_not_allowed' ELSE 'none' END AS problem, CASE WHEN clock = 13 THEN NULL WHEN clock % 7 = 0 THEN 'perhaps' WHEN clock % 2 = 0 THEN 'continue' ELSE 'end' END AS label, CASE WHEN clock = 13 THEN 0 ELSE len(eligible) + CASE WHEN clock % 5 = 0 THEN 1 ELSE 0 END END AS c FROM ev)
      SELECT label, problem, count(*) AS n, CAST(sum(c) AS BIGINT) AS cited FROM r GROUP BY 1, 2""",
    "lag_sensitivity": "WITH " + PANEL + """, f AS (SELECT lag(n, 1) OVER w AS a, lag(n, 24) OVER w AS b, lag(n, 168) OVER w AS c FROM panel WINDOW w AS (PARTITION BY key ORDER BY hour))
      SELECT CAST(f AS DOUBLE) AS factor, count(*) AS rows, round(avg(0.5::DOUBLE * a * f + 0.3::DOUBLE * b + 0.2::DOUBLE * c), 6) AS mean, round(avg(0.5::DOUBLE * a * (f - 1)), 6) AS change FROM f, (SELECT unnest([1.0::DOUBLE, 0.9, 0.7, 0.5, 0.3]) AS f) WHERE c IS NOT NULL GROUP BY 1""",
    "feature_importances": "WITH " + LINES + """, o AS (SELECT *, row_number() OVER (ORDER BY line) AS i, row_number() OVER (ORDER BY md5('42:l_discount:' || line), line) AS di, row_number() OVER (ORDER BY md5('42:l_tax:' || line), line) AS ti FROM lines)
      SELECT 'l_discount' AS feature, round(avg(abs(a.e * (1 - b.d) * (1 + a.t) - a.e * (1 - a.d) * (1 + a.t))), 4) AS increase FROM o a JOIN o b ON a.i = b.di UNION ALL SELECT 'l_tax', round(avg(abs(a.e * (1 - a.d) * (1 + b.t) - a.e * (1 - a.d) * (1 + a.t))), 4) FROM o a JOIN o b ON a.i = b.ti""",
    "pressure_extremes": f"""WITH hc AS (SELECT event_type AS kind, CAST(user_id % 3 AS VARCHAR) AS key, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3),
      gr AS (SELECT kind, key, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT kind, key FROM hc) JOIN (SELECT kind, min(hour) AS lo, max(hour) AS hi FROM hc GROUP BY 1) USING (kind)), p AS (SELECT kind, key, hour, coalesce(n, 0) AS n FROM gr LEFT JOIN hc USING (kind, key, hour)),
      nt AS (SELECT a.key, a.hour, isodow(a.hour) AS dow, hour(a.hour) AS clock, b.n - a.n AS net FROM p a JOIN p b ON a.key = b.key AND a.hour = b.hour AND a.kind = 'view' AND b.kind = 'click'),
      bs AS (SELECT key, dow, clock, avg(net) AS m, CASE WHEN coalesce(stddev_samp(net), 0) = 0 THEN 1 ELSE stddev_samp(net) END AS sd FROM nt WHERE hour < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2, 3), pr AS (SELECT key, hour, net, (net - m) / greatest(sd, 1) AS z FROM nt JOIN bs USING (key, dow, clock) WHERE hour >= TIMESTAMP '{TRAIN_END}'),
      rk AS (SELECT *, row_number() OVER (ORDER BY -round(z, 9), key, hour) AS i, row_number() OVER (ORDER BY round(z, 9), key, hour) AS o FROM pr) SELECT 'inflow' AS side, key, hour, net, round(z, 6) AS pressure FROM rk WHERE i <= 10 UNION ALL SELECT 'outflow', key, hour, net, round(z, 6) FROM rk WHERE o <= 10""",
    "ablation_slices": "WITH " + TRAINED + f""", l AS (SELECT *, lag(n, 168) OVER (PARTITION BY key ORDER BY hour) AS week FROM panel), e AS (SELECT hour, round(avg(abs(n - mean)), 9) AS a, round(avg(abs(n - week)), 9) AS b FROM l JOIN base USING (key, dow, clock) WHERE hour >= TIMESTAMP '{TRAIN_END}' AND week IS NOT NULL GROUP BY 1),
      s AS (SELECT *, b - a AS d FROM (SELECT 'all' AS slice, hour, a, b FROM e UNION ALL SELECT CASE WHEN isodow(hour) < 6 THEN 'workday' ELSE 'weekend' END, hour, a, b FROM e)),
      dr AS (SELECT slice, rep, sum(d * w) / sum(w) AS m FROM (SELECT slice, rep, d, {weight("CAST(hour AS VARCHAR)")} AS w FROM s, range(300) r(rep)) GROUP BY 1, 2)
      SELECT slice, hours, mae_a, mae_b, difference, low, high FROM (SELECT slice, count(*) AS hours, round(avg(a), 6) AS mae_a, round(avg(b), 6) AS mae_b, round(avg(d), 6) AS difference FROM s GROUP BY 1) JOIN (SELECT slice, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM dr GROUP BY 1) USING (slice)""",
    "peak_metrics": "WITH " + TRAINED + """, s AS (SELECT p.key, p.hour, n, mean, sd FROM panel p LEFT JOIN base USING (key, dow, clock)), r AS (SELECT CAST(h AS INT) AS horizon, model, CAST(CASE WHEN model = 'now' THEN n ELSE lag(n, 168 - h) OVER w END AS DOUBLE) AS pred, lead(n, h) OVER w AS actual, lead(mean, h) OVER w AS m, lead(sd, h) OVER w AS sd FROM s, (SELECT unnest([1, 3, 6]) AS h), (SELECT unnest(['now', 'week']) AS model) WINDOW w AS (PARTITION BY key, h, model ORDER BY hour)),
      x AS (SELECT *, (actual - m) / sd >= 1 AS y, CASE WHEN (actual - m) / sd IS NOT NULL THEN round((pred - m) / sd, 9) END AS score FROM r WHERE actual IS NOT NULL), v AS (SELECT *, score >= 1 AND pred >= 1 AS p FROM x WHERE score IS NOT NULL),
      c AS (SELECT model, horizon, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn FROM v GROUP BY 1, 2), g AS (SELECT model, horizon, score, count(*) FILTER (y) AS p, count(*) AS c FROM v GROUP BY 1, 2, 3),
      q AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS al, sum(p) OVER (PARTITION BY model, horizon) AS yes FROM g WINDOW w AS (PARTITION BY model, horizon ORDER BY score DESC)), ap AS (SELECT model, horizon, sum(p / yes * tp / al) AS ap FROM q GROUP BY 1, 2)
      SELECT t.model, t.horizon, total, valid, total - valid AS excluded, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(ap, 6) AS average_precision
      FROM (SELECT model, horizon, count(*) AS total, count(score) AS valid FROM x GROUP BY 1, 2) t LEFT JOIN c USING (model, horizon) LEFT JOIN ap USING (model, horizon)""",
    "zone_selection": "WITH " + PLACES + """, d AS (SELECT *, 2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin((radians(41.8623::DOUBLE) - radians(lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians(41.8623::DOUBLE)) * sin(radians(-87.6167::DOUBLE - lon) / 2) ** 2))) AS km FROM places), a AS (SELECT *, row_number() OVER (ORDER BY km, place) AS near FROM d),
      b AS (SELECT place, row_number() OVER (ORDER BY activity DESC, place) AS busy FROM a WHERE near > 5 AND km <= 12) SELECT a.place, activity, round(km, 6) AS distance_km, CASE WHEN near <= 5 THEN 'core' WHEN busy <= 8 THEN 'expanded' ELSE 'outside' END AS zone FROM a LEFT JOIN b USING (place)""",
    "grid_neighbours": "WITH " + PLACES + """, c AS (SELECT CAST(floor(lat / 0.02::DOUBLE) AS BIGINT) AS r, CAST(floor(lon / 0.02::DOUBLE) AS BIGINT) AS c, CAST(sum(activity) AS BIGINT) AS activity FROM places GROUP BY 1, 2)
      SELECT a.r || ':' || a.c AS cell, a.activity, CAST(coalesce(sum(b.activity), 0) AS BIGINT) AS near_activity, count(b.r) AS near_cells, greatest(abs(a.r - 2090), abs(a.c + 4385)) AS steps FROM c a LEFT JOIN c b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c, a.activity""",
    "event_diagnostics": "WITH " + WINDOWS + """, sh AS (SELECT key, o, round(avg(excess), 9) AS f FROM wi GROUP BY 1, 2) SELECT key, round(exp(max(f)), 6) AS multiplier, arg_max(o, (f, -o)) AS peak_hour, any_value(a) AS day_12, any_value(b) AS day_24 FROM sh JOIN (SELECT key, round(exp(avg(excess) FILTER (day(anchor) = 12)), 6) AS a, round(exp(avg(excess) FILTER (day(anchor) = 24)), 6) AS b FROM wi GROUP BY 1) USING (key) GROUP BY 1""",
    "candidate_types": """WITH e AS (SELECT event_id, event_type, epoch_us(date_trunc('hour', ts)) / 3600e6 AS x FROM events WHERE value > 40), j AS (SELECT a.event_id, b.event_id AS purchase_id, abs(a.x - b.x) AS distance FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.x - b.x), b.event_id) = 1)
      SELECT *, CASE WHEN distance <= 0 THEN 'exact' WHEN distance <= 2 THEN 'related' ELSE 'none' END AS match FROM j""",
    "discount_patterns": "SELECT l_returnflag || ' -> ' || l_linestatus AS route, CAST(month(l_shipdate) AS INT) AS month, count(*) AS n, round(avg(CAST(l_discount > 0 AS DOUBLE)), 6) AS rate, round(avg(CAST(l_discount AS DOUBLE)), 6) AS mean, round(avg(CAST(l_discount AS DOUBLE)) FILTER (l_discount > 0), 6) AS positive_mean FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 30",
    "disagreements": "WITH " + LINES + """, c AS (SELECT line, unnest([{'f': 'quantity', 'c': round((q - 25) / 10, 6)}, {'f': 'discount', 'c': round((d - 0.05::DOUBLE) * 20, 6)}, {'f': 'tax', 'c': round((t - 0.04::DOUBLE) * 20, 6)}]) AS s FROM lines WHERE (e > 50000) <> (q > 25))
      SELECT line, row_number() OVER (PARTITION BY line ORDER BY abs(s.c) DESC, s.f) AS rank, s.f AS feature, round(s.c, 6) AS contribution FROM c QUALIFY rank <= 2""",
}
SQL = {f"m_{k}": v for k, v in SQL.items()}


def bundle_sql() -> str:
    from sparkwright.plans.traces_sql import over_bundle

    part = lambda table, key, name, text: f"(SELECT {key} AS trace_id, string_agg({text}, ',' ORDER BY {name}) AS {table}_j FROM {table} GROUP BY 1)"
    o = part("observations", "trace_id", "observation_id", """'{"observation_id":"' || observation_id || '","type":"' || type || '","status":"' || status || '"}'""")
    n = part("answers", "trace_id", "answer_id", """'{"answer_id":"' || answer_id || '","task_id":"' || task_id || '"}'""")
    a = part("annotations", "target_id", "annotation_id", """'{"annotation_id":"' || annotation_id || '"}'""")
    return over_bundle(f"""SELECT t.trace_id, md5('{{"trace_id":"' || t.trace_id || '","status":"' || t.status || '","observations":[' || coalesce(observations_j, '') || '],"answers":[' || coalesce(answers_j, '') || '],"annotations":[' || coalesce(annotations_j, '') || ']}}') AS bundle_md5
      FROM traces t LEFT JOIN {o} o USING (trace_id) LEFT JOIN {n} n USING (trace_id) LEFT JOIN {a} a USING (trace_id)""")


SQL["m_trace_bundles"] = bundle_sql()
