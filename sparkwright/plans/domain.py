"""The mobility operators on the test tables: events by type and hour stand in for trips by cell and hour, order lines
with their customers' and suppliers' nations for trips between cells. Each query has its SQL of DuckDB below it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions import stats
from sparkwright.functions import windows as W
from sparkwright.functions.text import redacted
from sparkwright.operators import relational as R
from sparkwright.plans import mobility as M

Query = Callable[[SparkSession, str], DataFrame]
#: Fixed times of the stand-in: training ends, and two anchors for event studies.
TRAIN_END, ANCHORS = "2024-01-22", ("2024-01-12 19:00:00", "2024-01-24 13:00:00")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.panel(events(spark, sf_dir), "event_type")


def panel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly grid by type, baseline by weekday and hour of the training days, z, runs of peaks and their age, trend."""
    p = panel(spark, sf_dir)
    s = M.scored(p, M.baseline(p.filter(F.col("hour") < TRAIN_END), ["key", "dow_mon0", "clock"]), ["key", "dow_mon0", "clock"], peak=2)
    return s.select("key", "hour", "n", r6(F.col("z")).alias("z"), r6(F.col("ratio")).alias("ratio"), r6(F.col("velocity")).alias("velocity"), "acceleration", "is_peak", "is_low", F.col("peak_age").cast("long").alias("peak_age"), "trend")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hourly(events(spark, sf_dir), "event_type")


def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, trailing means and deviations, targets and cycles."""
    f = M.features(panel(spark, sf_dir))
    return f.select("key", "hour", "n", "lag_1", "lag_24", "lag_168", "lead_6", "naive_1", *[r6(F.col(c)).alias(c) for c in ("mean_3", "mean_24", "std_24", "mean_168", "clock_sin", "day_cos")])


def horizon_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.horizon_errors(M.features(panel(spark, sf_dir)))
    return e.select("horizon", "rows", *[r6(F.col(c)).alias(c) for c in ("mae_now", "mae_week", "rmse_now")])


def lag_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return M.lag_correlations(p.filter("key = 'view'"), p.filter("key = 'click'")).select("lag", "hours", r6(F.col("r")).alias("r"))


def anchors(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(a).cast("timestamp_ntz") for a in ANCHORS])).alias("anchor"))


def event_hours(spark: SparkSession) -> DataFrame:
    return anchors(spark).select(F.explode(F.sequence(F.col("anchor") - F.expr("interval 8 hours"), F.col("anchor") + F.expr("interval 10 hours"), F.expr("interval 1 hour"))).alias("hour"))


def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor hours against the same weekday and hour of other days within two weeks, or of all with fewer than two."""
    p = panel(spark, sf_dir)
    t = p.select("key").distinct().crossJoin(anchors(spark).withColumnRenamed("anchor", "hour"))
    c = M.matched_controls(p, t, event_hours(spark), days=14, least=2)
    return c.select("key", "target", "actual", "controls", *[r6(F.col(x)).alias(x) for x in ("mean", "median", "scale", "p05", "p95", "percentile", "robust_z", "lift")])


def event_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median log excess by hour around the anchors, over a profile by weekday and hour."""
    p = panel(spark, sf_dir)
    x = M.log_excess(p, M.normal_profile(p, least=3, floor=1.0))
    t = M.template(M.around(x.filter("key = 'purchase'"), anchors(spark)))
    return t.select("offset", r6(F.col("effect")).alias("effect"), r6(F.col("median_effect")).alias("median_effect"), "windows")


def residual_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    r = M.residual_walk(M.log_excess(p, M.normal_profile(p, least=3, floor=1.0)))
    return r.select("key", *[r6(F.col(c)).alias(c) for c in ("std", "low", "high", "phi")])


def route_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by customer's and supplier's nation: means, second moments, lognormal parameters; routes with support."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("from"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("to"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    e = M.economics(lines, ["from", "to"], ["l_quantity", "l_extendedprice"]).filter("trips >= 30")
    mu, sigma = M.lognormal(F.col("mean_l_extendedprice"), F.col("square_l_extendedprice"))
    return e.select(F.concat_ws(" -> ", "from", "to").alias("route"), "trips", r6(F.col("mean_l_quantity")).alias("mean_quantity"), F.round(F.col("mean_l_extendedprice") * F.col("trips"), 2).alias("total_price"), r6(mu).alias("mu"), r6(sigma).alias("sigma"))


def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each user, cut where more than six hours pass between events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = S.micros(F.col("ts"))
    e = events(spark, sf_dir).select("user_id", "ts", "event_id", "value", us.alias("us")).withColumn("gap", F.col("us") - F.lag("us").over(w))
    v = e.withColumn("visit", F.sum(F.when(F.coalesce("gap", F.lit(0)) > 6 * 3600 * 1_000_000, 1).otherwise(0)).over(w))
    return v.groupBy("user_id", "visit").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("seconds"), F.round(F.sum("value"), 4).alias("value"))


def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the purchases of the same user within twelve hours of them."""
    e = events(spark, sf_dir).withColumn("us", S.micros(F.col("ts")))
    a = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("us").alias("x"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("us").alias("y"))
    return R.band_join(a, b, ["user_id"], "x", "y", 12 * 3600e6).select("user_id", "error_id", "purchase_id", (F.abs(F.col("x") - F.col("y")) / F.lit(1e6)).alias("seconds"))


def value_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tip-style deciles of order totals: bounds, size and mean."""
    d = R.deciles(table(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice")
    return d.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def separated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest hours, no two within 36 hours, at most ten."""
    h = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    at = h.select((S.micros(F.col("hour")) / F.lit(3600e6)).cast("double").alias("hour_at"), F.col("n").cast("double").alias("score"))
    return R.separated(at, "hour_at", "score", 36.0, 10)


def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's measures: order lines of more than 25 pieces as the guess for those dearer than 50,000."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") > 50_000).alias("y"), (F.col("l_quantity") > 25).alias("p"), "l_returnflag")
    m = x.groupBy("l_returnflag").agg(*stats.classification_metrics(F.col("y"), F.col("p")))
    return m.select("l_returnflag", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1", "balanced_accuracy")])


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") > 50_000).cast("int").alias("y"), (F.col("l_quantity") / 50).alias("score"))
    m = stats.ranking_metrics(x, "y", "score")
    return m.select(*[r6(F.col(c)).alias(c) for c in ("roc_auc", "average_precision", "brier")])


def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last week's count as the forecast of each hour, by type and overall (one pass with grouping sets)."""
    f = M.features(panel(spark, sf_dir), leads=(1,)).filter("lag_168 is not null").select("key", F.col("n").cast("double").alias("y"), F.col("lag_168").cast("double").alias("p"))
    g = f.rollup("key").agg(*stats.regression_metrics("y", "p"))
    return g.select(F.coalesce("key", F.lit("all")).alias("key"), "n", *[r6(F.col(c)).alias(c) for c in ("mae", "rmse", "r2", "wape", "bias")])


def weekly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by weekday, one column for each type."""
    types = ["click", "error", "purchase", "signup", "view"]
    return events(spark, sf_dir).groupBy(F.weekday("ts").alias("dow")).pivot("event_type", types).count().na.fill(0).unpivot(["dow"], types, "event_type", "n")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with assigned secrets masked: the digest and length of the whole masked text, and its masks."""
    masked = table(spark, sf_dir, "documents").select("doc_id", "text", redacted(F.col("text")).alias("out")).filter("text != out")
    masks = (F.char_length("out") - F.char_length(F.replace("out", F.lit("[REDACTED]"), F.lit("")))) / F.lit(len("[REDACTED]"))
    return masked.select("doc_id", F.md5("out").alias("masked_md5"), F.char_length("out").cast("long").alias("n"), masks.cast("long").alias("masks"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders of each priority, by the smallest MD5 of their key."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("o_orderpriority", "o_orderkey", F.col("r").cast("long").alias("r"))


def nation_order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each customer's order to the next one, by nation: mean, median, nearest-rank and interpolated P95."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("gap", F.datediff(F.lead("o_orderdate").over(w), F.col("o_orderdate"))).filter("gap is not null")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("n"), r6(F.avg("gap")).alias("mean"), F.median("gap").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY gap)").cast("long").alias("p95_rank"), r6(F.percentile("gap", F.lit(0.95))).alias("p95"))


def first_seen_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of part types by sorted order in the cheaper half, -1 for the others."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    return R.codes(p, "p_type", F.col("p_retailprice") < 1000).select("p_partkey", F.col("code").cast("long").alias("code"))


def frontier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that no other beats in number of lines, revenue and mean discount at once."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    b = l.groupBy("p_brand").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), r6(F.avg("l_discount")).alias("discount"))
    return R.undominated(b, "p_brand", ["lines", "revenue"], ["discount"])


def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their parent, by link."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part", "labels", "documents")}
    links = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("documents", "doc_id", "labels", "doc_id"))
    out = None
    for a, k, b, j in links:
        one = R.orphans(t[a], k, t[b], j).agg(F.lit(f"{a}.{k}").alias("link"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def trailing_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's trailing mean of the user's last five values, and the average rank of the value among the user's."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir)
    return e.select("event_id", r6(W.trailing(F.avg, F.col("value"), w, 5, 3)).alias("mean_5"), W.average_rank(F.col("value"), "user_id").alias("rank"))


QUERIES: dict[str, Query] = {f"m_{f.__name__}": f for f in (hourly_counts, panel_scores, panel_features, horizon_errors, lag_correlations, matched_controls, event_template, residual_walk, route_economics, session_runs, band_pairs, value_deciles, separated_peaks, error_metrics, ranking_quality, forecast_metrics, weekly_pivot, redacted_documents, stratified_sample, nation_order_gaps, first_seen_codes, frontier_parts, link_audit, trailing_users)}

PANEL = """hc AS (SELECT event_type AS key, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
grid AS (SELECT key, unnest(generate_series((SELECT min(hour) FROM hc), (SELECT max(hour) FROM hc), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT key FROM hc)),
panel AS (SELECT key, hour, coalesce(n, 0) AS n, isodow(hour) - 1 AS dow, hour(hour) AS clock FROM grid LEFT JOIN hc USING (key, hour))"""
CORR = "CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN (avg({x} * {y}) - avg({x}) * avg({y})) / (stddev_pop({x}) * stddev_pop({y})) END"
ANCHOR_SQL = "anchors AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{a}'" for a in ANCHORS) + "]) AS anchor)"
# all hours are of January, so the profile's key is weekday and hour
EXCESS = PANEL + """, md AS (SELECT key AS k0, dow, clock, n FROM panel), mid AS (SELECT dow, clock, median(n) AS med FROM md GROUP BY 1, 2),
ex AS (SELECT key, hour, ln(1 + n) - ln(1 + med) AS excess FROM panel JOIN mid USING (dow, clock))"""

SQL: dict[str, str] = {
    "hourly_counts": "SELECT event_type AS key, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2",
    "panel_scores": "WITH " + PANEL + f""", base AS (SELECT key, dow, clock, avg(n) AS mean, stddev_samp(n) AS sd FROM panel WHERE hour < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2, 3),
      a AS (SELECT p.*, mean, (n - mean) / greatest(CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 1) AS z FROM panel p LEFT JOIN base USING (key, dow, clock)),
      b AS (SELECT *, z - lag(z) OVER w AS dz, n - lag(n) OVER w AS step, z >= 2 AND n >= 1 AS is_peak, z <= -2 AND mean >= 1 AS is_low FROM a WINDOW w AS (PARTITION BY key ORDER BY hour)),
      c AS (SELECT *, avg(step) OVER (PARTITION BY key ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS velocity, step - lag(step) OVER w AS acceleration, CASE WHEN lag(is_peak) OVER w IS NOT DISTINCT FROM is_peak THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY key ORDER BY hour)),
      d AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY hour) AS run FROM c)
      SELECT key, hour, n, round(z, 6) AS z, round(CASE WHEN mean <> 0 THEN n / mean END, 6) AS ratio, round(velocity, 6) AS velocity, acceleration, is_peak, is_low, CASE WHEN is_peak THEN row_number() OVER (PARTITION BY key, run ORDER BY hour) ELSE 0 END AS peak_age,
        CASE WHEN is_peak AND dz >= 1 THEN 'rapid_high_rise' WHEN is_peak THEN 'high' WHEN is_low AND dz <= -1 THEN 'rapid_low_drop' WHEN is_low THEN 'low' WHEN dz >= 1 THEN 'rising' WHEN dz <= -1 THEN 'falling' ELSE 'normal' END AS trend FROM d""",
    "panel_features": "WITH " + PANEL + """ SELECT key, hour, n, lag(n, 1) OVER w AS lag_1, lag(n, 24) OVER w AS lag_24, lag(n, 168) OVER w AS lag_168, lead(n, 6) OVER w AS lead_6, lag(n, 167) OVER w AS naive_1,
      round(CASE WHEN count(n) OVER w3 >= 2 THEN avg(n) OVER w3 END, 6) AS mean_3, round(CASE WHEN count(n) OVER w24 >= 8 THEN avg(n) OVER w24 END, 6) AS mean_24, round(CASE WHEN count(n) OVER w24 >= 8 THEN stddev_samp(n) OVER w24 END, 6) AS std_24, round(CASE WHEN count(n) OVER w168 >= 56 THEN avg(n) OVER w168 END, 6) AS mean_168,
      round(sin(2 * pi() * clock / 24), 6) AS clock_sin, round(cos(2 * pi() * dow / 7), 6) AS day_cos FROM panel
      WINDOW w AS (PARTITION BY key ORDER BY hour), w3 AS (PARTITION BY key ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w24 AS (PARTITION BY key ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), w168 AS (PARTITION BY key ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""",
    "horizon_errors": "WITH " + PANEL + """, l AS (SELECT n, h, lead(n, h) OVER w AS y, lag(n, 168 - h) OVER w AS week FROM panel, (SELECT unnest([1, 2, 3, 6]) AS h) WINDOW w AS (PARTITION BY key, h ORDER BY hour))
      SELECT h AS horizon, count(*) AS rows, round(avg(abs(n - y)), 6) AS mae_now, round(avg(abs(week - y)), 6) AS mae_week, round(sqrt(avg((n - y) ** 2)), 6) AS rmse_now FROM l WHERE y IS NOT NULL AND week IS NOT NULL GROUP BY 1""",
    "lag_correlations": "WITH " + PANEL + f""" SELECT CAST(lag AS INT) AS lag, count(*) AS hours, round({CORR.format(x='a.n', y='b.n')}, 6) AS r FROM (SELECT * FROM panel WHERE key = 'view') a, range(0, 7) l(lag), (SELECT * FROM panel WHERE key = 'click') b WHERE b.hour = a.hour + to_hours(lag) GROUP BY 1""",
    "matched_controls": "WITH " + PANEL + ", " + ANCHOR_SQL + """, bad AS (SELECT unnest(generate_series(anchor - INTERVAL 8 HOUR, anchor + INTERVAL 10 HOUR, INTERVAL 1 HOUR)) AS hour FROM anchors),
      pr AS (SELECT t.key, t.hour AS target, t.n AS actual, c.n, abs(date_diff('day', c.hour, t.hour)) <= 14 AS near FROM panel t JOIN anchors ON t.hour = anchor JOIN panel c ON c.key = t.key AND c.dow = t.dow AND c.clock = t.clock WHERE c.hour NOT IN (FROM bad)),
      us AS (SELECT * FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY key, target) AS c FROM pr) WHERE c < 2 OR near), md AS (SELECT key, target, median(n) AS med FROM us GROUP BY 1, 2)
      SELECT us.key, us.target, actual, count(*) AS controls, round(avg(n), 6) AS mean, round(any_value(med), 6) AS median, round(1.4826 * median(abs(n - med)), 6) AS scale, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.95), 6) AS p95, round(100 * avg(CAST(n <= actual AS INT)), 6) AS percentile,
        round(CASE WHEN median(abs(n - med)) > 0 THEN (actual - any_value(med)) / (1.4826 * median(abs(n - med))) END, 6) AS robust_z, round(CASE WHEN avg(n) <> 0 THEN 100 * (actual / avg(n) - 1) END, 6) AS lift FROM us JOIN md ON us.key = md.key AND us.target = md.target GROUP BY us.key, us.target, actual""",
    "event_template": "WITH " + EXCESS + ", " + ANCHOR_SQL + """, wi AS (SELECT anchor, CAST(o AS INT) AS "offset", excess FROM anchors, range(-6, 9) r(o), ex WHERE ex.hour = anchor + to_hours(o) AND key = 'purchase')
      SELECT "offset", round(avg(excess), 6) AS effect, round(median(excess), 6) AS median_effect, count(*) AS windows FROM wi GROUP BY 1""",
    "residual_walk": "WITH " + EXCESS + f""", ed AS (SELECT key, quantile_cont(excess, 0.02) AS low, quantile_cont(excess, 0.98) AS high FROM ex GROUP BY 1), cl AS (SELECT key, hour, low, high, least(greatest(excess, low), high) AS x FROM ex JOIN ed USING (key)),
      ly AS (SELECT *, lag(x) OVER (PARTITION BY key ORDER BY hour) AS y FROM cl) SELECT key, round(stddev_pop(x), 6) AS std, round(min(low), 6) AS low, round(max(high), 6) AS high, round(CASE WHEN stddev_pop(x) > 0 THEN (avg(x * y) - avg(x) * avg(y)) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS phi FROM ly GROUP BY 1""",
    "route_economics": """WITH e AS (SELECT a.n_name || ' -> ' || b.n_name AS route, count(*) AS trips, avg(l_quantity) AS mq, avg(l_extendedprice) AS m, avg(l_extendedprice * l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1 HAVING count(*) >= 30)
      SELECT route, trips, round(mq, 6) AS mean_quantity, round(m * trips, 2) AS total_price, round(ln(m) - ln(s / (m * m)) / 2, 6) AS mu, round(sqrt(ln(s / (m * m))), 6) AS sigma FROM e""",
    "session_runs": """WITH e AS (SELECT user_id, event_id, value, ts, epoch_us(ts) AS us FROM events), g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM e), v AS (SELECT *, CAST(sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS visit FROM g)
      SELECT user_id, visit, count(*) AS n, min(us) AS first_us, (max(us) - min(us)) / 1e6 AS seconds, round(sum(value), 4) AS value FROM v GROUP BY 1, 2""",
    "band_pairs": """SELECT a.user_id, a.event_id AS error_id, b.event_id AS purchase_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 43200000000""",
    "value_deciles": """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM orders), b AS (SELECT o_totalprice AS v, greatest(len(list_filter(edges, lambda x: x < o_totalprice)) - 1, 0) AS bucket FROM orders, e)
      SELECT bucket, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean FROM b GROUP BY 1""",
    "separated_peaks": """WITH RECURSIVE h AS (SELECT epoch_us(date_trunc('hour', ts)) / 3600e6 AS hour_at, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY 1), o AS (SELECT hour_at, score, row_number() OVER (ORDER BY score DESC, hour_at) AS r FROM h),
      pick AS (SELECT 1::BIGINT AS r, [hour_at] AS kept FROM o WHERE r = 1 UNION ALL SELECT o.r, CASE WHEN len(kept) < 10 AND len(list_filter(kept, lambda k: abs(k - o.hour_at) < 36)) = 0 THEN list_append(kept, o.hour_at) ELSE kept END FROM pick JOIN o ON o.r = pick.r + 1)
      SELECT hour_at, score FROM h WHERE list_contains((SELECT kept FROM pick ORDER BY r DESC LIMIT 1), hour_at)""",
    "error_metrics": """WITH c AS (SELECT l_returnflag, count(*) FILTER (l_extendedprice > 50000 AND l_quantity > 25) AS tp, count(*) FILTER (NOT l_extendedprice > 50000 AND l_quantity > 25) AS fp, count(*) FILTER (l_extendedprice > 50000 AND NOT l_quantity > 25) AS fn, count(*) FILTER (NOT l_extendedprice > 50000 AND NOT l_quantity > 25) AS tn FROM lineitem GROUP BY 1)
      SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM c""",
    "ranking_quality": """WITH x AS (SELECT CAST(l_extendedprice > 50000 AS INT) AS y, l_quantity / 50 AS score FROM lineitem), r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM x), t AS (SELECT sum(y) AS p, count(*) - sum(y) AS n FROM x),
      g AS (SELECT score, sum(y) AS p, count(*) AS c FROM x GROUP BY 1), q AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS al FROM g)
      SELECT round(((SELECT sum(rk) FILTER (y = 1) FROM r) - t.p * (t.p + 1) / 2) / (t.p * t.n), 6) AS roc_auc, round((SELECT sum(q.p / (SELECT p FROM t) * tp / al) FROM q), 6) AS average_precision, round((SELECT avg((score - y) ** 2) FROM x), 6) AS brier FROM t""",
    "forecast_metrics": "WITH " + PANEL + """, f AS (SELECT * FROM (SELECT key, CAST(n AS DOUBLE) AS y, CAST(lag(n, 168) OVER (PARTITION BY key ORDER BY hour) AS DOUBLE) AS p FROM panel) WHERE p IS NOT NULL)
      SELECT coalesce(key, 'all') AS key, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(1 - sum((p - y) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 6) AS r2, round(sum(abs(p - y)) / sum(abs(y)), 6) AS wape, round(avg(p - y), 6) AS bias FROM f GROUP BY ROLLUP (key)""",
    "weekly_pivot": "SELECT CAST(d AS INT) AS dow, event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT isodow(ts) - 1 AS d FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) LEFT JOIN (SELECT isodow(ts) - 1 AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2) USING (d, event_type)",
    "redacted_documents": r"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret|token))(["'']?\s*[:=]\s*["'']?)[^\s"'',;]{6,}', '\1\2[REDACTED]', 'g'), '(?i)\b(bearer\s+)[A-Za-z0-9._\-]{12,}', '\1[REDACTED]', 'g'), '\bsk-[A-Za-z0-9_\-]{12,}', '[REDACTED]', 'g') AS r FROM documents)
      SELECT doc_id, md5(r) AS masked_md5, length(r) AS n, CAST((length(r) - length(replace(r, '[REDACTED]', ''))) / 10 AS BIGINT) AS masks FROM m WHERE r <> text""",
    "stratified_sample": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders QUALIFY r <= 5",
    "nation_order_gaps": "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n, round(avg(gap), 6) AS mean, median(gap) AS median, quantile_disc(gap, 0.95) AS p95_rank, round(quantile_cont(gap, 0.95), 6) AS p95 FROM (SELECT o_custkey, date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS gap FROM orders) JOIN customer ON o_custkey = c_custkey WHERE gap IS NOT NULL GROUP BY 1",
    "first_seen_codes": "WITH k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_retailprice < 1000)) SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN k USING (p_type)",
    "frontier_parts": "WITH b AS (SELECT p_brand, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.p_brand <> b.p_brand AND o.lines >= b.lines AND o.revenue >= b.revenue AND o.discount <= b.discount AND (o.lines > b.lines OR o.revenue > b.revenue OR o.discount < b.discount))",
    "link_audit": """SELECT 'lineitem.l_orderkey' AS link, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
      UNION ALL SELECT 'customer.c_custkey', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'documents.doc_id', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "trailing_users": """SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) AS mean_5, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
}
SQL = {f"m_{k}": v for k, v in SQL.items()}
