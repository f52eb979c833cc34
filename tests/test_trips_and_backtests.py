import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import stats
from sparkwright.plans import backtests as B
from sparkwright.plans import trips as T

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_trip_features_and_filters_with_nulls(spark):
    rows = [("a", "b", at(23), at(25), 10.0, 20.0), ("a", "a", at(1), at(1), 0.0, -1.0), (None, "a", at(1), None, 5.0, None)]
    t = T.trip_features(spark.createDataFrame(rows, "origin string, destination string, start timestamp_ntz, end timestamp_ntz, distance double, fare double"))
    got = t.orderBy(F.desc_nulls_last("fare")).collect()
    first, second, third = got
    assert (first["seconds"], first["speed"], first["same_place"], first["crosses_date"], first["fare_per_distance"], first["clock"]) == (7200.0, 5.0, False, True, 2.0, 23) and first["log_fare"] == pytest.approx(math.log(21))
    assert (second["speed"], second["same_place"], second["crosses_date"], second["log_fare"], second["fare_per_distance"]) == (None, True, False, None, None)
    assert (third["seconds"], third["same_place"], third["crosses_date"], third["log_fare"]) == (None, None, None, None)
    kept = lambda **k: t.filter(T.plausible({"distance": (0.0, 10.0)}, **k)).count()
    assert kept() == 3 and kept(distinct_places=True) == 2 and t.filter(T.plausible({"fare": (-1.0, 20.0)})).count() == 2


def test_rates_fall_back_level_by_level(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice("xyz"), rng.choice([1, 2]), rng.random()) for _ in range(60)] + [("c", "w", 9, 0.5)]
    got = {(r["p"], r["q"], r["m"]): (r["rate"], r["n"], r["level"]) for r in T.rates(spark.createDataFrame(rows, "p string, q string, m int, v double"), ["p", "q", "m"], "v", 5).collect()}
    keys = {r[:3] for r in rows}
    assert set(got) == keys
    for key in keys:
        for level in range(4):
            own = [r[3] for r in rows if r[level:3] == key[level:]]
            if len(own) >= 5 or level == 3:
                assert got[key] == (pytest.approx(sum(own) / len(own)), len(own), level)
                break


def test_modes_representatives_means_and_coverage(spark):
    rows = [("k", 1.0, 5), ("k", 2.0, 5), ("k", 4.0, 3), ("k", 8.0, 3), ("k", 9.0, None), ("l", 7.0, None)]
    df = spark.createDataFrame([(k, v, d, i) for i, (k, v, d) in enumerate(rows)], "key string, v double, d int, id int")
    assert [(r["key"], r["mode"], r["count"]) for r in T.mode(df, ["key"], "d").collect()] == [("k", 3, 2)]
    got = {(r["key"], r["share"]): (r["quantile"], r["id"]) for r in T.representatives(df, ["key"], "v", "id", (0.25, 0.5)).collect()}
    assert got == {("k", 0.25): (2.0, 1), ("k", 0.5): (4.0, 2), ("l", 0.25): (7.0, 5), ("l", 0.5): (7.0, 5)}
    one = df.agg(T.weighted_mean(F.col("v"), F.col("d")).alias("m"), T.coverage(F.col("v"), F.lit(2.0), F.lit(8.0)).alias("c"), T.weighted_mean(F.col("v"), F.lit(0)).alias("none")).first()
    assert one["m"] == pytest.approx((5 + 10 + 12 + 24) / 16) and one["c"] == pytest.approx(4 / 6) and one["none"] is None


def test_sides_are_padded_and_lags_compared(spark):
    go, come = spark.createDataFrame([("a",), ("a",), ("b",)], "n string"), spark.createDataFrame([("b",), ("c",)], "n string")
    assert sorted(map(tuple, T.two_sided(go, come, ["n"]).collect())) == [("a", 2, 0), ("b", 1, 1), ("c", 0, 1)]
    rows = [("k", lag, float(i), float((i - lag) ** 2 if lag != 2 else i)) for lag in range(4) for i in range(6)] + [("flat", 0, 1.0, 2.0)]
    got = T.best_lags(spark.createDataFrame(rows, "key string, lag int, x double, y double"), ["key"]).collect()
    assert [(r["key"], r["lag"], r["hours"]) for r in got] == [("k", 2, 6)] and got[0]["r"] == pytest.approx(1.0)


def panel(spark, hours=60):
    return spark.createDataFrame([(k, at(h), h * (1 if k == "x" else 2)) for k in "xy" for h in range(hours)], "key string, hour timestamp_ntz, n int")


def test_panels_by_origin_and_horizon(spark):
    p = panel(spark)
    o = B.origins(p, 10, 15, 6)
    assert sorted(r["origin"] for r in o.collect()) == [at(20), at(30), at(40), at(50)]
    rows = B.at_horizons(p, o, 24).collect()
    assert len(rows) == 2 * (24 * 2 + 20 + 10)  # the last two origins have 20 and 10 hours left
    assert all(r["target"] == r["origin"] + dt.timedelta(hours=r["horizon"] - 1) and r["label"] == (1 if r["key"] == "x" else 2) * round((r["target"] - START).total_seconds() / 3600) for r in rows)
    with pytest.raises(ValueError, match="repeat"):
        B.at_horizons(p.unionByName(p.limit(1)), o, 3)


def test_labels_must_agree(spark):
    a = B.at_horizons(panel(spark), B.origins(panel(spark), 10, 15, 6), 3)
    keys = ["key", "origin", "horizon"]
    other = a.select(*keys, "label", (F.col("label") + 1).alias("guess"))
    assert B.aligned(a, other, keys, "label").filter("guess = label + 1").count() == a.count()
    with pytest.raises(ValueError, match="0 rows lack their partner, 1 have"):
        B.aligned(a, other.withColumn("label", F.when((F.col("key") == "x") & (F.col("origin") == F.lit(at(20))) & (F.col("horizon") == 2), F.lit(None)).otherwise(F.col("label"))), keys, "label")
    with pytest.raises(ValueError, match="[1-9][0-9]* rows lack"):
        B.aligned(a, other.filter("horizon < 3"), keys, "label")


def test_scan_finds_planted_events(spark):
    rng = random.Random(2)
    events = [at(100), at(180)]
    z = {(k, h): rng.gauss(0, 0.3) for k in ("in", "out") for h in range(300)}
    for e in (100, 180):
        z |= {("in", e - o): 4.0 for o in (1, 2, 3)} | {("out", e + o): 4.0 for o in (2, 3, 4)}
    df = spark.createDataFrame([(k, at(h), v) for (k, h), v in z.items() if (k, h) != ("in", 250)], "key string, hour timestamp_ntz, z double")
    parts = {"arrival": ("in", (-3, -2, -1)), "leaving": ("out", (2, 3, 4))}
    f = {r["hour"]: r for r in B.scan_features(df, parts).collect()}
    assert f[at(100)]["arrival"] == 4.0 and f[at(100)]["leaving"] == 4.0
    want = {at(h) for h in range(3, 296) if not h - 3 <= 250 <= h - 1}
    assert set(f) == want and f[at(50)]["arrival"] == pytest.approx(sum(z["in", 50 - o] for o in (1, 2, 3)) / 3)
    scores = spark.createDataFrame([(h, r["arrival"] + r["leaving"]) for h, r in f.items()], "hour timestamp_ntz, score double")
    known = spark.createDataFrame([(e,) for e in events], "e timestamp_ntz").select(B.hours_of(F.col("e")).alias("at"))
    got = {r["k"]: (r["found"], r["hits"], r["precision"], r["recall"]) for r in B.quality_at(B.detections(scores, 18.0, 6), known, 6.0, (1, 2, 6)).collect()}
    assert got == {1: (1, 1, 1.0, 0.5), 2: (2, 2, 1.0, 1.0), 6: (6, 2, pytest.approx(1 / 3), 1.0)}


def test_poisson_resamples(spark):
    rows = spark.createDataFrame([(f"r{i}", float(i % 10)) for i in range(400)], "id string, v double")
    w = stats.weighted(rows, F.col("id"), 50, 7)
    first, again = (sorted(map(tuple, x.select("id", "rep", "w").collect())) for x in (w, stats.weighted(rows.repartition(5), F.col("id"), 50, 7)))
    assert first == again and {r[1] for r in first} == set(range(50))
    n = Counter(x[2] for x in first)
    total = 400 * 50
    assert abs(sum(k * c for k, c in n.items()) / total - 1) < 0.03
    for k in (1, 2, 3):
        assert abs(n[k] / total - math.exp(-1) / math.factorial(k)) < 0.015
    interval = stats.bootstrap(rows, F.col("id"), stats.mean_of(F.col("v")), 300, 7).first()
    se = math.sqrt(8.25 / 400)
    assert interval["low"] == pytest.approx(4.5 - 1.96 * se, abs=0.06) and interval["high"] == pytest.approx(4.5 + 1.96 * se, abs=0.06)
    assert stats.bootstrap(rows.limit(0), F.col("id"), stats.mean_of(F.col("v")), 10, 7).first()["low"] is None
