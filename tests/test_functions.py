import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright.functions import scalars as S
from sparkwright.functions import stats
from sparkwright.functions import windows as W
from sparkwright.functions.text import has_text, mentioned, redacted, snake_case, truncated
from sparkwright.operators import ordered as O
from sparkwright.operators import relational as R


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_casts_and_ratios(spark):
    r = one(spark, S.typed(F.lit(" "), "int"), S.typed(F.lit(" 12 "), "int"), S.typed(F.lit("x"), "double"), S.parsed_time(F.lit("03/09/2024 02:05:00 PM")).cast("string"), S.parsed_time(F.lit("13/45/2024")), S.ratio(F.lit(1), F.lit(0)), S.clipped(F.lit(None).cast("int"), 0, 1), S.clipped(F.lit(7), 0, 5), S.largest(F.lit(float("nan")), F.lit(2.0), F.lit(None)))
    assert tuple(r) == (None, 12, None, "2024-03-09 14:05:00", None, None, None, 5, 2.0)


def test_calendar(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-07-04",), ("2022-12-26",), ("2021-12-31",), ("2024-11-28",), ("2024-05-27",), ("2024-05-28",)], "d string").select(F.col("d"), S.is_federal_holiday(F.to_date("d")).alias("h"))
    assert [r["h"] for r in days.orderBy("d").collect()] == [True, True, True, True, False, True, True]
    assert one(spark, S.is_missing_hour(F.lit("2024-03-10 02:00:00").cast("timestamp_ntz")), S.is_missing_hour(F.lit("2024-03-17 02:00:00").cast("timestamp_ntz")), S.month_distance(F.lit(12), F.lit(1)))[:] == (True, False, 1)
    assert abs(one(spark, S.haversine_km(F.lit(41.88), F.lit(-87.63), F.lit(40.71), F.lit(-74.0)))[0] - 1145) < 5


@pytest.mark.parametrize("b,c", [(0, 0), (3, 9), (0, 1), (10, 10), (1, 40)])
def test_mcnemar(spark, b, c):
    n = b + c
    want = 1.0 if not n else min(1, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    assert abs(one(spark, S.exact_mcnemar(F.lit(b).cast("long"), F.lit(c).cast("long")))[0] - want) < 1e-12


def test_large_exact_tests_are_cut_where_terms_vanish(spark):
    x = [0, 1, 2, 10, 1000, 123_456_789]
    got = one(spark, F.array(*[S.log_factorial(F.lit(float(v))) for v in x]))[0]
    assert got == pytest.approx([math.lgamma(v + 1) for v in x], rel=1e-14, abs=1e-13)
    n, m = 40_000, 19_800
    want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(m + 1)))
    assert one(spark, S.exact_mcnemar(F.lit(m).cast("long"), F.lit(n - m).cast("long")))[0] == pytest.approx(want, rel=1e-9)
    big = spark.createDataFrame([(50_000_100, 49_999_000, 50_000_000, 50_000_900)], "a long, b long, c long, d long")
    p = stats.fisher_two_sided(big).first()["p"]
    chi = (50_000_100 * 50_000_900 - 49_999_000 * 50_000_000) / math.sqrt(99_999_100 * 100_000_900 * 100_000_100 * 99_999_900 / 200_000_000)
    assert p == pytest.approx(math.erfc(abs(chi) / math.sqrt(2)), rel=2e-3)


def test_quantiles_by_place(spark):
    rng = random.Random(8)
    for values in ([rng.choice([1.0, 2.0, 2.0, 9.5]) for _ in range(50)], [rng.random() for _ in range(33)], [4.0], [1.0, None, 3.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        shares = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.95, 1.0]
        want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
        assert O.quantiles(df, "v", shares).first()["q"] == pytest.approx(want)
    assert O.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()["q"] is None


@pytest.mark.parametrize("t", [(3, 1, 1, 3), (0, 5, 7, 2), (12, 5, 29, 2), (0, 0, 3, 4), (1, 0, 0, 1), (300, 200, 250, 310), (7, 0, 0, 900)])
def test_fisher(spark, t):
    a, b, c, d = t
    row, col, n = a + b, a + c, sum(t)
    p = lambda x: math.comb(col, x) * math.comb(n - col, row - x) / math.comb(n, row)
    want = sum(p(x) for x in range(max(0, row + col - n), min(row, col) + 1) if p(x) <= p(a) + 1e-15)
    got = stats.fisher_two_sided(spark.createDataFrame([t], "a long, b long, c long, d long")).first()["p"]
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.96, 3.5, 6.0])
def test_normal(spark, z):
    assert abs(one(spark, S.two_sided_p(F.lit(z)))[0] - math.erfc(z / math.sqrt(2))) < 1e-13


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_holm(spark, ps):
    got = {r["i"]: r["holm_p"] for r in stats.holm(spark.createDataFrame(list(enumerate(ps)), "i int, p double")).collect()}
    m, top = len(ps), 0.0
    for rank, i in enumerate(sorted(range(m), key=lambda i: (ps[i], i))):
        top = max(top, min(1.0, (m - rank) * ps[i]))
        assert abs(got[i] - top) < 1e-12


def test_resampling_is_repeatable_and_whole(spark):
    v = O.numbered(spark.createDataFrame([(float(i),) for i in range(9)], "v double"), "v")
    a, b = (sorted(map(tuple, stats.resampled(v, 20, 5).select("rep", "v").collect())) for _ in range(2))
    assert a == b and len(a) == 180 and len({x for _, x in a}) == 9


def test_metrics(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(200)]
    m = stats.ranking_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert abs(m["roc_auc"] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-9
    assert stats.ranking_metrics(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["roc_auc"] is None


def test_text(spark):
    text = "api_key = 'abcdef123456' and Bearer abcdefghijklmnop, sk-abcdefghijklmnop; token: short"
    r = one(spark, redacted(F.lit(text)), truncated(F.lit("añ😀bcd"), 3), has_text(F.lit("  \n")), has_text(F.lit(None).cast("string")), mentioned(F.lit("Notebook_V2 notebook_v1 NOTEBOOK_v2"), r"(?i)notebook_v\d+"))
    assert r[0] == "api_key = '[REDACTED]' and Bearer [REDACTED], [REDACTED]; token: short"
    assert tuple(r)[1:] == ("añ😀…[truncated 3 chars]", False, False, ["notebook_v1", "notebook_v2"])
    assert snake_case(" Percent Time (Chicago) % #1") == "percent_time_chicago_percent_number_1"


def test_windows(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, None, None, 4.0, 5.0, None, None, None, None, 10.0])], "k string, t int, x double")
    w = W.series(["k"], "t")
    got = [r[0] for r in df.select("t", W.interpolated(F.col("x"), w, F.col("t")).alias("y")).orderBy("t").select("y").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    got = [r[0] for r in df.select("t", W.trailing(F.avg, F.col("x"), w, 3, 2).alias("y")).orderBy("t").select("y").collect()]
    assert got == [None, None, None, None, None, 4.5, 4.5, None, None, None]


def test_joins(spark):
    rng = random.Random(3)
    a, b = [("ab"[i % 2], i, rng.randrange(200)) for i in range(40)], [("ab"[i % 2], i, rng.randrange(200)) for i in range(40)]
    left, right = spark.createDataFrame(a, "k string, i int, x int"), spark.createDataFrame(b, "k string, j int, y int")
    got = {(r["i"], r["j"]) for r in R.band_join(left, right, ["k"], "x", "y", 7).collect()}
    assert got == {(i, j) for k, i, x in a for q, j, y in b if k == q and abs(x - y) <= 7}
    n = {r["i"]: (r["next_y"], r["next_j"]) for r in R.next_after(left, right, ["k"], "x", "y", ["j"]).collect()}
    for k, i, x in a:
        later = sorted((y, j) for q, j, y in b if q == k and y > x)
        assert n[i] == (later[0] if later else (None, None))
    near = {r["i"]: r["nearest_j"] for r in R.nearest(left, right, "x", "y", "j").collect()}
    assert near == {i: min(b, key=lambda q: (abs(q[2] - x), q[1]))[1] for _, i, x in a}


def test_no_frame_ends_with_the_last_row(spark):
    """Such a frame is gone through anew for each row, so time would grow with the square of a partition's rows."""
    left, right = spark.range(50).selectExpr("'a' as k", "id as i", "id % 5 as x"), spark.range(50).selectExpr("'a' as k", "id as j", "id % 7 as y")
    for out in (R.nearest(left, right, "x", "y", "j"), R.next_after(left, right, ["k"], "x", "y", ["j"])):
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_selection(spark):
    rng = random.Random(2)
    rows = [(float(t), float(rng.randrange(50))) for t in rng.sample(range(400), 80)]
    got = sorted((r["t"], r["s"]) for r in R.separated(spark.createDataFrame(rows, "t double, s double"), "t", "s", 12.0, 9).collect())
    kept = []
    for t, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(kept) < 9 and all(abs(t - u) >= 12 for u, _ in kept):
            kept.append((t, s))
    assert got == sorted(kept)
    d = R.deciles(spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]], "v double"), "v")
    assert d.select("bucket").distinct().count() < 10 and d.agg(F.min("bucket")).first()[0] == 0
    c = {r["x"]: r["code"] for r in R.codes(spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "x string, t int"), "x", F.col("t") == 1).collect()}
    assert c == {"a": 0, "b": 1, "c": -1}
    assert R.sampled(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], 4, 1, "id").count() == 12
    with pytest.raises(ValueError):
        R.joined_once(spark.range(2), spark.createDataFrame([(1,), (1,)], "id long"), ["id"])


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    want = [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 4.0)]
    assert sorted(map(tuple, df.select("v", W.average_rank(F.col("v")).alias("r")).collect())) == want
    assert sorted(map(tuple, O.average_ranks(df, {"r": F.col("v")}).collect())) == want


def test_running_sums_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    got = {r["i"]: (r["s"], r["t"]) for r in O.running(spark.createDataFrame(rows, "k int, i int, v int").repartition(7), [F.desc("k"), "i"], {"t": F.col("v")}).collect()}
    total = 0
    for at, (_, i, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += v
        assert got[i] == (at, total)


def test_frontier_in_blocks(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(30), rng.randrange(30), rng.randrange(30)) for i in range(300)]
    got = {r["i"] for r in R.undominated(spark.createDataFrame(rows, "i int, a int, b int, c int"), "i", ["a", "b"], ["c"], block=40).collect()}
    beats = lambda p, q: p[1] >= q[1] and p[2] >= q[2] and p[3] <= q[3] and (p[1] > q[1] or p[2] > q[2] or p[3] < q[3])
    assert got == {q[0] for q in rows if not any(beats(p, q) for p in rows)}


def test_greedy_pairs(spark):
    rng = random.Random(7)
    a, b = rng.sample(range(300), 60), rng.sample(range(300), 60)
    got = {(r["x"], r["y"]) for r in R.matched(spark.createDataFrame([(x, x) for x in a], "x int, r int"), spark.createDataFrame([(y,) for y in b], "y int"), "x", "y", 9, "r").collect()}
    want, used_x, used_y = set(), set(), set()
    for _, _, x, y in sorted((abs(x - y), x, x, y) for x in a for y in b if abs(x - y) <= 9):
        if x not in used_x and y not in used_y:
            used_x.add(x)
            used_y.add(y)
            want.add((x, y))
    assert got == want


def test_metrics_by_key(spark):
    rng = random.Random(8)
    rows = [("abc"[i % 3], int(rng.random() < 0.4), round(rng.random(), 1)) for i in range(300)]
    got = {r["k"]: r for r in stats.ranking_metrics(spark.createDataFrame(rows, "k string, y int, s double"), "y", "s", "k").collect()}
    for k in "abc":
        one = stats.ranking_metrics(spark.createDataFrame([r[1:] for r in rows if r[0] == k], "y int, s double"), "y", "s").first()
        assert all(abs(got[k][c] - one[c]) < 1e-12 for c in ("roc_auc", "average_precision", "brier"))
