import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.functions import streams as S
from sparkwright.operators.ordered import numbered
from sparkwright.operators.tables import written
from sparkwright.plans import profile as P


def test_bounds_of_the_sketches(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 100) if i % 3 else float(rng.randrange(4)) for i in range(20_000)]
    rows = [(v, None if i % 10 == 0 else f"w{min(rng.randrange(1000), rng.randrange(1000), i % 7)}", i % 2 == 0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "`a.b` double, word string, flag boolean").repartition(7)
    got = {r["column"]: r for r in P.described(df, rank_error=0.001, distinct_error=0.02, top=3).collect()}
    x = np.sort(values)
    a = got["a.b"]
    assert (a["rows"], a["nulls"], a["low"], a["high"]) == (20_000, 0, x[0], x[-1]) and a["mean"] == pytest.approx(x.mean()) and a["std"] == pytest.approx(x.std(ddof=1))
    for q, v in zip(P.QUANTILES, a["quantiles"], strict=True):
        assert np.searchsorted(x, v, "left") / len(x) - 0.001 <= q <= np.searchsorted(x, v, "right") / len(x) + 0.001
    assert abs(a["distinct"] / len(set(values)) - 1) < 0.06
    words = Counter(r[1] for r in rows if r[1])
    assert got["word"]["nulls"] == 2000 and got["word"]["first"] == min(words) and got["word"]["mean"] is None
    assert [(c["value"], c["n"]) for c in got["word"]["common"]] == words.most_common(3)
    assert (got["flag"]["distinct"], got["flag"]["type"], got["flag"]["place"]) == (2, "boolean", 2)


def test_profile_of_an_empty_table_and_of_nested_columns(spark):
    df = spark.createDataFrame([], "a int, m map<string,int>, s struct<x:int>")
    got = P.described(df).orderBy("place").collect()
    assert [(r["column"], r["rows"], r["nulls"], r["mean"]) for r in got] == [("a", 0, 0, None), ("m", 0, 0, None), ("s", 0, 0, None)]


@pytest.mark.parametrize(("n", "repetitions", "block"), [(1, 5, 64), (7, 9, 16), (64, 3, 100), (1000, 4, 999), (100, 20, 1 << 20)])
def test_draws_are_those_of_one_generator(spark, n, repetitions, block):
    rng = random.Random(20260914)
    want = [(r, i, rng.choice(range(n))) for r in range(repetitions) for i in range(n)]
    assert sorted(map(tuple, S.draws(spark, 20260914, n, repetitions, block).collect())) == want


def test_interval_is_that_of_one_process(spark):
    values = [random.Random(i).random() for i in range(57)]
    rng = random.Random(11)
    means = sorted(sum(rng.choice(values) for _ in values) / len(values) for _ in range(200))
    df = numbered(spark.createDataFrame(list(enumerate(values)), "k int, v double"), "k")
    got = S.sequential_bootstrap(df, "v", F.avg("v"), 11, 200).first()
    assert (got["low"], got["high"]) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)), abs=1e-12)
    none = S.sequential_bootstrap(df.limit(0), "v", F.avg("v"), 11, 200).first()
    assert none["low"] is None and S.draws(spark, 1, 0, 5).count() == 0


def test_draws_are_not_broadcast(spark):
    values = written(numbered(spark.range(3000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v")), "k"), "values")
    out = S.sequential_bootstrap(values, "v", F.avg("v"), 3, 200)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_uniform_numbers_by_their_place(spark):
    want = np.random.default_rng(42).random(5000)
    places = [0, 3, 4, 4999, 17, 17, 1200]
    got = S.with_uniforms(spark.createDataFrame([(p,) for p in [*places, None]], "p long"), "p", 42).collect()
    assert [r["u"] for r in got[:-1]] == [want[p] for p in places] and got[-1]["u"] is None
