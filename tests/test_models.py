import random

from pyspark.sql import functions as F

from sparkwright.plans import models as M


def rows(spark, n=600):
    rng = random.Random(1)
    data = []
    for i in range(n):
        a, b = rng.random(), rng.choice([None, rng.random()])
        paid = rng.random() < 0.2 + 0.6 * a
        data.append((i, a, b, (1 + 5 * a) if paid else 0.0, int(paid)))
    return spark.createDataFrame(data, "i int, a double, b double, tip double, paid int")


def test_two_stage(spark):
    df = rows(spark)
    train, test = df.filter("i < 400"), df.filter("i >= 400")
    m = M.TwoStage.fit(train, ["a", "b"], "tip", trees=5)
    out = m.transform(test)
    assert out.count() == 200 and out.filter((F.col("expected") < 0) | (F.col("expected") > m.cap)).count() == 0
    q = m.quality(test, "tip").first()
    assert q["roc_auc"] > 0.6 and q["mae"] < 2.5


def test_detector_rules_importance(spark):
    df = rows(spark).na.fill(0.5, ["b"])
    d = M.detector(df, ["a", "b"], "paid")
    assert d.transform(df).filter("prediction = paid").count() > 350
    text = M.rules(df, ["a", "b"], "paid", least=20)
    assert "If (a " in text
    f = M.forecaster(df, ["a", "b"], "tip", trees=3)
    assert M.importances(f, ["a", "b"])[0][0] == "a"


def test_backtest(spark):
    df = spark.range(300).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("hour"), (F.col("id") % 24).alias("n"), ((F.col("id") + 1) % 24).alias("lead_1"), F.lit(None).cast("double").alias("hole"))
    got = {r["model"]: r for r in M.backtest(df, ["n", "hole"], "2024-01-10", horizons=(1,), trees=5).collect()}
    assert got["fitted"]["mae"] < got["current"]["mae"]
