"""Models on the engine's tables, fitted and applied by MLlib: forecasts by horizon, two-stage amounts, detectors, trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.scalars import number_or_null
from sparkwright.functions.stats import ranking_metrics, regression_metrics


@dataclass(frozen=True)
class Medians:
    """Medians of training features, for missing values there and later."""

    values: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, names: list[str]) -> Medians:
        row = train.agg(*[F.median(number_or_null(F.col(c))).alias(c) for c in names]).first()
        return cls({c: row[c] if row[c] is not None else 0.0 for c in names})

    def fill(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(number_or_null(F.col(c)), F.lit(v)) for c, v in self.values.items()})


def assembled(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="features")


def forecaster(train: DataFrame, names: list[str], target: str, trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees for one horizon."""
    return Pipeline(stages=[assembled(names), GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=seed, predictionCol="forecast")]).fit(train.filter(F.col(target).isNotNull()))


def backtest(features: DataFrame, names: list[str], split: str, horizons=(1, 2, 3, 6), **options) -> DataFrame:
    """horizon and the error measures of the fitted forecast and of the current value, on the hours from ``split``."""
    out = None
    for h in horizons:
        rows = features.filter(F.col(f"lead_{h}").isNotNull()).withColumn("y", F.col(f"lead_{h}").cast("double"))
        train, test = rows.filter(F.col("hour") < split), rows.filter(F.col("hour") >= split)
        fill = Medians.fit(train, names)
        scored = forecaster(fill.fill(train), names, "y", **options).transform(fill.fill(test)).withColumn("forecast", F.greatest("forecast", F.lit(0.0)))
        both = scored.select("y", F.explode(F.create_map(F.lit("fitted"), F.col("forecast"), F.lit("current"), F.col("n").cast("double"))).alias("model", "p"))
        part = both.groupBy("model").agg(*regression_metrics("y", "p")).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class TwoStage:
    """The chance of an amount above zero times the amount expected then, which is fitted as a logarithm and capped."""

    chance: PipelineModel
    amount: PipelineModel
    medians: Medians
    cap: float

    @classmethod
    def fit(cls, train: DataFrame, names: list[str], target: str, most: float = 100.0, share: float = 0.995, trees: int = 20, depth: int = 4, seed: int = 42) -> TwoStage:
        cap = min(most, train.agg(F.percentile(target, F.lit(share)).alias("c")).first()["c"] or most)
        medians = Medians.fit(train, names)
        rows = medians.fill(train).withColumn("paid", (F.col(target) > 0).cast("double")).withColumn("logged", F.log1p(F.least(F.col(target), F.lit(cap))))
        chance = Pipeline(stages=[assembled(names), GBTClassifier(labelCol="paid", maxIter=trees, maxDepth=depth, seed=seed)]).fit(rows)
        amount = Pipeline(stages=[assembled(names), GBTRegressor(labelCol="logged", maxIter=trees, maxDepth=depth, seed=seed, predictionCol="log_amount")]).fit(rows.filter("paid = 1"))
        return cls(chance, amount, medians, float(cap))

    def transform(self, df: DataFrame) -> DataFrame:
        first = self.chance.transform(self.medians.fill(df)).withColumn("chance", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction")
        second = self.amount.transform(first).drop("features")
        amount = F.least(F.greatest(F.expm1("log_amount"), F.lit(0.0)), F.lit(self.cap))
        return second.withColumn("expected", F.col("chance") * amount).drop("log_amount")

    def quality(self, test: DataFrame, target: str) -> DataFrame:
        scored = self.transform(test).withColumn("paid", (F.col(target) > 0).cast("int"))
        errors = scored.withColumn("y", F.col(target).cast("double")).agg(*regression_metrics("y", "expected"))
        return ranking_metrics(scored, "paid", "chance").crossJoin(errors)


def detector(train: DataFrame, names: list[str], label: str, c: float = 0.5) -> PipelineModel:
    """Balanced logistic regression on scaled features; the classes weigh the same."""
    n = train.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).first()
    weight = F.when(F.col(label) == 1, F.lit(n["n"] / (2.0 * max(1, n["p"])))).otherwise(F.lit(n["n"] / (2.0 * max(1, n["n"] - n["p"]))))
    rows = train.withColumn("weight", weight).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(1, n["n"])), maxIter=100)]).fit(rows)


def rules(train: DataFrame, names: list[str], label: str, depth: int = 4, least: int = 150) -> str:
    """The text of a shallow tree."""
    model = Pipeline(stages=[assembled(names), DecisionTreeClassifier(labelCol=label, maxDepth=depth, minInstancesPerNode=least, seed=1)]).fit(train.withColumn(label, F.col(label).cast("double")))
    text = model.stages[-1].toDebugString
    for i in reversed(range(len(names))):
        text = text.replace(f"feature {i} ", f"{names[i]} ")
    return text


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Features by falling share of the trees' gain."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    total = sum(gains) or 1.0
    return sorted(((n, g / total) for n, g in zip(names, gains, strict=True)), key=lambda x: (-x[1], x[0]))
