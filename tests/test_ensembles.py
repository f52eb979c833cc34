import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from sparkwright.plans import ensembles as E
from sparkwright.sources import onnx_trees as O

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for _ in range(500):
        a, b, c = rng.random(), rng.gauss(0, 3), float(rng.randrange(8))
        data.append((a, b, c, 3 * a + (b > 1) * c + rng.gauss(0, 0.1), float(a + 0.1 * c > 0.8)))
    df = spark.createDataFrame(data, "a double, b double, c double, y double, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).withColumn("x", F.array(*NAMES)).cache()


@pytest.mark.parametrize("kind", [DecisionTreeRegressor, RandomForestRegressor, GBTRegressor])
def test_regression_equals_mllib(rows, kind):
    options = {"maxIter": 8} if kind is GBTRegressor else {"numTrees": 7} if kind is RandomForestRegressor else {}
    model = kind(labelCol="y", maxDepth=4, seed=1, **options).fit(rows)
    got = model.transform(rows).select("prediction", E.Ensemble.of_mllib(model).score(F.col("x")).alias("own")).toPandas()
    np.testing.assert_allclose(got["own"], got["prediction"], rtol=1e-12)


@pytest.mark.parametrize("kind", [DecisionTreeClassifier, RandomForestClassifier, GBTClassifier])
def test_classification_equals_mllib(rows, kind):
    options = {"maxIter": 6} if kind is GBTClassifier else {"numTrees": 9} if kind is RandomForestClassifier else {}
    model = kind(labelCol="label", maxDepth=3, seed=1, **options).fit(rows)
    got = model.transform(rows).select(vector_to_array("probability").alias("p"), E.Ensemble.of_mllib(model).values(F.col("x")).alias("own")).toPandas()
    own = np.array(got["own"].tolist())
    np.testing.assert_allclose(own[:, -1], np.array(got["p"].tolist())[:, 1], rtol=1e-12)


def test_onnx_file_is_what_the_runtime_computes(spark, rows):
    onnxruntime = pytest.importorskip("onnxruntime")
    for kind, options in ((GBTRegressor, {"maxIter": 12}), (RandomForestRegressor, {"numTrees": 5})):
        model = kind(labelCol="y", maxDepth=5, seed=2, **options).fit(rows)
        data = O.onnx_bytes(E.Ensemble.of_mllib(model), 3)
        again = O.ensemble(data)
        got = rows.select("x", again.score(F.col("x")).alias("own"), F.lit(0)).toPandas()
        x = np.array(got["x"].tolist(), np.float32)
        want = onnxruntime.InferenceSession(data, providers=["CPUExecutionProvider"]).run(["variable"], {"features": x})[0][:, 0]
        np.testing.assert_allclose(got["own"], want, rtol=1e-5, atol=1e-5)


def classifier_file(transform, modes=("BRANCH_LT", "LEAF", "LEAF")):
    """A classifier of one tree on feature 1, NaN to the first leaf, with the field for packed integers left unpacked."""
    values = {"nodes_treeids": [0, 0, 0], "nodes_nodeids": [0, 1, 2], "nodes_featureids": [1, 0, 0], "nodes_values": [0.5, 0.0, 0.0], "nodes_modes": list(modes), "nodes_truenodeids": [1, 0, 0], "nodes_falsenodeids": [2, 0, 0], "nodes_missing_value_tracks_true": [1, 0, 0], "class_treeids": [0, 0], "class_nodeids": [1, 2], "class_ids": [0, 0], "class_weights": [0.75, 0.25], "post_transform": transform, "classlabels_int64s": [0, 1]}
    node = O.field(1, "features") + O.field(2, "label") + O.field(2, "probabilities") + O.field(4, O.CLASSIFIER) + O.field(7, "ai.onnx.ml")
    for name, value in values.items():
        if name == "nodes_nodeids":
            node += O.field(5, O.field(1, name) + b"".join(O.field(8, v) for v in value) + O.field(20, 7))
        else:
            node += O.written_attribute(name, value)
    shape = O.field(1, O.field(2, "n")) + O.field(1, O.field(1, 2))
    info = O.field(1, "features") + O.field(2, O.field(1, O.field(1, 1) + O.field(2, shape)))
    outs = b"".join(O.field(12, O.field(1, n) + O.field(2, O.field(1, O.field(1, k)))) for n, k in (("label", 7), ("probabilities", 1)))
    return O.field(1, 8) + O.field(7, O.field(1, node) + O.field(2, "g") + O.field(11, info) + outs) + O.field(8, O.field(1, "") + O.field(2, 18)) + O.field(8, O.field(1, "ai.onnx.ml") + O.field(2, 3))


@pytest.mark.parametrize("transform", ["LOGISTIC", "NONE"])
def test_binary_classifier_file(spark, transform):
    onnxruntime = pytest.importorskip("onnxruntime")
    data = classifier_file(transform)
    x = [[0.0, 0.25], [0.0, 0.5], [0.0, 9.0], [0.0, float("nan")]]
    own = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x array<double>").select(O.ensemble(data).score(F.col("x"))).collect()]
    want = onnxruntime.InferenceSession(data, providers=["CPUExecutionProvider"]).run(["probabilities"], {"features": np.array(x, np.float32)})[0][:, -1]
    np.testing.assert_allclose(own, want, rtol=1e-6)


def test_files_that_are_not_understood_raise():
    with pytest.raises(ValueError, match="modes"):
        O.ensemble(classifier_file("NONE", modes=("BRANCH_ODD", "LEAF", "LEAF")))
    with pytest.raises(ValueError, match="ends within"):
        O.ensemble(classifier_file("NONE")[:-30])
    with pytest.raises(ValueError, match="transform"):
        O.ensemble(classifier_file("PROBIT"))


def test_modes_missing_values_and_awkward_rows(spark):
    x = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [float("nan"), 2.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [1.0])], "i int, x array<double>")
    for mode, want in (("<=", [10, 20]), ("<", [20, 20]), (">=", [10, 10]), (">", [20, 10]), ("=", [10, 20]), ("<>", [20, 10])):
        t = E.Tree([], [], [], [], [], [], [])
        t.add(0, 1.0, mode, 1, 2, True, [0.0])
        t.leaf([10.0])
        t.leaf([20.0])
        got = [r[0] for r in x.orderBy("i").select(E.Ensemble(t, [0], [0.0]).score(F.col("x"))).collect()]
        assert got == [*want, 10, None, None, None, want[0]]
    ring = E.Tree([0], [1.0], ["<="], [0], [0], [False], [[0.0]])
    with pytest.raises(ValueError, match="follows itself"):
        E.Ensemble(ring, [0], [0.0]).score(F.col("x"))
    only = E.Ensemble.of([1.5, 2.0], base=0.25, mean=True)
    assert x.limit(1).select(only.score(F.col("x"))).first()[0] == 2.0


def test_compiled_trees_and_folds_agree(spark, monkeypatch):
    """Trees of few nodes are plain conditions: no function of lambdas, which are walked through anew for each row."""
    rng = random.Random(8)
    nan = float("nan")
    x = spark.createDataFrame([(i, [rng.choice([0.0, 0.5, 1.0, 2.0, nan, None]) for _ in range(rng.choice([2, 3, 3, 3]))] if i % 9 else None) for i in range(300)], "i int, x array<double>")
    for transform, targets in (("NONE", 1), ("LOGISTIC", 1), ("BINARY", 1), ("NONE", 3), ("SOFTMAX", 3)):
        t = E.Tree([], [], [], [], [], [], [])
        for k, mode in enumerate(E.OPERATORS):
            at = t.add(k % 3, 1.0, mode, 5 * k + 1, 5 * k + 2, k % 2 == 0, [0.0] * targets)
            t.add((k + 1) % 3, 0.5, mode, 5 * k + 3, 5 * k + 4, k % 4 < 2, [0.0] * targets)
            for _ in range(3):
                t.leaf([rng.randrange(-8, 8) / 4 for _ in range(targets)])
            assert at == 5 * k
        model = E.Ensemble(t, [5 * k for k in range(6)], [0.25] * targets, transform, mean=targets == 3)
        own = x.select("i", model.values(F.col("x")).alias("v"), model.score(F.col("x")).alias("s"))
        plan = own._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(E, "COMPILED", 0)
            want = x.select("i", model.values(F.col("x")).alias("v"), model.score(F.col("x")).alias("s"))
        assert "lambda" in want._jdf.queryExecution().optimizedPlan().toString() and "lambda" not in plan
        assert [tuple(r) for r in own.orderBy("i").collect()] == [tuple(r) for r in want.orderBy("i").collect()]


def test_checks_of_schema_and_finite_numbers(spark):
    df = spark.createDataFrame([(1.0, float("inf"))], "a double, b double")
    with pytest.raises(ValueError, match="order"):
        E.checked(df, ["b", "a"], ["a", "b"])
    model = E.Ensemble.of([(0, 0.5, 1.0, -2.0)])
    assert df.select(model.score(E.checked(df, ["a", "b"], ["a", "b"]), low=0.0)).first()[0] == 0.0
    with pytest.raises(Exception, match="finite"):
        df.select(model.score(F.array("a", "b"), finite=True)).collect()


def test_threshold_rounding_keeps_floats_on_their_side():
    for x in (0.1, -0.1, 1 / 3, 1e-50, -1e-50, 3.0, 0.0, -7.25):
        y = O.float_below(x)
        assert y <= x and np.float32(y) == y and float(np.nextafter(np.float32(y), np.float32(np.inf))) > x


def test_two_stages(spark):
    chance, amount = E.Ensemble.of([(0, 1.0, -2.0, 2.0)], transform="LOGISTIC"), E.Ensemble.of([(0, 1.0, -1.0, 9.0)])
    got = [r[0] for r in spark.createDataFrame([([0.0],), ([2.0],)], "x array<double>").select(E.expected_amount(chance, amount, F.col("x"), 13.0)).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(13.0 / (1 + np.exp(-2.0)))
