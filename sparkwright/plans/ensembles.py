"""Scores of tree ensembles as Spark expressions, without a runtime library or Python workers.

An ensemble is flat arrays over the nodes of all its trees. A row's score is one expression: from each root a fold steps
down at most as often as the deepest tree is deep, and the leaves' weights are summed. The arrays are a constant of the
plan, so neither a model file nor a session is opened in tasks. Ensembles come from MLlib models, from ONNX files
(``sources.onnx_trees``) or from nested tuples.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.plans.domain import table

NODE = "array<struct<f:int,t:double,o:int,y:int,n:int,m:boolean,w:array<double>>>"
OPERATORS = ["<=", "<", ">=", ">", "=", "<>"]
COMPARE = dict(zip(OPERATORS, (le, lt, ge, gt, eq, ne), strict=True))
#: As many nodes, times targets, are compiled; with more, the code would be too long for the compiler of the virtual machine.
COMPILED = 256


@dataclass
class Tree:
    """Nodes by place: feature, threshold, comparison, the next nodes (-1 at leaves), does NaN go to yes, weights."""

    feature: list[int]
    threshold: list[float]
    mode: list[str]
    yes: list[int]
    no: list[int]
    missing: list[bool]
    weight: list[list[float]]

    def add(self, feature: int, threshold: float, mode: str, yes: int, no: int, missing: bool, weight: list[float]) -> int:
        for column, value in zip((self.feature, self.threshold, self.mode, self.yes, self.no, self.missing, self.weight), (feature, threshold, mode, yes, no, missing, weight), strict=True):
            column.append(value)
        return len(self.feature) - 1

    def leaf(self, weight: list[float]) -> int:
        return self.add(0, 0.0, "<=", -1, -1, False, weight)


@dataclass
class Ensemble:
    trees: Tree
    roots: list[int]
    base: list[float]
    #: NONE, LOGISTIC, SOFTMAX, or BINARY (a chance and its complement)
    transform: str = "NONE"
    mean: bool = False
    #: features are rounded to 32 bits before they are compared
    single: bool = False

    @classmethod
    def of(cls, trees: list, base: float = 0.0, transform: str = "NONE", mean: bool = False) -> Ensemble:
        """From nested tuples: (feature, threshold, yes, no), where feature <= threshold goes to yes, and numbers at leaves."""
        flat = Tree([], [], [], [], [], [], [])

        def place(node) -> int:
            if not isinstance(node, tuple):
                return flat.leaf([float(node)])
            feature, threshold, yes, no = node
            at = flat.add(feature, float(threshold), "<=", -1, -1, False, [0.0])
            flat.yes[at], flat.no[at] = place(yes), place(no)
            return at

        return cls(flat, [place(t) for t in trees], [base], transform, mean)

    @classmethod
    def of_mllib(cls, model) -> Ensemble:
        """A fitted MLlib tree, forest or boosted ensemble of continuous features.

        Regression: its prediction. Classification: the classes' probabilities; of boosted trees, as MLlib's are binary,
        the second class's chance is the logistic of twice the sum. MLlib's NaN goes to no.
        """
        name = type(model).__name__
        trees = model.trees if hasattr(model, "trees") else [model]
        factors = list(model.treeWeights) if name.startswith("GBT") else [1.0] * len(trees)
        votes = "Classification" in name and not name.startswith("GBT")
        flat = Tree([], [], [], [], [], [], [])

        def place(node, factor: float) -> int:
            if node.numDescendants() == 0:
                if not votes:
                    return flat.leaf([factor * node.prediction()])
                counts = list(node.impurityStats().stats())
                return flat.leaf([c / (sum(counts) or 1.0) for c in counts])
            split = node.split()
            if not split.getClass().getSimpleName().startswith("Continuous"):
                raise ValueError("categorical splits are not supported")
            at = flat.add(split.featureIndex(), split.threshold(), "<=", -1, -1, False, [])
            flat.yes[at], flat.no[at] = place(node.leftChild(), factor), place(node.rightChild(), factor)
            return at

        roots = [place(t._call_java("rootNode"), f) for t, f in zip(trees, factors, strict=True)]
        targets = max(len(w) for w in flat.weight)
        flat.weight = [w or [0.0] * targets for w in flat.weight]
        if name == "GBTClassificationModel":
            flat.weight = [[2 * w[0]] for w in flat.weight]
            return cls(flat, roots, [0.0], "LOGISTIC")
        return cls(flat, roots, [0.0] * targets, "NONE", mean=votes or name == "RandomForestRegressionModel")

    def owners(self) -> list[int]:
        """The tree of each node."""
        out = [0] * len(self.trees.feature)
        for k, root in enumerate(self.roots):
            at = [root]
            while at:
                i = at.pop()
                out[i] = k
                if self.trees.yes[i] >= 0:
                    at += [self.trees.yes[i], self.trees.no[i]]
        return out

    def depth(self) -> int:
        """Steps from a root to the farthest leaf; raises where nodes form a ring."""
        level, steps = self.roots, 0
        while True:
            level = [x for i in level if self.trees.yes[i] >= 0 for x in (self.trees.yes[i], self.trees.no[i])]
            if not level:
                return steps
            steps += 1
            if steps > len(self.trees.feature):
                raise ValueError("a node follows itself")

    def leaves(self, features: Column) -> list[Column]:
        """For each target the weights of the leaves that a row reaches, a sum over the trees; null as ``values`` says.

        Up to ``COMPILED`` nodes each tree is one nested condition, which Spark compiles; beyond that the nodes are a
        constant array, through which folds step.
        """
        t = self.trees
        if len(t.feature) * len(self.base) > COMPILED:
            return self.folded(features)

        def number(i: int) -> Column:
            x = F.get(features, F.lit(i))
            return x.cast("float").cast("double") if self.single else x.cast("double")

        def walk(i: int, target: int) -> Column:
            if t.yes[i] < 0:
                return F.lit(float(t.weight[i][target]))
            x, threshold = number(t.feature[i]), t.threshold[i]
            goes = COMPARE[t.mode[i]](x, F.lit(float(threshold)))
            if t.missing[i]:
                goes = F.isnan(x) | goes
            elif t.mode[i] not in ("<=", "<", "=") or math.isnan(threshold):  # NaN is larger than any number
                goes = ~F.isnan(x) & goes
            return F.when(goes, walk(t.yes[i], target)).when(x.isNotNull(), walk(t.no[i], target))

        self.depth()  # raises where nodes form a ring
        out = []
        for target in range(len(self.base)):
            total = F.lit(0.0)
            for root in self.roots:
                total = total + walk(root, target)
            out.append(total)
        return out

    def folded(self, features: Column) -> list[Column]:
        """``leaves`` by folds over the array of nodes."""
        t = self.trees
        rows = [{"f": t.feature[i], "t": t.threshold[i], "o": OPERATORS.index(t.mode[i]), "y": t.yes[i], "n": t.no[i], "m": t.missing[i], "w": t.weight[i]} for i in range(len(t.feature))]
        modes = {t.mode[i] for i in range(len(t.feature)) if t.yes[i] >= 0}
        nodes = F.from_json(F.lit(json.dumps(rows)), NODE)
        roots = F.from_json(F.lit(json.dumps(self.roots)), "array<int>")

        def goes(x: Column, node: Column) -> Column:
            out = None
            for mode in sorted(modes, key=OPERATORS.index):
                compared = COMPARE[mode](x, node["t"])
                out = compared if out is None else F.when(node["o"] == OPERATORS.index(mode), compared).otherwise(out)
            return F.when(F.isnan(x), node["m"]).otherwise(out)

        def step(node: Column, _: Column) -> Column:
            x = F.get(of, node["f"])
            return F.when(node["y"] < 0, node).when(x.isNull(), F.lit(None)).otherwise(F.get(nodes, F.when(goes(x, node), node["y"]).otherwise(node["n"])))

        of = F.transform(features, lambda x: x.cast("float").cast("double") if self.single else x.cast("double"))
        turns = F.sequence(F.lit(1), F.lit(self.depth())) if self.depth() else F.array().cast("array<int>")
        leaves = F.transform(roots, lambda r: F.aggregate(turns, F.get(nodes, r), step)["w"])
        start = F.array(*[F.lit(0.0) for _ in self.base])
        total = F.aggregate(leaves, start, lambda s, w: F.zip_with(s, w, lambda a, b: a + b)) if len(self.base) > 1 else F.array(F.aggregate(leaves, F.lit(0.0), lambda s, w: s + F.get(w, F.lit(0))))
        return [F.get(total, F.lit(k)) for k in range(len(self.base))]

    def targets(self, features: Column, finite: bool = False) -> list[Column]:
        """The values of ``values``, a column for each target."""
        share = float(len(self.roots)) if self.mean else 1.0
        out = [v / F.lit(share) + F.lit(float(b)) for v, b in zip(self.leaves(features), self.base, strict=True)]
        if self.transform == "LOGISTIC":
            out = [1 / (1 + F.exp(-v)) for v in out]
        elif self.transform == "SOFTMAX":
            out = [1 / reduce(add, [F.exp(u - v) for u in out], F.lit(0.0)) for v in out]
        elif self.transform == "BINARY":
            out = [1 - out[0], out[0]]
        out = [F.when(features.isNotNull(), v) for v in out]
        if not finite:
            return out
        of = features.cast("array<float>" if self.single else "array<double>").cast("array<double>")
        # null, not false, where none of them is found but a number is null
        odd = reduce(or_, [F.array_contains(of, F.lit(x)) for x in (float("nan"), float("inf"), float("-inf"))])
        good = features.isNull() | F.coalesce(~odd, F.lit(False))
        return [F.when(good, v).otherwise(F.raise_error(F.lit("features must be finite")).cast("double")) for v in out]

    def values(self, features: Column, finite: bool = False) -> Column:
        """An array of one value for each target, for an array of numbers.

        Null where ``features`` is null or too short for a feature that is compared, or a compared number is null. NaN
        goes where the node says; with ``finite`` any number that is not finite raises.
        """
        out = self.targets(features, finite)
        return F.when(reduce(and_, [v.isNotNull() for v in out]), F.array(*out))

    def score(self, features: Column, low: float | None = None, finite: bool = False) -> Column:
        """The last target's value, at least ``low``."""
        value = self.targets(features, finite)[-1]
        return value if low is None else F.greatest(value, F.lit(low))

    def sql(self, names: list[str]) -> str:
        """The same score of a single target as SQL text: one nested CASE for each tree."""
        t = self.trees

        def walk(i: int) -> str:
            if t.yes[i] < 0:
                return f"{t.weight[i][0]!r}::DOUBLE"
            return f"CASE WHEN {names[t.feature[i]]} {t.mode[i]} {t.threshold[i]!r}::DOUBLE THEN {walk(t.yes[i])} ELSE {walk(t.no[i])} END"

        total = " + ".join(f"({walk(r)})" for r in self.roots)
        value = f"(({total}) / {float(len(self.roots) if self.mean else 1)!r}::DOUBLE + {self.base[0]!r}::DOUBLE)"
        return f"(1 / (1 + exp(-{value})))" if self.transform == "LOGISTIC" else value


def expected_amount(chance: Ensemble, log_amount: Ensemble, features: Column, cap: float) -> Column:
    """A two-stage score: the chance of an amount times the amount, which is fitted as log(1 + amount), from 0 to ``cap``."""
    return chance.score(features) * capped(log_amount.score(features), cap)


def capped(log_amount: Column, cap: float) -> Column:
    return F.least(F.greatest(F.expm1(log_amount), F.lit(0.0)), F.lit(float(cap)))


def checked(df: DataFrame, features: list[str], expected: list[str]) -> Column:
    """The columns as one array, in the order that the model was fitted with; raises if their names differ from ``expected``."""
    if features != expected:
        raise ValueError(f"features differ: {sorted(set(features) ^ set(expected)) or 'order'}")
    return F.array(*[df[c].cast("double") for c in features])


FEATURES = ["quantity", "price", "discount", "tax", "month", "days"]
#: A small exported two-stage model of order lines: the chance that a line comes back, and the logarithm of its loss.
CHANCE = Ensemble.of(
    [
        (0, 24.5, (1, 30_000.0, -0.5, (2, 0.045, 0.25, 0.75)), (4, 6.5, (3, 0.035, 0.125, -0.25), 0.5)),
        (5, 30.5, (2, 0.065, -0.375, 0.0625), (0, 40.5, (1, 55_000.0, 0.1875, 0.4375), -0.0625)),
        (4, 3.5, (5, 12.5, 0.3125, -0.125), (3, 0.055, (0, 10.5, 0.15625, -0.28125), 0.03125)),
    ],
    base=-0.4,
    transform="LOGISTIC",
)
LOSS = Ensemble.of([(1, 20_000.0, (2, 0.025, 1.5, 1.25), (1, 60_000.0, (0, 30.5, 2.25, 2.5), 3.0)), (3, 0.025, (5, 60.5, 0.25, 0.375), (4, 9.5, -0.125, 0.0625))], base=0.1)
CAP = 13.0


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line's chance, capped amount and expected amount by the exported two-stage model."""
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.month("l_shipdate").cast("double"), F.dayofmonth("l_shipdate").cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    # each model once, and apart from what is made of it: methods of more than 8,000 bytes are never compiled to machine code
    scores = rows.select("l_orderkey", "l_linenumber", CHANCE.score(F.col("x"), finite=True).alias("chance"), LOSS.score(F.col("x")).alias("log_amount"))
    return scores.select("l_orderkey", "l_linenumber", F.round("chance", 6).alias("chance"), F.round(F.greatest("log_amount", F.lit(0.0)), 6).alias("log_amount"), F.round(F.col("chance") * capped(F.col("log_amount"), CAP), 6).alias("expected"))


QUERIES = {"m_tree_scores": tree_scores}
SQL = {
    "m_tree_scores": f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax,
      CAST(month(l_shipdate) AS DOUBLE) AS month, CAST(day(l_shipdate) AS DOUBLE) AS days FROM lineitem), s AS (SELECT *, {CHANCE.sql(FEATURES)} AS chance, {LOSS.sql(FEATURES)} AS log_amount FROM x)
      SELECT l_orderkey, l_linenumber, round(chance, 6) AS chance, round(greatest(log_amount, 0), 6) AS log_amount, round(chance * least(greatest(exp(log_amount) - 1, 0), {CAP}::DOUBLE), 6) AS expected FROM s"""
}
