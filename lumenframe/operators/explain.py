"""Explanations of fitted classifiers: Shapley values of trees, dependence on features, decision areas in two dimensions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import learning, statistics
from lumenframe.operators.boosting import Booster, Tree

#: A leaf: values by class, then for each feature on its way the open lower end, the closed upper end and the share of training weight that follows.
Leaf = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _leaves(tree, value) -> list[Leaf]:
    """The leaves of one Spark tree. value: what a leaf's Java node predicts, by class."""
    out: list[Leaf] = []

    def walk(node, way: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            f = sorted(way)
            ends = np.array([way[k] for k in f], float).reshape(len(f), 3)
            out.append((value(node), np.array(f, int), ends[:, 0], ends[:, 1], ends[:, 2]))
            return
        split, whole = node.split(), node.impurityStats().count()
        k, cut = split.featureIndex(), split.threshold()
        lo, hi, share = way.get(k, (-np.inf, np.inf, 1.0))
        for child, ends in ((node.leftChild(), (lo, min(hi, cut))), (node.rightChild(), (max(lo, cut), hi))):
            walk(child, way | {k: (*ends, share * child.impurityStats().count() / whole)})

    walk(tree._call_java("rootNode"), {})
    return out


def _boosted_leaves(tree: Tree, cuts: list[np.ndarray], unit: np.ndarray) -> list[Leaf]:
    """The leaves of one boosted tree, weighed by the curvature that reached them."""
    out: list[Leaf] = []

    def walk(node: int, way: dict[int, tuple[float, float, float]]) -> None:
        k = tree.feature[node]
        if k < 0:
            f = sorted(way)
            ends = np.array([way[i] for i in f], float).reshape(len(f), 3)
            out.append((tree.value[node] * unit, np.array(f, int), ends[:, 0], ends[:, 1], ends[:, 2]))
            return
        at, cut = tree.left[node], float(cuts[k][tree.cut[node]])
        lo, hi, share = way.get(k, (-np.inf, np.inf, 1.0))
        for child, ends in ((at, (lo, min(hi, cut))), (at + 1, (max(lo, cut), hi))):
            walk(child, way | {k: (*ends, share * tree.cover[child] / tree.cover[node])})

    walk(0, {})
    return out


def leaves(model) -> list[Leaf]:
    """All leaves of a tree, a forest or boosted trees; their values add up to what is explained.

    Trees and forests: class probabilities. Boosted trees: the margin of each class (of the second one, if there are two).
    A missing value follows no leaf's way.
    """

    def shares(node) -> np.ndarray:
        v = np.array(list(node.impurityStats().stats()), float)
        return v / max(v.sum(), 1e-300)

    if isinstance(model, DecisionTreeClassificationModel):
        return _leaves(model, shares)
    if isinstance(model, RandomForestClassificationModel):
        trees = model.trees
        return [(v / len(trees), *rest) for t in trees for v, *rest in _leaves(t, shares)]
    if isinstance(model, Booster):
        unit = np.eye(model.outputs)
        return [leaf for trees in model.trees for k, t in enumerate(trees) for leaf in _boosted_leaves(t, model.cuts, unit[k])]
    raise ValueError(f"no trees in {type(model).__name__}")


def shapley(x: np.ndarray, all_leaves: Sequence[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """(base value by class, contributions by row, feature and class) of a sum of leaves.

    A leaf's game is a product over the features on its way: a known feature gives whether the
    row follows, an unknown one the share of training weight that does. The coefficient of t^k in
    the product of (share + follows * t) over the other features sums the coalitions of k.
    """
    n_classes = len(all_leaves[0][0])
    base, out = np.zeros(n_classes), np.zeros((len(x), x.shape[1], n_classes))
    for value, feats, lo, hi, share in all_leaves:
        d = len(feats)
        base += value * share.prod()
        follows = ((x[:, feats] > lo) & (x[:, feats] <= hi)).astype(float)
        weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
        for f in range(d):
            c = np.zeros((len(x), d))
            c[:, 0] = 1.0
            for g in range(d):
                if g != f:
                    c[:, 1:] = c[:, 1:] * share[g] + c[:, :-1] * follows[:, [g]]
                    c[:, 0] *= share[g]
            out[:, feats[f]] += ((follows[:, f] - share[f]) * (c @ weight))[:, None] * value
    return base, out


def tree_contributions(df: DataFrame, model) -> DataFrame:
    """key, class, feature, value, contribution, base of every row, for the features that some tree splits on (others give 0).

    A row's contributions of a class and the base add up to the prediction. The leaves go with the task: their
    number is set by the model's parameters, not by rows.
    """
    own = leaves(model)
    used = sorted({int(f) for leaf in own for f in leaf[1]})
    n_classes = len(own[0][0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not used:
                continue
            x = np.stack(list(b["x"])).astype(float)
            base, phi = shapley(x, own)
            n, u = len(b), len(used)
            yield pd.DataFrame({
                "key": np.repeat(b["key"].to_numpy(), n_classes * u), "class": np.tile(np.repeat(np.arange(n_classes), u), n), "feature": np.tile(used, n * n_classes),
                "value": np.repeat(x[:, None, used], n_classes, axis=1).ravel(), "contribution": phi[:, used].transpose(0, 2, 1).ravel(), "base": np.tile(np.repeat(base, u), n),
            })

    return df.select("key", vector_to_array("features").alias("x")).mapInPandas(run, "key long, class int, feature int, value double, contribution double, base double")


def mean_contributions(contributions: DataFrame, n: int | None = None) -> DataFrame:
    """class, feature, mean_abs, rank: the features by mean size of their contributions; the n first of each class."""
    by = contributions.groupBy("class", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    ranked = by.withColumn("rank", F.row_number().over(statistics.Window.partitionBy("class").orderBy(F.desc("mean_abs"), "feature")))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def partial_dependence(df: DataFrame, model, features: Sequence[int], steps: int = 10) -> DataFrame:
    """v1 (and v2), class, probability: the mean over all rows with one or two features set to each value of a grid.

    The grid spans the 5th to the 95th percentile. Each row is scored steps or steps^2 times in one pass.
    """
    x = df.select(vector_to_array("features").alias("x"))
    ends = x.select(*(F.get("x", F.lit(f)).alias(f"f{f}") for f in features)).approxQuantile([f"f{f}" for f in features], [0.05, 0.95], 0.01)
    names = [f"v{i + 1}" for i in range(len(features))]
    rows = x
    for name, (lo, hi) in zip(names, ends, strict=True):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in np.linspace(lo, hi, steps)])))
    set_to = F.transform("x", lambda v, i: F.coalesce(*(F.when(i == f, F.col(n)) for f, n in zip(features, names, strict=True)), v))
    scored = model.transform(rows.select(*names, array_to_vector(set_to).alias("features")))
    each = scored.select(*names, F.posexplode(vector_to_array("probability")).alias("class", "p"))
    return each.groupBy(*names, "class").agg(F.avg("p").alias("probability"))


def decision_areas(df: DataFrame, name: str, steps: int = 50, seed: int = 0) -> DataFrame:
    """pc1, pc2, prediction on a grid over the first two principal components, by a classifier fitted anew on them."""
    scores, _ = learning.principal_components(df)
    weights = df.select("key", "weight")
    flat = VectorAssembler(inputCols=["pc1", "pc2"], outputCol="features")
    train = flat.transform(scores.join(weights, "key")).select("key", "label", "features", "weight")
    a = scores.agg(*(f(c).alias(f"{n}_{c}") for c in ("pc1", "pc2") for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    at = lambda c, i: F.lit(a[f"lo_{c}"]) + i * ((a[f"hi_{c}"] - a[f"lo_{c}"]) / max(1, steps - 1))
    cells = df.sparkSession.range(steps * steps).select(F.col("id").alias("key"), at("pc1", F.col("id") % steps).alias("pc1"), at("pc2", F.floor(F.col("id") / steps)).alias("pc2"), F.lit(0.0).alias("label"))
    grid = flat.transform(cells)
    if name == "LDA":
        said = learning.apply_discriminant(grid, learning.discriminant(train))
    else:
        said = learning.estimator(name, seed).fit(train).transform(grid)
    return cells.drop("label").join(said.select("key", "prediction"), "key").select("pc1", "pc2", "prediction")


def importances(spark, model) -> DataFrame:
    """feature, importance: mean fall of impurity by feature, as the fitted trees hold it (one value for each feature)."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())], "feature int, importance double")


def mean_effects(df: DataFrame, model: learning.Discriminant) -> DataFrame:
    """class, feature, effect: a linear score's coefficient times the mean of the feature over all rows."""
    means = df.select(F.posexplode(vector_to_array("features")).alias("feature", "v")).groupBy("feature").agg(F.avg("v").alias("mean"))
    weights = F.array(*[F.struct(F.lit(int(c)).alias("class"), F.array(*map(F.lit, map(float, row))).alias("w")) for c, row in zip(model.classes, model.w, strict=True)])
    each = means.select("feature", "mean", F.explode(weights).alias("c"))
    return each.select(F.col("c.class").alias("class"), "feature", (F.get("c.w", F.col("feature")) * F.col("mean")).alias("effect"))


def tree_lines(spark, model) -> DataFrame:
    """line, text: a fitted tree's rules, one line for each node."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(model.toDebugString.rstrip().split("\n"))], "line int, text string")
