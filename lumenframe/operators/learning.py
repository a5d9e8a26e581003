"""Classifiers of labelled spectra on pyspark.ml, discriminant analysis, projection, search, importance and explanation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.arrays import bound
from lumenframe.operators import boosting, statistics, svc
from lumenframe.operators.relational import dimension
from lumenframe.operators.summed import held

CLASSIFIERS = ("LDA", "Logistic regression", "SVC", "Decision Tree", "Random Forest", "XGBoost")


def dataset(spectra: DataFrame, classes: Sequence[int] = (), drop: Sequence[int] = ()) -> DataFrame:
    """key, label, features (vector) and balanced weights; classes restrict only if there are two at least."""
    df = spectra.where(F.col("grp").isin(list(classes))) if len(classes) > 1 else spectra
    kept = F.filter("y", lambda _, i: ~i.isin(list(drop))) if drop else F.col("y")
    df = df.select("key", F.col("grp").cast("double").alias("label"), array_to_vector(kept).alias("features"))
    return df.join(F.broadcast(statistics.class_weights(df, "label").select("label", "weight")), "label").select("key", "label", "features", "weight")


#: Where a dataset may come from; only decomposed ones have features that are ignored.
SOURCES = ("Smoothed", "Baseline corrected", "Decomposed")


def assembled(sources: dict[str, DataFrame], source: str, groups: DataFrame, classes: Sequence[int] = (), ignored: Sequence[int] = ()) -> DataFrame:
    """key, label, target (the class's name; null for a class without a group), features (array) of one of several sources.

    sources: by name, key, grp and the values (y of spectra, features of decomposed ones).  Classes restrict only
    if there are two at least; ignored features (their numbers) are left out of decomposed sources alone.
    groups: grp, name; a row a class, counted before it is broadcast.
    """
    if source not in SOURCES or source not in sources:
        raise ValueError(f"no dataset {source}; there are {', '.join(s for s in SOURCES if s in sources)}")
    df, values = sources[source], F.col("features" if source == "Decomposed" else "y")
    df = df.where(F.col("grp").isin(list(classes))) if len(classes) > 1 else df
    kept = F.filter(values, lambda _, i: ~i.isin(list(ignored))) if ignored and source == "Decomposed" else values
    rows = df.select("key", "grp", kept.alias("kept"))
    named = rows.join(dimension(groups.select("grp", F.col("name").alias("target"))), "grp", "left")
    return named.select("key", F.col("grp").alias("label"), "target", F.col("kept").alias("features"))


def estimator(name: str, seed: int = 0, **params):
    """The estimator of a name. SVC has a linear machine for each pair of classes and gives probabilities; XGBoost boosts trees under softmax loss."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "Logistic regression":
        return LogisticRegression(weightCol="weight", maxIter=100, **common, **params)
    if name == "SVC":
        return svc.PairwiseSvc(svc.Settings(**params), seed)
    if name == "Decision Tree":
        return DecisionTreeClassifier(weightCol="weight", seed=seed, **common, **params)
    if name == "Random Forest":
        return RandomForestClassifier(weightCol="weight", seed=seed, **common, **params)
    if name == "XGBoost":
        return boosting.SoftmaxBoosting(boosting.Settings(seed=seed, **params))
    raise ValueError(f"no estimator {name}; LDA is discriminant()")


@dataclass(frozen=True)
class Discriminant:
    """Linear discriminant: a class's score is w . x + b. The arrays have the size of classes times features."""

    classes: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w.T + self.b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def discriminant(df: DataFrame, shrinkage: float = 1e-3) -> Discriminant:
    """From class counts, sums and one pooled scatter matrix, added up in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[float, list] = {}
        for b in batches:
            for label, own in b.groupby("label"):
                m = np.stack(list(own["x"])).astype(float)
                n, s, q = held.get(label, (0, 0, 0))
                held[label] = (n + len(m), s + m.sum(axis=0), q + m.T @ m)
        for label, (n, s, q) in held.items():
            rows = np.concatenate([[n], s, q.ravel()])
            yield pd.DataFrame({"label": label, "i": np.arange(len(rows)), "v": rows})

    sums = df.select("label", vector_to_array("features").alias("x")).mapInPandas(run, "label double, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).toPandas().sort_values(["label", "i"])
    classes, means, counts, scatter = [], [], [], 0
    for label, own in sums.groupby("label"):
        v = own.v.to_numpy()
        p = int(round((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2))
        n, s, q = v[0], v[1 : p + 1], v[p + 1 :].reshape(p, p)
        classes.append(label)
        counts.append(n)
        means.append(s / n)
        scatter = scatter + q - np.outer(s, s) / n
    n, m = sum(counts), np.array(means)
    cov = scatter / max(1, n - len(classes))
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))
    w = np.linalg.solve(cov, m.T).T
    return Discriminant(np.array(classes), w, -0.5 * (w * m).sum(axis=1) + np.log(np.array(counts) / n))


def apply_discriminant(df: DataFrame, model: Discriminant) -> DataFrame:
    """prediction and probability by array expressions."""
    x = vector_to_array("features")
    score = lambda k: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in model.w[k]]), lambda a, b: a * b), F.lit(float(model.b[k])), lambda a, v: a + v)
    z = F.array(*[score(k) for k in range(len(model.classes))])
    names = F.array(*[F.lit(float(c)) for c in model.classes])
    bells = lambda z: bound(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))
    p = lambda z: bound(bells(z), lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, u: a + u), lambda s: F.transform(e, lambda v: v / s)))
    said = lambda z: F.get(names, (F.array_position(z, F.array_max(z)) - 1).cast("int"))
    both = bound(z, lambda z: F.struct(said(z).alias("prediction"), p(z).alias("probability")))
    return df.select("key", "label", both.alias("both")).select("key", "label", "both.prediction", "both.probability")


def train_and_predict(df: DataFrame, name: str, test_percent: float = 20.0, seed: int = 0, **params) -> DataFrame:
    """key, label, is_test, prediction, probability (empty where the classifier gives none)."""
    split = statistics.stratified_split(df, "label", "key", test_percent, seed)
    train = held(split.where(~F.col("is_test")).drop("is_test"), df.count())
    try:
        out = _predictor(train, name, seed, **params)(df)
    finally:
        train.unpersist()
    return out.join(split.select("key", "is_test"), "key")


def _predictor(train: DataFrame, name: str, seed: int = 0, **params) -> Callable[[DataFrame], DataFrame]:
    """What gives key, label, prediction and probability of rows like those that it has learnt from."""
    if name == "LDA":
        model = discriminant(train)
        return lambda df: apply_discriminant(df, model)
    fitted = estimator(name, seed, **params).fit(train)

    def predicted(df: DataFrame) -> DataFrame:
        out = fitted.transform(df)
        p = vector_to_array("probability") if "probability" in out.columns else F.array().cast("array<double>")
        return out.select("key", "label", "prediction", p.alias("probability"))

    return predicted


def metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy by fold, and macro precision, recall, F1."""
    by = predictions.groupBy("is_test", "label", "prediction").agg(F.count("*").alias("n"))
    own = by.groupBy("is_test", "label").agg(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("n"))
    said = by.groupBy("is_test", F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    each = own.join(said, ["is_test", "label"], "left").withColumn("precision", F.coalesce(F.col("tp") / F.col("said"), F.lit(0.0))).withColumn("recall", F.col("tp") / F.col("n"))
    return each.groupBy("is_test").agg((F.sum("tp") / F.sum("n")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg(F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))).alias("f1"))


def principal_components(df: DataFrame, k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Standardised scores of the centred features, and the shares of variance. Signs: each axis's largest loading is positive."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(df).transform(df)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    v = vector_to_array("pc")
    out = model.transform(centred).select("key", "label", *((F.get(v, F.lit(j)) * float(signs[j])).alias(f"pc{j + 1}") for j in range(k)))
    s = out.agg(*(F.stddev_pop(f"pc{j + 1}").alias(f"s{j}") for j in range(k))).first()
    return out.select("key", "label", *((F.col(f"pc{j + 1}") / (s[j] or 1.0)).alias(f"pc{j + 1}") for j in range(k))), np.asarray(model.explainedVariance.toArray())


def search(df: DataFrame, name: str, grid: dict[str, Sequence], folds: int = 3, seed: int = 0, parallelism: int = 2):
    """Cross-validated search over a grid of Spark's own estimators; returns the fitted CrossValidatorModel. SVC and XGBoost have search.adaptive()."""
    est = estimator(name, seed)
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(est.getParam(p), list(values))
    fold = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(folds)).cast("int")
    return CrossValidator(estimator=est, estimatorParamMaps=builder.build(), evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, foldCol="fold", parallelism=parallelism).fit(df.withColumn("fold", fold))


def search_table(spark, df: DataFrame, name: str, grid: dict[str, Sequence], folds: int = 3, seed: int = 0) -> DataFrame:
    """params, metric (mean F1 over the folds), is_best of every point of a grid; as many rows as the grid has points."""
    found = search(df, name, grid, folds, seed)
    points = [", ".join(sorted(f"{p.name}={v}" for p, v in m.items())) for m in found.getEstimatorParamMaps()]
    best = int(np.argmax(found.avgMetrics))
    return spark.createDataFrame([(p, float(v), i == best) for i, (p, v) in enumerate(zip(points, found.avgMetrics, strict=True))], "params string, metric double, is_best boolean")


#: Times that each feature is dealt anew; rows among which its values are dealt.
REPEATS, DEALT = 5, 256


def permuted(df: DataFrame, features: Sequence[int], repeats: int = REPEATS, seed: int = 0, dealt: int = DEALT) -> DataFrame:
    """feature, repeat, label, features: every row once as it is (feature -1), and once for each feature and repeat with that feature from another row.

    Rows are put into groups of about `dealt` by a hash of their key, so that a group is a random part of all
    rows, and sorted by it; a feature's values move on by a seeded number of rows, so no row keeps its own
    (but in a group of one). One shuffle of the rows; a task holds one group, and results don't depend on partitions.
    """
    n = df.count()
    groups = max(1, round(n / dealt))
    chosen = np.array(list(features), int)
    rows = df.select("label", vector_to_array("features").alias("x"), F.xxhash64("key", F.lit(seed)).alias("h"), "key").withColumn("g", F.pmod(F.shiftright("h", 16), F.lit(groups)))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "key"])
        x = np.array(own["x"].to_list(), float)
        m, label = len(x), own["label"].to_numpy()
        rng = np.random.default_rng([seed, int(key[0])])
        out = [pd.DataFrame({"feature": -1, "repeat": 0, "label": label, "features": list(x)})]
        for f in chosen:
            for r, by in enumerate(rng.integers(1, max(2, m), repeats)):
                moved = x.copy()
                moved[:, f] = np.roll(x[:, f], by)
                out.append(pd.DataFrame({"feature": int(f), "repeat": r, "label": label, "features": list(moved)}))
        return pd.concat(out)

    made = rows.groupBy("g").applyInPandas(run, "feature int, repeat int, label double, features array<double>")
    return made.withColumn("features", array_to_vector("features"))


def permutation_importance(df: DataFrame, model, features: Sequence[int], seed: int = 0) -> DataFrame:
    """feature, repeat, f1, fall: micro F1 with a feature's values dealt anew, REPEATS times each, and how much less it is than F1 on the rows as they are (feature -1).

    All features and repeats are scored in one job.
    """
    scored = statistics.micro_f1(model.transform(permuted(df, features, seed=seed)), "feature", "repeat")
    whole = Window.partitionBy()  # of one row a feature and repeat
    own = F.max(F.when(F.col("feature") == -1, F.col("f1"))).over(whole)
    return scored.withColumn("fall", own - F.col("f1"))


def linear_contributions(df: DataFrame, model: Discriminant) -> DataFrame:
    """Exact additive explanation of a linear score: w * (x - mean), by class and feature."""
    x = df.select("key", vector_to_array("features").alias("x"))
    mean = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    names = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.w])
    long = x.select("key", F.posexplode("x").alias("i", "v")).join(F.broadcast(mean), "i")
    each = long.select("key", F.col("i").alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(len(model.classes) - 1))).alias("class"), "v", "m")
    return each.select("key", "feature", "class", (F.get(F.get(names, F.col("class")), F.col("feature")) * (F.col("v") - F.col("m"))).alias("contribution"))


def predict_all(df: DataFrame, names: Sequence[str], seed: int = 0) -> DataFrame:
    """key, model, prediction, probability of several classifiers, one below the other; all learn from the same rows, four fifths of each class."""
    split = statistics.stratified_split(df, "label", "key", 20.0, seed)
    train = held(split.where(~F.col("is_test")).drop("is_test"), df.count())
    try:
        with ThreadPoolExecutor(len(names)) as pool:  # side by side: a fit is many short jobs
            predictors = list(pool.map(lambda name: _predictor(train, name, seed), names))
    finally:
        train.unpersist()
    each = [p(df).select("key", F.lit(name).alias("model"), "prediction", "probability") for name, p in zip(names, predictors, strict=True)]
    return reduce(DataFrame.unionByName, each)


def learning_curve(df: DataFrame, shares: Sequence[float] = (0.25, 0.5, 1.0), seed: int = 0) -> DataFrame:
    """Test accuracy of the discriminant by the share of training rows; shares are nested by a seeded hash."""
    split = statistics.stratified_split(df, "label", "key", 20.0, seed)
    u = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1000)) / 1000
    out = None
    for share in shares:
        model = discriminant(split.where(~F.col("is_test") & (u < share)))
        scored = apply_discriminant(split.where("is_test"), model)
        one = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.count("*").alias("n")).select(F.lit(float(share)).alias("share"), "accuracy", "n")
        out = one if out is None else out.unionByName(one)
    return out
