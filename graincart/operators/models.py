"""Model registry on Spark ML, and fits on the training split only."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart import tables
from graincart.operators import neighbours
from graincart.operators.kernel import ERROR, RandomFourier, SupportVectorRegression
from graincart.operators.neighbours import Neighbours
from graincart.operators.network import Network, Options
from graincart.operators.running import places

LABEL, FEATURES, MAPPED, PREDICTION = "_label", "_features", "_mapped", "prediction"


@dataclass(frozen=True)
class Entry:
    """A model family: how to build it for a task from its options, and a note where it differs from what is usual."""

    name: str
    build: Callable
    tasks: tuple[str, ...] = ("classification", "regression")
    options: dict = field(default_factory=dict)
    note: str = ""


def _logistic(task: str, rows: int, o: dict):
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, maxIter=o["max_iter"], regParam=1.0 / (o["C"] * max(rows, 1)), elasticNetParam=0.0, standardization=False)


def _linear(task: str, rows: int, o: dict):
    return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0, solver="normal")


def _forest(task: str, rows: int, o: dict):
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return kind(featuresCol=FEATURES, labelCol=LABEL, numTrees=o["trees"], maxDepth=o["depth"], featureSubsetStrategy="sqrt" if task == "classification" else "all", seed=o["seed"])


def _boosting(task: str, rows: int, o: dict):
    if task == "regression":
        return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, maxIter=o["rounds"], maxDepth=3, stepSize=0.1, seed=o["seed"])
    one = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=o["rounds"], maxDepth=3, stepSize=0.1, seed=o["seed"])
    return one if o.get("classes", 2) == 2 else OneVsRest(classifier=one, featuresCol=FEATURES, labelCol=LABEL)


def _svm(task: str, rows: int, o: dict):
    if o["kernel"] not in ("rbf", "linear"):
        raise ValueError(f"svm has the kernels rbf and linear, not {o['kernel']!r}")
    mapped = [RandomFourier(inputCol=FEATURES, outputCol=MAPPED, gamma=float(o["gamma"]), error=float(o["error"]), seed=o["seed"])] if o["kernel"] == "rbf" else []
    read = MAPPED if mapped else FEATURES
    if task == "regression":
        return [*mapped, SupportVectorRegression(featuresCol=read, labelCol=LABEL, C=float(o["C"]), epsilon=float(o["epsilon"]))]
    one = LinearSVC(featuresCol=read, labelCol=LABEL, maxIter=100, regParam=1.0 / (o["C"] * max(rows, 1)), standardization=False)
    return [*mapped, one if o.get("classes", 2) == 2 else OneVsRest(classifier=one, featuresCol=read, labelCol=LABEL)]


def _neighbours(task: str, rows: int, o: dict):
    return Neighbours(featuresCol=FEATURES, labelCol=LABEL, classes=o.get("classes", 2) if task == "classification" else 0, k=o["k"])


def _bayes(task: str, rows: int, o: dict):
    return NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian", smoothing=1e-9)


def _network(task: str, rows: int, o: dict):
    given = {k: v for k, v in o.items() if k not in ("inputs", "classes")}
    return Network(featuresCol=FEATURES, labelCol=LABEL, classes=o.get("classes", 2) if task == "classification" else 0, options=json.dumps(given))


REGISTRY = {
    e.name: e
    for e in (
        Entry("logistic_regression", _logistic, ("classification",), {"max_iter": 1000, "C": 1.0}),
        Entry("linear_regression", _linear, ("regression",)),
        Entry("svm", _svm, options={"kernel": "rbf", "C": 1.0, "gamma": 0.0, "epsilon": 0.1, "error": ERROR, "seed": 0}, note="the kernel by random features, with an error bound; no probabilities"),
        Entry("knn", _neighbours, options={"k": 5}, note="exact, by pivots"),
        Entry("random_forest", _forest, options={"trees": 100, "depth": 12, "seed": 0}, note="depth is bounded"),
        Entry("gradient_boosting", _boosting, options={"rounds": 100, "seed": 0}),
        Entry("naive_bayes", _bayes, ("classification",)),
        Entry("mlp", _network, options=asdict(Options()), note="Adam in every partition, averaged after each epoch"),
    )
}


def pipeline(name: str, task: str, inputs: list[str], rows: int, **options) -> Pipeline:
    entry = REGISTRY[name]
    if task not in entry.tasks:
        raise ValueError(f"{name} does not do {task}")
    if unknown := set(options) - set(entry.options) - {"classes"}:
        raise ValueError(f"{name} has no option {', '.join(sorted(unknown))}")
    o = entry.options | {"inputs": len(inputs)} | options
    built = entry.build(task, rows, o)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol=FEATURES), *(built if isinstance(built, list) else [built])])


def encoder(df: DataFrame, target: str):
    """Classes in the order of their names as 0, 1, ...; values that training has not seen are an error."""
    return StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc", handleInvalid="error").fit(df)


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """``df`` with the target as a number under LABEL; a value that is none, or not finite, is a ValueError that tells how many there are."""
    x = F.col(target).try_cast("double")
    bad = F.col(target).isNotNull() & (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = df.where(bad).count()
    if n:
        raise ValueError(f"{n} values of {target} are no numbers")
    return df.withColumn(LABEL, x)


def fit(df: DataFrame, name: str, task: str, inputs: list[str], target: str, split: str = "split", **options) -> PipelineModel:
    """A model of the training rows only; the target of a classification is encoded by ``encoder``."""
    train = df.where(F.col(split) == "train")
    if task == "classification":
        codes = encoder(train.withColumn(target, F.col(target).cast("string")), target)
        train = codes.transform(train.withColumn(target, F.col(target).cast("string")))
        options = {"classes": len(codes.labels)} | options
        return PipelineModel([codes, *pipeline(name, task, inputs, train.count(), **options).fit(train).stages])
    train = numeric_target(train, target)
    return pipeline(name, task, inputs, train.count(), **options).fit(train)


def predict(model: PipelineModel, df: DataFrame, inputs: list[str]) -> DataFrame:
    """``df`` with predicted class (or value) and the probability of each class, if the model has them."""
    missing = [c for c in inputs if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df
    codes = None
    for stage in model.stages:
        if hasattr(stage, "labels"):
            codes = stage.labels
            continue
        out = stage.transform(out)
    if codes is None:
        return out.withColumnRenamed(PREDICTION, "predicted").drop(FEATURES, MAPPED)
    named = F.element_at(F.array(*map(F.lit, codes)), (F.col(PREDICTION) + 1).cast("int"))
    if "probability" in out.columns:
        chances = vector_to_array("probability")
        out = out.withColumns({f"probability_{c}": F.get(chances, F.lit(i)) for i, c in enumerate(codes)})
    return out.withColumn("predicted", named).drop(FEATURES, MAPPED, PREDICTION, "probability", "rawPrediction")


def tune(df: DataFrame, name: str, task: str, inputs: list[str], grid: dict[str, list], evaluator, key: list[str], folds: int = 3, seed: int = 0):
    """Cross-validated fit over a grid of the last stage's parameters, on rows that have ``_label``.

    Each class is dealt evenly to the folds. Raises ValueError if there are fewer than two rows for
    each fold, or if no setting gives a finite score.
    """
    rows = df.count()
    if rows < 2 * folds:
        raise ValueError(f"{rows} rows are too few for {folds} folds")
    flow = pipeline(name, task, inputs, rows)
    last = flow.getStages()[-1]
    build = ParamGridBuilder()
    for k, values in grid.items():
        build = build.addGrid(last.getParam(k), values)
    dealt = places(df, f"fold-{seed}", key, [LABEL] if task == "classification" else None).withColumn("_fold", (F.col("_at") % folds).cast("int")).drop("_at")
    found = CrossValidator(estimator=flow, estimatorParamMaps=build.build(), evaluator=evaluator, numFolds=folds, foldCol="_fold", seed=seed).fit(dealt)
    if not any(math.isfinite(x) for x in found.avgMetrics):
        raise ValueError("no setting has a finite score")
    return found


def search(df: DataFrame, name: str, task: str, inputs: list[str], target: str, grid: dict[str, list], score: Callable[[DataFrame], float], key: list[str], folds: int = 3, most: int | None = None, seed: int = 0, fixed: dict | None = None) -> tuple[dict, list[tuple[dict, float]]]:
    """The options of ``grid`` with the best mean ``score`` (more is better) over folds, and the score of each setting tried.

    Any model of the registry may be searched. Each class is dealt evenly to the folds, and every fold
    is predicted by a model of the others. With ``most`` only so many settings are tried, drawn by
    ``seed``. Ties go to the setting that comes first in the grid. Raises ValueError if there are fewer
    than two rows for each fold, or if no setting gives a finite score.
    """
    rows = df.count()
    if rows < 2 * folds:
        raise ValueError(f"{rows} rows are too few for {folds} folds")
    settings = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    if most is not None and most < len(settings):
        settings = [settings[i] for i in sorted(random.Random(seed).sample(range(len(settings)), most))]
    dealt = places(df, f"fold-{seed}", key, [target] if task == "classification" else None)
    dealt = tables.written(dealt.withColumn("_fold", (F.col("_at") % folds).cast("int")).drop("_at"))
    told = []
    try:
        for o in settings:
            found = []
            for fold in range(folds):
                parted = dealt.withColumn("_split", F.when(F.col("_fold") == fold, "test").otherwise("train"))
                try:
                    model = fit(parted, name, task, inputs, target, "_split", **((fixed or {}) | o))
                    found.append(float(score(predict(model, parted.where("_split = 'test'"), inputs))))
                except Exception:  # noqa: BLE001  a setting that cannot be fitted is none of the best
                    found.append(math.nan)
            told.append((o, sum(found) / len(found)))
    finally:
        tables.drop(dealt)
    finite = [(o, x) for o, x in told if math.isfinite(x)]
    if not finite:
        raise ValueError("no setting has a finite score")
    return max(finite, key=lambda t: t[1])[0], told


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], float], columns: list[str], key: str, repeats: int = 3) -> dict[str, float]:
    """The mean loss of ``score`` when one column's values move to other rows, by a join of two orders of the rows."""
    base, out = score(df), {}
    for c in columns:
        drops = []
        for r in range(repeats):
            values = places(df.select(key, c), f"{c}{r}a", [key]).select("_at", F.col(c).alias("_new"))
            moved = places(df, f"{c}{r}b", [key]).join(values, "_at").withColumn(c, F.col("_new")).drop("_at", "_new")
            drops.append(base - score(moved))
        out[c] = sum(drops) / len(drops)
    return out


def nearest_neighbours(train: DataFrame, queries: DataFrame, vector: str, key: str, k: int = 5) -> DataFrame:
    """(query, neighbour, distance): the ``k`` nearest rows of ``train`` for each query by Euclidean distance, ties by key.

    A row is no neighbour of the query of its own key. See ``neighbours``: exact, by pivots.
    """
    index = neighbours.build(train, [key], vector)
    found = neighbours.nearest(index, queries.select(F.col(key).alias("query"), F.col(vector).alias("v")), k, but=key)
    return found.select("query", F.col("content")[key].alias("neighbour"), "distance")


def gaussian_bayes(df: DataFrame, inputs: list[str], target: str) -> DataFrame:
    """(class, share, mean and variance of each input): the parameters of Gaussian naive Bayes, one aggregation."""
    aggs: list[Column] = [F.count("*").alias("n")]
    for c in inputs:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}")]
    return df.groupBy(F.col(target).alias("class")).agg(*aggs)
